"""The query of each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_text, licenses, mixing, ngram_join, quality, secrets, token_output, warc
from .common import read

#: Parameters of the token queries: vocabulary files of public tokenizers.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"), RANKS, PATTERN)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_ngram_jaccard, op3_license_scan, op4_warc, op5_token_output, op6_decontaminate, op7_mix_sources, op8_quality, op9_html_text, op10_secrets)}

_OP1 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS kept, text_sha256
FROM n"""

_SQL_TEMPLATES = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{x}'" for x in licenses.bigrams(text))) for name, text in sorted(licenses.TEMPLATES.items()))
_OP3 = rf"""
WITH templates(license, own) AS (VALUES {_SQL_TEMPLATES}),
parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, 0 AS line_no, text AS unit FROM parts WHERE len(lines) > 1
  UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)), unnest(lines) FROM parts),
worded AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM units),
grams AS (
  SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM worded WHERE len(words) > 1),
scored AS (
  SELECT doc_id, line_no, license, 2.0 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams, templates
  WHERE len(g) BETWEEN len(own) * 0.5 AND len(own) * 2)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, round(dice, 6) AS dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) = 1"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1) k USING (doc_id)"""

_OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m"""

ORACLES = {"op1_exact_dedup": _OP1, "op2_ngram_jaccard": _OP2, "op3_license_scan": _OP3, "op4_warc": _OP4}
