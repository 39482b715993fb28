"""Registered queries over the driver's tables, and their oracle SQL.

The `events` table stands in for microservice events: adapted() and the SQL text EV derive the same columns from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as fx
from logloom.operators import calibrate, cause, detect, features, localize, review, sessions, split, templates
from logloom.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def adapted(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "event_id + 1 AS ordinal",
        "CASE WHEN k % 10 = 0 THEN ' ' ELSE concat('u', user_id, '-', date_format(ts, 'yyyyMMdd')) END AS tc_trace_id",
        "CASE WHEN k % 20 = 0 THEN concat('f', user_id) ELSE '' END AS traceId",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS timestamp",
        "CASE WHEN k % 17 = 0 THEN 'DEBUG' WHEN event_type = 'error' THEN 'error ' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'info' END AS level",
        "CASE WHEN k % 13 = 0 THEN '' ELSE concat('svc-', k % 7) END AS tc_service",
        "concat('Request ', event_id, ' of user ', user_id, CASE WHEN k % 11 = 0 THEN concat(' serviceStarted: svc-', k % 5) ELSE '' END, CASE WHEN event_type = 'error' THEN concat(' timeout after ', k, ' ms from 10.0.0.', k % 256) ELSE ' done' END) AS message",
        "CASE WHEN event_type = 'error' AND k >= 50 THEN concat('java.lang.IllegalStateException: failed step ', k % 5) ELSE '' END AS stack_trace",
        "concat('com.acme.Log', k % 4) AS logger_name",
        "CASE WHEN k % 3 = 0 THEN concat('call(a):svc-', k % 7, '/x call(b):svc-', k % 4, '/y') ELSE '' END AS tc_trace_call_stack",
        "concat('t', user_id % 5) AS tc_tenant", "concat('u', user_id) AS tc_user", "concat('p', k % 3) AS tc_primitive", "CAST(k % 9 AS INT) AS template_id",
        "concat('part-', k % 4, '.csv') AS file",
    )


EV = r"""
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT event_id + 1 AS ordinal,
  CASE WHEN k % 10 = 0 THEN ' ' ELSE concat('u', user_id, '-', strftime(ts, '%Y%m%d')) END AS tc_trace_id,
  CASE WHEN k % 20 = 0 THEN concat('f', user_id) ELSE '' END AS traceId,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN k % 17 = 0 THEN 'DEBUG' WHEN event_type = 'error' THEN 'error ' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'info' END AS level,
  CASE WHEN k % 13 = 0 THEN '' ELSE concat('svc-', k % 7) END AS tc_service,
  concat('Request ', event_id, ' of user ', user_id, CASE WHEN k % 11 = 0 THEN concat(' serviceStarted: svc-', k % 5) ELSE '' END,
    CASE WHEN event_type = 'error' THEN concat(' timeout after ', k, ' ms from 10.0.0.', k % 256) ELSE ' done' END) AS message,
  CASE WHEN event_type = 'error' AND k >= 50 THEN concat('java.lang.IllegalStateException: failed step ', k % 5) ELSE '' END AS stack_trace,
  concat('com.acme.Log', k % 4) AS logger_name,
  CASE WHEN k % 3 = 0 THEN concat('call(a):svc-', k % 7, '/x call(b):svc-', k % 4, '/y') ELSE '' END AS tc_trace_call_stack,
  concat('t', user_id % 5) AS tc_tenant, concat('u', user_id) AS tc_user, concat('p', k % 3) AS tc_primitive, CAST(k % 9 AS INT) AS template_id,
  concat('part-', k % 4, '.csv') AS file FROM raw),
tr AS (SELECT *, coalesce(nullif(trim(tc_trace_id), ''), nullif(trim(traceId), ''), '') AS analysis_trace_id,
  CASE WHEN trim(tc_trace_id) <> '' THEN 'tc_trace_id' WHEN trim(traceId) <> '' THEN 'traceId' ELSE 'none' END AS analysis_trace_id_source,
  upper(trim(level)) AS lv FROM ev)"""


def traced(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.traceable(sessions.assign_trace(adapted(spark, sf)))


def with_sql(body: str) -> str:
    return f"WITH {EV}{body}"


# --- sources and audit


@query("src2_check_labels", """
WITH r AS (SELECT doc_id AS row_no, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'x' ELSE 'blk_' || (doc_id % 97) END AS BlockId,
  CASE WHEN doc_id % 29 = 0 THEN 'Odd' WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS Label FROM labels),
e AS (SELECT *, CASE WHEN BlockId = '' THEN 'blank' WHEN BlockId NOT LIKE 'blk%' THEN 'bad_id' WHEN Label = 'Odd' THEN 'bad_label' END AS early FROM r),
g AS (SELECT row_no, row_number() OVER (PARTITION BY BlockId ORDER BY row_no) AS nth, Label, first_value(Label) OVER (PARTITION BY BlockId ORDER BY row_no) AS f FROM e WHERE early IS NULL)
SELECT coalesce(early, CASE WHEN nth > 1 AND g.Label = f THEN 'duplicate' WHEN nth > 1 THEN 'conflict' ELSE 'accepted' END) AS reason, count(*) AS n, min(e.row_no) AS first_row
FROM e LEFT JOIN g ON e.row_no = g.row_no GROUP BY 1""")
def src2(spark, sf):
    rows = table(spark, sf, "labels").selectExpr("doc_id AS row_no", "CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'x' ELSE concat('blk_', doc_id % 97) END AS BlockId", "CASE WHEN doc_id % 29 = 0 THEN 'Odd' WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS Label")
    return readers.check_labels(rows).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))


@query("ag2_file_audit", with_sql("""
SELECT file, count(*) AS rows, count(DISTINCT nullif(trim(tc_trace_id), '')) AS distinct_ids, count(*) FILTER (trim(tc_trace_id) = '') AS blank_ids,
  count(*) FILTER (trim(tc_trace_id) = '' AND trim(traceId) <> '') AS fallback_ids FROM ev GROUP BY GROUPING SETS ((file), ())"""))
def ag2(spark, sf):
    return sessions.file_audit(adapted(spark, sf), F.col("file"))


@query("ag1_log_audit", r"""
WITH l AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('copy blk_', user_id, ' to blk_-', event_id % 7, CASE WHEN event_id % 3 = 0 THEN concat(' blk_', user_id) ELSE '' END) END AS content FROM events),
m AS (SELECT content IS NOT NULL AS ok, regexp_extract_all(coalesce(content, ''), 'blk_-?\d+') AS ids FROM l),
n AS (SELECT ok, len(ids) AS n, len(list_distinct(ids)) AS d FROM m)
SELECT count(*) AS lines, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS unparseable, CAST(sum(d) FILTER (ok) AS BIGINT) AS associations, CAST(sum(n) FILTER (ok) AS BIGINT) AS mentions,
  count(*) FILTER (ok AND d = 0) AS without_id, count(*) FILTER (ok AND d = 1) AS single_id, count(*) FILTER (ok AND d > 1) AS multiple_ids, CAST(sum(n - d) FILTER (ok) AS BIGINT) AS repeated_mentions FROM n""")
def ag1(spark, sf):
    return sessions.log_audit(table(spark, sf, "events").selectExpr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('copy blk_', user_id, ' to blk_-', event_id % 7, CASE WHEN event_id % 3 = 0 THEN concat(' blk_', user_id) ELSE '' END) END AS content"))


@query("ag27_acceptance", with_sql("""
SELECT count(*) > 0 AS has_rows, count(*) FILTER (trim(tc_trace_id) = '') = 0 AS no_blank, count(*) > 0 AND count(*) FILTER (trim(tc_trace_id) = '') = 0 AS accepted FROM ev"""))
def ag27(spark, sf):
    counts = sessions.file_audit(adapted(spark, sf), F.col("file")).filter("file is null")
    return sessions.acceptance(counts, {"has_rows": F.col("rows") > 0, "no_blank": F.col("blank_ids") == 0})


@query("jn2_reconcile", """
SELECT d.doc_id AS block_id, 'no_label' AS side FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL GROUP BY ALL
UNION ALL SELECT l.doc_id, 'no_event' FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL GROUP BY ALL""")
def jn2(spark, sf):
    return sessions.reconcile(table(spark, sf, "documents").select(F.col("doc_id").alias("block_id")), table(spark, sf, "labels").select(F.col("doc_id").alias("block_id")))


@query("jn10_positional_zip", """
SELECT aligned, count(*) AS n FROM (
  SELECT a.event_id IS NOT NULL AND b.event_id IS NOT NULL AND a.event_type IS NOT DISTINCT FROM b.event_type AS aligned
  FROM (SELECT * FROM events WHERE event_id % 7 <> 0) a FULL JOIN (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE event_type END AS event_type FROM events WHERE event_id % 5 <> 0) b USING (event_id)) GROUP BY aligned""")
def jn10(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("line_id"), "event_type")
    right = e.filter("line_id % 5 <> 0").withColumn("event_type", F.when(F.col("line_id") % 11 == 0, "x").otherwise(F.col("event_type")))
    return sessions.zip_positional(e.filter("line_id % 7 <> 0"), right, "line_id", ("event_type",)).groupBy("aligned").agg(F.count(F.lit(1)).alias("n"))


@query("so5_offending_samples", with_sql("""
SELECT ordinal, lv AS reason, row_number() OVER (PARTITION BY lv ORDER BY ordinal) AS nth FROM tr QUALIFY nth <= 10"""))
def so5(spark, sf):
    return sessions.offending_samples(adapted(spark, sf).select("ordinal", fx.level(F.col("level")).alias("reason")), order="ordinal")


@query("wn15_increasing_keys", "SELECT count(*) AS n FROM (SELECT event_id, lag(event_id) OVER (ORDER BY ts, event_id) AS b FROM events) WHERE event_id <= b")
def wn15(spark, sf):
    return readers.strictly_increasing(table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")), "event_id", "o").agg(F.count(F.lit(1)).alias("n"))


# --- text functions


@query("fn24_trace_identity", with_sql("SELECT analysis_trace_id_source, count(*) AS n, count(DISTINCT analysis_trace_id) AS ids FROM tr GROUP BY 1"))
def fn24(spark, sf):
    return sessions.assign_trace(adapted(spark, sf)).groupBy("analysis_trace_id_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("analysis_trace_id").alias("ids"))


@query("fn1_parse_header", r"""
WITH l AS (SELECT event_id, concat(strftime(ts, '%y%m%d %H%M%S'), ' ', user_id, ' ', CASE WHEN event_type = 'error' THEN 'warn' ELSE 'INFO' END, ' dfs.', event_type, ': took ', event_id) AS line FROM events)
SELECT event_id, CAST(regexp_extract(line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s?(.*)$', 3) AS INT) AS pid, trim(regexp_extract(line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s?(.*)$', 5)) AS component,
  regexp_extract(line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s?(.*)$', 6) AS content, '20' || substr(line, 1, 2) || '-' || substr(line, 3, 2) || '-' || substr(line, 5, 2) || 'T' || substr(line, 8, 2) || ':' || substr(line, 10, 2) || ':' || substr(line, 12, 2) AS iso
FROM l WHERE regexp_matches(line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s?(.*)$')""")
def fn1(spark, sf):
    l = table(spark, sf, "events").selectExpr("event_id", "concat(date_format(ts, 'yyMMdd HHmmss'), ' ', user_id, ' ', CASE WHEN event_type = 'error' THEN 'warn' ELSE 'INFO' END, ' dfs.', event_type, ': took ', event_id) AS line")
    return l.withColumn("p", fx.parse_log_line(F.col("line"))).filter("p is not null").select("event_id", "p.pid", "p.component", "p.content", fx.iso_timestamp(F.col("p.date"), F.col("p.time")).alias("iso"))


@query("fn3_block_ids", r"""
SELECT event_id, list_distinct_ordered AS ids, n FROM (
 SELECT event_id, concat('blk_', user_id, '|', 'blk_-', event_id % 7) AS list_distinct_ordered, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS n FROM events)""")
def fn3(spark, sf):
    c = F.expr("concat('copy blk_', user_id, ' to blk_-', event_id % 7, CASE WHEN event_id % 3 = 0 THEN concat(' blk_', user_id) ELSE '' END)")
    return table(spark, sf, "events").select("event_id", F.array_join(fx.block_ids(c), "|").alias("ids"), F.size(fx.block_mentions(c)).alias("n"))


#: Messages of eight shapes, as both dialects spell them: octets past 255, words around ids, ports followed by a colon, a dot, a letter.
_MASKED = """concat(CASE event_id % 8 WHEN 0 THEN 'Received blk_' || event_id WHEN 1 THEN 'xblk_' || event_id WHEN 2 THEN 'blk_-' || event_id || '_x' WHEN 3 THEN '10.0.' || (event_id % 300) || '.1:50010:Transmitted blk_' || event_id
  WHEN 4 THEN 'job_200811092030_' || lpad(CAST(event_id % 10000 AS VARCHAR(9)), 4, '0') WHEN 5 THEN '/sys/job_200811092030_' || lpad(CAST(event_id % 10000 AS VARCHAR(9)), 4, '0') || '/job.jar' WHEN 6 THEN '/10.1.' || (event_id % 300) || '.7' ELSE 'v1.2.3.4' END,
  CASE user_id % 4 WHEN 0 THEN ' src: /10.' || (user_id % 300) || '.0.1:' || user_id || ' dest: /10.0.0.1:50010' WHEN 1 THEN ' to 10.1.2.' || (user_id % 300) || ':80.5' WHEN 2 THEN ' at 10.1.2.' || (user_id % 300) || ':80' ELSE ' wrote /data/u' || user_id || '/part' END)"""
_JOB = "'job_200811092030_' || lpad(CAST(event_id % 10000 AS VARCHAR(9)), 4, '0')"


def _masked(mask: str) -> str:
    """What the masks make of these messages, shape by shape."""
    ip = lambda cond, yes, no: f"CASE WHEN {cond} THEN {yes} ELSE {no} END"
    ports, jobs, paths = mask != "a", mask in "cd", mask == "d"
    first = {0: "'Received <BLOCK_ID>'", 1: "'xblk_' || event_id", 2: "'blk_-' || event_id || '_x'", 7: "'v1.2.3.4'"}
    first[3] = ip("event_id % 300 < 256", "'<IP>:50010:Transmitted <BLOCK_ID>'", "'10.0.' || (event_id % 300) || '.1:50010:Transmitted <BLOCK_ID>'") if ports else "'10.0.' || (event_id % 300) || '.1:50010:Transmitted <BLOCK_ID>'"
    first[4] = "'<JOB_ID>'" if jobs else _JOB
    first[5] = "'<PATH>'" if paths else "'/sys/<JOB_ID>/job.jar'" if jobs else f"'/sys/' || {_JOB} || '/job.jar'"
    first[6] = ip("event_id % 300 < 256", "'/<IP>'", "'/10.1.' || (event_id % 300) || '.7'") if paths else "'/10.1.' || (event_id % 300) || '.7'"
    last = {0: ip("user_id % 300 < 256", "' src: /<IP>:' || user_id || ' dest: /<IP>:50010'", "' src: /10.' || (user_id % 300) || '.0.1:' || user_id || ' dest: /<IP>:50010'"), 1: "' to 10.1.2.' || (user_id % 300) || ':80.5'"}
    last[2] = ip("user_id % 300 < 256", "' at <IP>:80'", "' at 10.1.2.' || (user_id % 300) || ':80'") if ports else "' at 10.1.2.' || (user_id % 300) || ':80'"
    last[3] = "' wrote <PATH>'" if paths else "' wrote /data/u' || user_id || '/part'"
    case = lambda x, shapes: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(shapes.items())) + " END"
    return f"concat({case('event_id % 8', first)}, {case('user_id % 4', last)}) AS masked_{mask}"


@query("fn5_masks", f"SELECT event_id, {', '.join(map(_masked, 'abcd'))} FROM events")
def fn5(spark, sf):
    m = F.expr(_MASKED)
    return table(spark, sf, "events").select("event_id", *[fx.MASKS[k.upper()](m).alias(f"masked_{k}") for k in "abcd"])


@query("fn8_mask_paths", "SELECT event_id, concat('job <JOB_ID> at /<IP> wrote <PATH> of ', user_id) AS masked FROM events")
def fn8(spark, sf):
    m = F.expr("concat('job job_200811092030_', lpad(event_id % 10000, 4, '0'), ' at /10.1.', user_id % 256, '.7 wrote /data/u', user_id, '/part-', event_id, ' of ', user_id)")
    return table(spark, sf, "events").select("event_id", fx.mask_d(m).alias("masked"))


@query("fn9_prepare_message", with_sql(r"""
, m AS (SELECT ordinal, regexp_replace(trim(message), '(\d{1,3}\.){3}\d{1,3}', '<IP>', 'g') AS m FROM ev)
SELECT ordinal, regexp_replace(m, '\b\d+\b', '<NUM>', 'g') AS prepared FROM m"""))
def fn9(spark, sf):
    return adapted(spark, sf).select("ordinal", fx.prepare_message(F.col("message")).alias("prepared"))


@query("fn10_prepare_variants")
def fn10(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[F.sha2(fx.prepare_message(F.col("text"), v), 256).alias(v) for v in ("current", "temporal", "aggressive")])


@query("fn12_anonymize")
def fn12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(fx.anonymize_text(F.col("text"), "salt"), 256).alias("anonymized_sha256"))


@query("fn11_stable_token", "SELECT user_id, '<USER_' || left(sha256('s' || chr(0) || 'USER' || chr(0) || user_id), 20) || '>' AS token FROM events GROUP BY user_id")
def fn11(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", fx.stable_token("USER", F.col("user_id").cast("string"), "s").alias("token"))


@query("fn13_sequential_tokens", with_sql("""
, f AS (SELECT tc_user, min(ordinal) AS first FROM ev GROUP BY 1) SELECT tc_user, '<USER_' || row_number() OVER (ORDER BY first) || '>' AS token FROM f"""))
def fn13(spark, sf):
    return sessions.sequential_tokens(adapted(spark, sf), "tc_user", "ordinal", "USER").withColumnRenamed("value", "tc_user")


@query("fn16_tokens", r"""
SELECT doc_id, len(regexp_extract_all(text, '<(?:BLOCK_ID|JOB_ID|IP|PATH|\*)>|[A-Za-z0-9_]+(?:[.$:-][A-Za-z0-9_]+)*\*?')) AS tokens FROM documents""")
def fn16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(fx.tokenize(F.col("text"))).cast("long").alias("tokens"))


@query("fn17_line_ngrams", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, len(regexp_extract_all(line, '<(?:BLOCK_ID|JOB_ID|IP|PATH|\*)>|[A-Za-z0-9_]+(?:[.$:-][A-Za-z0-9_]+)*\*?')) AS n FROM l)
SELECT doc_id, CAST(sum(n + greatest(n - 1, 0)) AS BIGINT) AS grams FROM t GROUP BY doc_id""")
def fn17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(fx.analyze_document(F.col("text"))).cast("long").alias("grams"))


@query("fn18_normalize", with_sql(r"SELECT ordinal, left(regexp_replace(message, '\d+', 'N', 'g'), 80) AS pattern, 'Log' || right(logger_name, 1) AS logger, stack_trace AS head FROM ev"))
def fn18(spark, sf):
    return adapted(spark, sf).select("ordinal", fx.normalize_message(F.col("message")).alias("pattern"), fx.short_logger(F.col("logger_name")).alias("logger"), fx.exception_head(F.col("stack_trace")).alias("head"))


@query("fn21_parse_ts", with_sql("SELECT ordinal, epoch_us(CAST(timestamp AS TIMESTAMP)) AS us FROM ev"))
def fn21(spark, sf):
    return adapted(spark, sf).select("ordinal", F.unix_micros(fx.parse_ts(F.concat("timestamp", F.lit(".0000000Z")))).alias("us"))


@query("fn22_terms", with_sql("SELECT count(*) FILTER (message LIKE '%timeout%') AS timeout, count(*) FILTER (stack_trace LIKE '%failed%') AS failed, count(*) FILTER (stack_trace LIKE '%exception%') AS exception FROM ev"))
def fn22(spark, sf):
    return adapted(spark, sf).agg(F.count_if(fx.has_term(F.col("message"), "timeout")).alias("timeout"), F.count_if(fx.has_term(F.col("stack_trace"), "failed")).alias("failed"), F.count_if(fx.has_term(F.col("stack_trace"), "exception")).alias("exception"))


@query("fn25_call_stacks", with_sql(r"""
SELECT ordinal, array_to_string(list_sort(list_distinct(regexp_extract_all(tc_trace_call_stack, '\):([A-Za-z0-9_-]+)/', 1))), '|') AS services,
 CAST((length(tc_trace_call_stack) - length(replace(tc_trace_call_stack, '):' || tc_service || '/', ''))) / length('):' || tc_service || '/') AS INT) AS hits FROM ev"""))
def fn25(spark, sf):
    return adapted(spark, sf).select("ordinal", F.array_join(F.array_sort(fx.call_stack_services(F.col("tc_trace_call_stack"))), "|").alias("services"), fx.call_stack_hits(F.col("tc_trace_call_stack"), F.col("tc_service")).alias("hits"))


@query("fn26_explicit", with_sql(r"SELECT ordinal, regexp_extract(message, 'serviceStarted\s*[:=]\s*([A-Za-z0-9_.-]+)', 1) AS component FROM ev"))
def fn26(spark, sf):
    return adapted(spark, sf).select("ordinal", fx.explicit_component(F.col("message")).alias("component"))


@query("fn31_codecs", with_sql("SELECT count(*) AS traces, count(*) AS same FROM (SELECT DISTINCT analysis_trace_id FROM tr)"))
def fn31(spark, sf):
    h = sessions.template_histogram(sessions.assign_trace(adapted(spark, sf)))
    back = F.map_entries(fx.decode_counts(F.col("template_counts")))
    return h.agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.array_sort(back) == F.array_sort(F.map_entries("counts"))).alias("same"))


@query("fn33_evidence_score", """
SELECT doc_id, CAST(text <> '' AS INT) + CAST(contains(lower(text), 'the') AS INT) AS score, CAST(trim(text) <> '' AS INT) + CAST(trim(lang) <> '' AS INT) AS filled FROM documents""")
def fn33(spark, sf):
    clean = F.regexp_replace("text", r"[0-9:]", "")
    return table(spark, sf, "documents").select("doc_id", fx.justification_score(F.lit("the"), clean).alias("score"), fx.completeness(F.col("text"), F.col("lang")).alias("filled"))


# --- sessions and traces


@query("ag3_trace_index", with_sql("""
SELECT analysis_trace_id, CASE WHEN count(DISTINCT analysis_trace_id_source) > 1 THEN 'mixed' ELSE min(analysis_trace_id_source) END AS analysis_trace_id_source, count(*) AS event_count,
  min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, CAST(count(DISTINCT nullif(tc_service, '')) AS INT) AS service_count,
  coalesce(string_agg(DISTINCT nullif(tc_service, ''), '|' ORDER BY nullif(tc_service, '')), '') AS services,
  count(*) FILTER (lv = 'INFO') AS info_count, count(*) FILTER (lv = 'WARN') AS warn_count, count(*) FILTER (lv = 'ERROR') AS error_count, count(*) FILTER (lv NOT IN ('INFO', 'WARN', 'ERROR')) AS other_count,
  count(*) FILTER (stack_trace <> '') AS stack_trace_count, min(ordinal) AS first_event_ordinal, max(ordinal) AS last_event_ordinal
FROM tr WHERE analysis_trace_id <> '' GROUP BY 1"""))
def ag3(spark, sf):
    return sessions.trace_index(traced(spark, sf))


_FEATURES = """
, f AS (SELECT trim(tc_trace_id) AS tc_trace_id, count(*) AS event_count, count(*) FILTER (lv = 'INFO') AS info_count, count(*) FILTER (lv = 'WARN') AS warn_count, count(*) FILTER (lv = 'ERROR') AS error_count,
  count(*) FILTER (lv NOT IN ('INFO', 'WARN', 'ERROR')) AS other_count, CAST(max(CASE WHEN stack_trace <> '' THEN 1 ELSE 0 END) AS INT) AS has_stack_trace, count(DISTINCT nullif(tc_service, '')) AS service_count,
  CAST(0 AS INT) AS has_exception_term, CAST(max(CASE WHEN stack_trace LIKE '%failed%' THEN 1 ELSE 0 END) AS INT) AS has_failed_term, CAST(max(CASE WHEN message LIKE '%timeout%' THEN 1 ELSE 0 END) AS INT) AS has_timeout_term, CAST(0 AS INT) AS has_error_term
  FROM tr WHERE trim(tc_trace_id) <> '' GROUP BY 1),
g AS (SELECT *, error_count / event_count AS error_rate, warn_count / event_count AS warn_rate, has_failed_term + has_timeout_term AS text_signal_count,
  CAST(error_count > 0 OR warn_count > 0 OR has_stack_trace > 0 OR has_failed_term + has_timeout_term > 0 AS INT) AS has_any_signal FROM f)"""


@query("ag4_trace_features", with_sql(_FEATURES + "SELECT * FROM g"))
def ag4(spark, sf):
    return sessions.trace_features(adapted(spark, sf))


_PROFILE = """coalesce(nullif(concat_ws('+', CASE WHEN error_count > 0 THEN 'ERROR' END, CASE WHEN warn_count > 0 THEN 'WARN' END, CASE WHEN has_stack_trace > 0 THEN 'STACK_TRACE' END, CASE WHEN text_signal_count > 0 THEN 'TEXT' END), ''), 'NONE')"""


@query("ag19_profiles", with_sql(_FEATURES + f"SELECT {_PROFILE} AS signal_profile, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM g GROUP BY 1"))
def ag19(spark, sf):
    return sessions.value_counts(sessions.extra_features(sessions.trace_features(adapted(spark, sf))), "signal_profile")


@query("ag20_combinations", with_sql(_FEATURES + "SELECT has_stack_trace, has_any_signal, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM g GROUP BY 1, 2"))
def ag20(spark, sf):
    return sessions.value_counts(sessions.trace_features(adapted(spark, sf)), "has_stack_trace", "has_any_signal")


@query("ag5_level_coverage", with_sql("""
, p AS (SELECT bool_or(lv = 'ERROR') AS e, bool_or(lv = 'WARN') AS w, bool_and(lv = 'INFO') AS i FROM tr WHERE analysis_trace_id <> '' GROUP BY analysis_trace_id)
SELECT count(*) AS traces, count(*) FILTER (e) AS with_error, count(*) FILTER (w) AS with_warn, count(*) FILTER (i) AS only_info FROM p"""))
def ag5(spark, sf):
    return sessions.level_coverage(traced(spark, sf))


@query("ag6_template_histogram", with_sql("""
, c AS (SELECT analysis_trace_id, template_id, count(*) AS n FROM tr WHERE analysis_trace_id <> '' GROUP BY 1, 2)
SELECT analysis_trace_id, string_agg(template_id || ':' || n, ' ' ORDER BY template_id) AS template_counts FROM c GROUP BY 1"""))
def ag6(spark, sf):
    return sessions.template_histogram(traced(spark, sf)).select("analysis_trace_id", "template_counts")


@query("ag7_count_vector", with_sql("""
SELECT analysis_trace_id AS block_id, count(*) AS length, """ + ", ".join(f"count(*) FILTER (template_id = {i})" + f" AS t{i}" for i in range(1, 9)) + """, count(*) FILTER (template_id = 0) AS unk FROM tr WHERE analysis_trace_id <> '' GROUP BY 1"""))
def ag7(spark, sf):
    v = sessions.count_vector(traced(spark, sf).withColumnRenamed("analysis_trace_id", "block_id"), 8)
    return v.select("block_id", "length", *[F.col("counts")[i - 1].alias(f"t{i}") for i in range(1, 9)], F.col("counts")[8].alias("unk"))


@query("src10_check_counts", "SELECT CAST(0 AS BIGINT) AS bad")
def src10(spark, sf):
    return sessions.check_counts(sessions.count_vector(traced(spark, sf).withColumnRenamed("analysis_trace_id", "block_id"), 8)).agg(F.count(F.lit(1)).alias("bad"))


@query("ag8_sequences", "SELECT conv_id, CAST(count(*) AS INT) AS length, string_agg(CASE WHEN role = 'user' THEN '1' ELSE '0' END, ' ' ORDER BY turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS sequence FROM conversations GROUP BY conv_id")
def ag8(spark, sf):
    return sessions.sequences(table(spark, sf, "conversations").withColumn("template_id", (F.col("role") == "user").cast("int")), "conv_id", "turn")


@query("ml6_session_documents", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS document, count(*) AS length, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS document_hash FROM conversations GROUP BY conv_id")
def ml6(spark, sf):
    return sessions.session_documents(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("jn11_expand_sequences", with_sql("""
SELECT analysis_trace_id AS block_id, CAST(row_number() OVER (PARTITION BY analysis_trace_id ORDER BY ordinal) - 1 AS INT) AS pos, template_id AS id, CASE WHEN template_id = 0 THEN message ELSE 'template ' || template_id END AS text FROM tr WHERE analysis_trace_id <> ''"""))
def jn11(spark, sf):
    e = traced(spark, sf).withColumnRenamed("analysis_trace_id", "block_id")
    ids = e.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "template_id"))), lambda x: x["template_id"]).alias("ids"))
    names = spark.range(1, 9).select(F.col("id").cast("int").alias("template_id"), F.concat(F.lit("template "), F.col("id")).alias("template"))
    return sessions.expand_sequences(ids, names, e.filter("template_id = 0").select("block_id", F.col("ordinal").alias("line_id"), F.col("message").alias("text")))


@query("jn1_assign_split", """
SELECT status, count(*) AS n, count(*) FILTER (tn) AS train_normal FROM (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'unassigned' WHEN user_id % 3 = 1 THEN (CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'assigned' END) ELSE 'ambiguous' END AS status,
    coalesce(user_id % 3 = 1 AND l.toxic = 0 AND l.quality = 1, false) AS tn
  FROM events e LEFT JOIN labels l ON e.user_id = l.doc_id) GROUP BY 1""")
def jn1(spark, sf):
    e = table(spark, sf, "events").withColumn("block_ids", F.expr("CASE user_id % 3 WHEN 0 THEN array() WHEN 1 THEN array(user_id, user_id) ELSE array(user_id, -1L) END"))
    s = table(spark, sf, "labels").select(F.col("doc_id").alias("block_id"), F.when(F.col("toxic") == 0, "Normal").otherwise("Anomaly").alias("label"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return sessions.assign_split(e, s).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_train_normal").alias("train_normal"))


# --- splits and samples


_SPLIT = """
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('salt' || chr(0) || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY toxic) AS n FROM labels),
a AS (SELECT *, CAST(floor(n * 70 / 100.0) AS BIGINT) AS t0, CAST(floor(n * 15 / 100.0) AS BIGINT) AS v0, (n * 70) % 100 AS rt, (n * 15) % 100 AS rv FROM r),
b AS (SELECT *, n - t0 - 2 * v0 AS left_over FROM a),
c AS (SELECT *, CASE WHEN left_over >= 1 AND rt >= rv THEN 1 WHEN left_over >= 3 THEN 1 ELSE 0 END AS et, CASE WHEN rt >= rv THEN (CASE WHEN left_over >= 2 THEN 1 ELSE 0 END) ELSE (CASE WHEN left_over >= 1 THEN 1 ELSE 0 END) END AS ev FROM b)
SELECT doc_id, toxic, CASE WHEN rk <= t0 + et THEN 'train' WHEN rk <= t0 + et + v0 + ev THEN 'validation' ELSE 'test' END AS split FROM c"""


@query("wn1_stratified_split", _SPLIT)
def wn1(spark, sf):
    return split.stratified_split(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", "salt")


@query("ag15_contingency", f"SELECT split, count(*) FILTER (toxic = 0) AS normal, count(*) FILTER (toxic = 1) AS toxic FROM ({_SPLIT}) GROUP BY split")
def ag15(spark, sf):
    return split.contingency(wn1(spark, sf), "split", "toxic", (0, 1)).select("split", F.col("0").alias("normal"), F.col("1").alias("toxic"))


@query("st4_same_ids", "SELECT CAST(0 AS BIGINT) AS differing")
def st4(spark, sf):
    return split.same_ids(wn1(spark, sf), table(spark, sf, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("differing"))


@query("wn14_sample_traces", with_sql("""
, s AS (SELECT analysis_trace_id, count(*) AS n FROM tr WHERE analysis_trace_id <> '' GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha256('seed' || chr(0) || analysis_trace_id), analysis_trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT analysis_trace_id, n FROM o WHERE before < 100"""))
def wn14(spark, sf):
    return split.sample_traces(traced(spark, sf).groupBy("analysis_trace_id").agg(F.count(F.lit(1)).alias("n")), "analysis_trace_id", "n", 100, "seed")


@query("sp3_sample_per_group", with_sql("SELECT ordinal, lv FROM tr QUALIFY row_number() OVER (PARTITION BY lv ORDER BY sha256('sample' || chr(0) || ordinal), ordinal) <= 8"))
def sp3(spark, sf):
    return split.sample_per_group(adapted(spark, sf).select("ordinal", fx.level(F.col("level")).alias("lv")), "lv", "ordinal", 8)


@query("sp5_sample_hash", "SELECT doc_id FROM labels ORDER BY sha256('sample' || chr(0) || doc_id), doc_id LIMIT 50")
def sp5(spark, sf):
    return split.sample_hash(table(spark, sf, "labels").select("doc_id"), "doc_id", 50)


@query("sp4_holdout", """
SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('1' || chr(0) || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY toxic) * 0.3, 0) AS holdout FROM labels""")
def sp4(spark, sf):
    return split.hash_holdout(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", F.col("toxic"), "1")


@query("wn13_evenly", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE i IN (SELECT CAST(round_even(j * (n - 1) / 9.0, 0) AS BIGINT) FROM (SELECT max(n) AS n FROM r), range(10) t(j))""")
def wn13(spark, sf):
    return split.evenly_select(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 10, "doc_id").select("doc_id")


# --- calibration

_SCORES = "s AS (SELECT doc_id, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 + toxic * 0.25::DOUBLE AS score, toxic = 1 AS t FROM labels)"


def scored(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id", "cast((doc_id * 7919) % 1000 as double) / 1000 + toxic * 0.25D AS score", "toxic = 1 AS t")


_TABLE = f"""WITH {_SCORES}, p AS (SELECT score, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS q FROM s GROUP BY 1),
c AS (SELECT score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pp, CAST(sum(q) OVER () AS BIGINT) AS nn FROM p WINDOW w AS (ORDER BY score DESC)),
m AS (SELECT threshold, tp, nn - fp AS tn, fp, pp - tp AS fn, tp / (tp + fp) AS precision, tp / pp AS recall, (nn - fp) / nn AS specificity, 2 * tp / (2 * tp + fp + pp - tp) AS f1 FROM c)"""


@query("wn9_threshold_table", _TABLE + " SELECT * FROM m")
def wn9t(spark, sf):
    return calibrate.threshold_table(scored(spark, sf), "score", F.col("t"))


@query("wn9_best_threshold", _TABLE + " SELECT threshold, tp, fp, fn, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS f1 FROM m ORDER BY m.f1 DESC, threshold DESC LIMIT 1")
def wn9(spark, sf):
    return calibrate.best_threshold(scored(spark, sf), "score", F.col("t"))


@query("wn9_best_threshold_rounded", _TABLE + """
, l AS (SELECT list_prepend({threshold: -1.0::DOUBLE, tp: 0::BIGINT, fp: 0::BIGINT, fn: 0::BIGINT, precision: 0.0::DOUBLE, recall: 0.0::DOUBLE, f1: -1.0::DOUBLE},
  list({threshold: threshold::DOUBLE, tp: tp::BIGINT, fp: fp::BIGINT, fn: fn::BIGINT, precision: precision::DOUBLE, recall: recall::DOUBLE, f1: coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE} ORDER BY threshold DESC)) AS l FROM m),
b AS (SELECT list_reduce(l, lambda a, x: CASE WHEN x.f1 > a.f1 THEN {threshold: x.threshold, tp: x.tp, fp: x.fp, fn: x.fn, precision: x.precision, recall: x.recall, f1: round_even(x.f1, 4)} ELSE a END) AS b FROM l)
SELECT b.threshold AS threshold, b.tp AS tp, b.fp AS fp, b.fn AS fn, round_even(b.precision, 4) AS precision, round_even(b.recall, 4) AS recall, b.f1 AS f1 FROM b""")
def wn9r(spark, sf):
    return calibrate.best_threshold_rounded(scored(spark, sf), "score", F.col("t"))


@query("wn10_min_recall", _TABLE + " SELECT * FROM m WHERE recall >= 0.9 ORDER BY precision DESC, f1 DESC, specificity DESC, threshold LIMIT 1")
def wn10(spark, sf):
    return calibrate.min_recall_threshold(scored(spark, sf), "score", F.col("t"))


@query("wn11_average_precision", _TABLE + " SELECT round(sum(d * precision), 9) AS average_precision FROM (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS d FROM m)")
def wn11(spark, sf):
    return calibrate.average_precision(scored(spark, sf), "score", F.col("t")).select(F.round("average_precision", 9).alias("average_precision"))


@query("ag14_confusion", f"""WITH {_SCORES}, c AS (SELECT count(*) AS n, count(*) FILTER (t AND score >= 0.7) AS tp, count(*) FILTER (NOT t AND score < 0.7) AS tn, count(*) FILTER (NOT t AND score >= 0.7) AS fp, count(*) FILTER (t AND score < 0.7) AS fn FROM s)
SELECT n, tp, tn, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + fp) / n AS coverage FROM c""")
def ag14(spark, sf):
    return calibrate.confusion(scored(spark, sf), F.col("t"), F.col("score") >= 0.7)


@query("ml19_alert_levels", f"WITH {_SCORES} SELECT CASE WHEN score >= 0.7 AND doc_id % 2 = 0 THEN 'high_confidence' WHEN score >= 0.7 THEN 'review' ELSE 'none' END AS alert_level, CAST(score >= 0.7 AS INT) AS score_alert, count(*) AS n FROM s GROUP BY 1, 2")
def ml19(spark, sf):
    return calibrate.alert_levels(scored(spark, sf), "score", 0.7, F.col("doc_id") % 2 == 0).groupBy("alert_level", "score_alert").agg(F.count(F.lit(1)).alias("n"))


_LENGTHS = """
WITH s AS (SELECT (len(string_split(text, chr(10)))) AS length, doc_id % 9 = 0 AS u, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)),
g AS (SELECT 'length' AS rule, L, length <= L AS p, t FROM s, range(2, 51) x(L) UNION ALL SELECT 'length_or_unknown', L, u OR length <= L, t FROM s, range(2, 51) x(L)),
c AS (SELECT rule, CAST(L AS INT) AS L, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM g GROUP BY 1, 2),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("length"))
    return d.join(table(spark, sf, "labels"), "doc_id").select("length", (F.col("doc_id") % 9 == 0).cast("int").alias("unk"), (F.col("toxic") == 1).alias("t"))


@query("ml14_length_baselines", _LENGTHS + " SELECT * FROM m")
def ml14(spark, sf):
    return calibrate.length_baselines(lengths(spark, sf), F.col("t"))


@query("ml14_best_length", _LENGTHS + " SELECT rule, L, tp, fp, fn, round_even(f1, 4) AS f1 FROM m QUALIFY row_number() OVER (PARTITION BY rule ORDER BY round_even(m.f1, 4) DESC, L) = 1")
def ml14b(spark, sf):
    return calibrate.best_length(ml14(spark, sf))


@query("ml16_rules", with_sql(_FEATURES + """
, y AS (SELECT *, length(tc_trace_id) % 2 = 0 AS t FROM g),
r AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS rule, ({e}) AS p, t FROM y" for n, e in calibrate.RULES.items()) + """),
c AS (SELECT rule, count(*) AS n, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM r GROUP BY 1)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS coverage FROM c"""))
def ml16(spark, sf):
    return calibrate.score_rules(sessions.trace_features(adapted(spark, sf)), F.length("tc_trace_id") % 2 == 0)


@query("ml17_threshold_stability")
def ml17(spark, sf):
    s = scored(spark, sf).withColumn("label", F.when(F.col("t"), calibrate.POSITIVE).otherwise(calibrate.NEGATIVE))
    return calibrate.threshold_summary(calibrate.threshold_stability(s, "doc_id", "score", "label", (1, 2, 3, 4, 5)))


@query("ag17_describe", """
SELECT 'n_chars' AS "column", count(n_chars) AS count, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, CAST(max(n_chars) AS DOUBLE) AS max FROM documents""")
def ag17(spark, sf):
    return calibrate.describe(table(spark, sf, "documents"), ["n_chars"])


@query("ag18_correlations", with_sql(_FEATURES + """
SELECT 'event_count' AS a, 'error_count' AS b, round(corr(event_count, error_count), 9) AS corr FROM g UNION ALL SELECT 'event_count', 'service_count', round(corr(event_count, service_count), 9) FROM g UNION ALL SELECT 'error_count', 'service_count', round(corr(error_count, service_count), 9) FROM g"""))
def ag18(spark, sf):
    return calibrate.correlations(sessions.trace_features(adapted(spark, sf)), ["event_count", "error_count", "service_count"]).withColumn("corr", F.round("corr", 9))


@query("ag16_length_percentiles", """
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CAST(p AS INT) AS percent, n_chars AS value FROM r, (VALUES (25), (50), (90), (95), (99)) t(p) WHERE r = greatest(1, round_even(p * n / 100.0, 0))""")
def ag16(spark, sf):
    return features.nearest_rank(table(spark, sf, "documents"), "n_chars", (25, 50, 90, 95, 99), ["lang"])


# --- localisation and causes

_ALERTS = """, al AS (SELECT analysis_trace_id, CASE WHEN count(*) FILTER (lv = 'ERROR') > 1 THEN 'high_confidence' WHEN count(*) FILTER (lv IN ('ERROR', 'WARN')) > 0 THEN 'review' ELSE 'none' END AS alert_level,
  CAST(count(*) FILTER (lv = 'ERROR') AS DOUBLE) / count(*) AS anomaly_score FROM tr WHERE analysis_trace_id <> '' GROUP BY 1),
aev AS (SELECT tr.* FROM tr JOIN al USING (analysis_trace_id) WHERE alert_level <> 'none'),
st AS (SELECT analysis_trace_id, coalesce(nullif(tc_service, ''), '<unknown_service>') AS tc_service, count(*) AS service_events, count(*) FILTER (lv = 'ERROR') AS service_errors, count(*) FILTER (lv = 'WARN') AS service_warns,
  count(DISTINCT template_id) AS service_unique_templates, min(ordinal) AS first_event_ordinal FROM aev GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY analysis_trace_id ORDER BY service_errors DESC, service_unique_templates DESC, service_events DESC, first_event_ordinal, tc_service) AS INT) AS candidate_rank FROM st)"""


def alerts_of(events: DataFrame) -> DataFrame:
    lv = fx.level(F.col("level"))
    level = F.when(F.count_if(lv == "ERROR") > 1, "high_confidence").when(F.count_if(lv.isin("ERROR", "WARN")) > 0, "review").otherwise("none")
    return events.groupBy("analysis_trace_id").agg(level.alias("alert_level"), (F.count_if(lv == "ERROR").cast("double") / F.count(F.lit(1))).alias("anomaly_score")).withColumn("manual_label", F.lit(""))


def ranked_services(spark, sf):
    e = traced(spark, sf)
    return localize.rank_services(localize.service_stats(localize.of_alerts(e, alerts_of(e))))


@query("wn3_service_ranking", with_sql(_ALERTS + "SELECT * FROM rk"))
def wn3(spark, sf):
    return ranked_services(spark, sf)


@query("so8_top_candidates", with_sql(_ALERTS + "SELECT analysis_trace_id, " + ", ".join(f"coalesce(max(tc_service) FILTER (candidate_rank = {i}), '') AS top_candidate_{i}" for i in (1, 2, 3)) + " FROM rk GROUP BY 1"))
def so8(spark, sf):
    return localize.top_columns(ranked_services(spark, sf), "analysis_trace_id", "tc_service", "candidate_rank")


@query("ml20_hypotheses", with_sql(_ALERTS + r"""
, ex AS (SELECT analysis_trace_id, ordinal, regexp_extract(message, 'serviceStarted\s*[:=]\s*([A-Za-z0-9_.-]+)', 1) AS x, message FROM aev),
e1 AS (SELECT * FROM ex WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY analysis_trace_id ORDER BY ordinal) = 1),
f1 AS (SELECT * FROM aev QUALIFY row_number() OVER (PARTITION BY analysis_trace_id ORDER BY ordinal) = 1),
r1 AS (SELECT * FROM aev WHERE lv = 'ERROR' QUALIFY row_number() OVER (PARTITION BY analysis_trace_id ORDER BY ordinal) = 1)
SELECT al.analysis_trace_id, al.alert_level, al.anomaly_score, '' AS manual_label,
  CASE WHEN e1.x IS NOT NULL THEN e1.x WHEN r1.ordinal IS NOT NULL THEN r1.tc_service WHEN coalesce(rk.tc_service, '') <> '' THEN rk.tc_service ELSE f1.tc_service END AS hypothesis_service,
  CASE WHEN e1.x IS NOT NULL THEN 'explicit_logical_component' WHEN r1.ordinal IS NOT NULL THEN 'first_error_service' WHEN coalesce(rk.tc_service, '') <> '' THEN 'candidate_service_top1' ELSE 'entry_service' END AS hypothesis_source,
  coalesce(rk.tc_service, '') AS candidate_service_top1, coalesce(r1.tc_service, '') AS first_error_service, f1.tc_service AS entry_service, coalesce(e1.x, '') AS explicit_logical_component,
  coalesce(e1.ordinal, r1.ordinal, f1.ordinal) AS evidence_event_ordinal, CASE WHEN e1.x IS NOT NULL THEN '' ELSE coalesce(r1.lv, f1.lv) END AS evidence_level, coalesce(e1.message, r1.message, f1.message) AS evidence_message,
  'hipótese baseada em evidência do trace; não prova causalidade' AS limitation
FROM al JOIN f1 USING (analysis_trace_id) LEFT JOIN e1 USING (analysis_trace_id) LEFT JOIN r1 USING (analysis_trace_id) LEFT JOIN rk ON rk.analysis_trace_id = al.analysis_trace_id AND candidate_rank = 1
WHERE al.alert_level <> 'none'"""))
def ml20(spark, sf):
    e = traced(spark, sf)
    return cause.hypotheses(alerts_of(e), e, ranked_services(spark, sf))


@query("so6_examples")
def so6(spark, sf):
    return cause.pick_examples(alerts_of(traced(spark, sf)), ml20(spark, sf)).select("rule_no", "selection_reason", "analysis_trace_id", "alert_level", "hypothesis_source")


@query("ag29_coverage", with_sql("SELECT 'message' AS field, count(*) AS present, count(*) AS total, 1.0::DOUBLE AS rate FROM ev UNION ALL SELECT 'stack_trace', count(*) FILTER (stack_trace <> ''), count(*), count(*) FILTER (stack_trace <> '') / count(*) FROM ev"))
def ag29(spark, sf):
    return cause.coverage(adapted(spark, sf), ["message", "stack_trace"])


_SIGNALS = r""", sg AS (SELECT analysis_trace_id AS tc_trace_id, coalesce(nullif(tc_service, ''), '<UNKNOWN_SERVICE>') AS service, lv, stack_trace <> '' AS stack, message LIKE '%timeout%' OR stack_trace LIKE '%failed%' AS text, timestamp AS ts, ordinal AS o, tc_trace_call_stack AS cs FROM tr WHERE analysis_trace_id <> ''),
ss AS (SELECT tc_trace_id, service, count(*) AS event_count, count(*) FILTER (lv = 'ERROR') AS error_count, count(*) FILTER (stack) AS stack_count, count(*) FILTER (text) AS text_count, min(ts) AS first_timestamp,
  arg_min(o, ts || lpad(o::VARCHAR, 12, '0')) AS first_event_index, coalesce(min(o) FILTER (lv = 'ERROR' OR stack OR text), 0) AS first_signal_index,
  CAST(sum((length(cs) - length(replace(cs, '):' || service || '/', ''))) // length('):' || service || '/')) AS BIGINT) AS callstack_hits FROM sg GROUP BY 1, 2)"""
_VARIANTS = _SIGNALS + """, rv AS (SELECT tc_trace_id, service,
  row_number() OVER (PARTITION BY tc_trace_id ORDER BY error_count DESC, stack_count DESC, text_count DESC, first_timestamp, service) AS raw_evidence,
  row_number() OVER (PARTITION BY tc_trace_id ORDER BY error_count / event_count DESC, stack_count / event_count DESC, text_count / event_count DESC, error_count DESC, service) AS volume_normalized,
  row_number() OVER (PARTITION BY tc_trace_id ORDER BY CASE WHEN first_signal_index = 0 THEN 4611686018427387904 ELSE first_signal_index END, error_count DESC, stack_count DESC, service) AS temporal_first_signal,
  row_number() OVER (PARTITION BY tc_trace_id ORDER BY callstack_hits DESC, error_count DESC, stack_count DESC, CASE WHEN first_signal_index = 0 THEN 4611686018427387904 ELSE first_signal_index END, service) AS call_stack_evidence FROM ss),
lv4 AS (""" + " UNION ALL ".join(f"SELECT tc_trace_id, '{v}' AS variant, service, CAST({v} AS INT) AS rank FROM rv" for v in ("raw_evidence", "volume_normalized", "temporal_first_signal", "call_stack_evidence")) + ")"


def signals(spark, sf):
    return localize.signal_stats(traced(spark, sf).drop("tc_trace_id").withColumnRenamed("analysis_trace_id", "tc_trace_id"))


@query("ag10_signal_stats", with_sql(_SIGNALS + "SELECT * FROM ss"))
def ag10(spark, sf):
    return signals(spark, sf)


@query("wn4_signal_ranking", with_sql(_SIGNALS + "SELECT *, CAST(row_number() OVER (PARTITION BY tc_trace_id ORDER BY error_count DESC, stack_count DESC, text_count DESC, first_timestamp, service) AS INT) AS candidate_rank FROM ss"))
def wn4(spark, sf):
    return localize.rank_signals(signals(spark, sf))


@query("wn5_ranking_variants", with_sql(_VARIANTS + "SELECT * FROM lv4"))
def wn5(spark, sf):
    return localize.ranking_variants(signals(spark, sf))


@query("wn6_agreement", with_sql(_VARIANTS + "SELECT v.variant, count(*) AS traces, count(*) FILTER (v.service = b.service) AS agree, count(*) FILTER (v.service = b.service) / count(*) AS rate FROM lv4 v JOIN lv4 b ON v.tc_trace_id = b.tc_trace_id AND b.variant = 'raw_evidence' AND b.rank = 1 WHERE v.rank = 1 GROUP BY 1"))
def wn6(spark, sf):
    return localize.variant_agreement(localize.ranking_variants(signals(spark, sf)))


def entities(spark, sf):
    e = traced(spark, sf).drop("tc_trace_id").withColumnRenamed("analysis_trace_id", "tc_trace_id")
    return e, localize.entity_stats(e, e.select(F.col("tc_service").alias("service")))


_ENTITIES = r""", voc AS (SELECT DISTINCT tc_service AS s FROM tr WHERE tc_service <> '' AND analysis_trace_id <> ''),
en AS (SELECT analysis_trace_id, ordinal, coalesce(nullif(tc_service, ''), '<UNKNOWN_SERVICE>') AS emitter, lv = 'ERROR' AS err, concat_ws(' ', message, stack_trace, logger_name, tc_trace_call_stack) AS text, regexp_extract_all(tc_trace_call_stack, '\):([A-Za-z0-9_-]+)/', 1) AS stack FROM tr WHERE analysis_trace_id <> ''),
sd AS (SELECT en.analysis_trace_id, ordinal, s FROM en JOIN voc ON contains(text, s)),
ca AS (SELECT analysis_trace_id, ordinal, emitter AS entity FROM en UNION SELECT analysis_trace_id, ordinal, s FROM sd UNION SELECT analysis_trace_id, ordinal, unnest(stack) FROM en),
fl AS (SELECT ca.analysis_trace_id AS tc_trace_id, entity, ca.ordinal, err, entity = emitter AS own, sd.s IS NOT NULL AS told, list_contains(stack, entity) AS stacked
  FROM ca JOIN en ON ca.analysis_trace_id = en.analysis_trace_id AND ca.ordinal = en.ordinal LEFT JOIN sd ON sd.analysis_trace_id = ca.analysis_trace_id AND sd.ordinal = ca.ordinal AND sd.s = entity),
es AS (SELECT tc_trace_id, entity, count(*) FILTER (own) AS emitter_events, count(*) FILTER (own AND err) AS emitter_errors, count(*) FILTER (told) AS mention_events, count(*) FILTER (told AND err) AS mention_errors, count(*) FILTER (stacked) AS callstack_hits,
  coalesce(min(ordinal) FILTER (told OR err), 0) AS first_signal_index, coalesce(min(ordinal) FILTER (err), 0) AS first_error_index,
  concat_ws('+', max('callstack') FILTER (stacked), max('emitter') FILTER (own), max('mentioned') FILTER (told)) AS entity_sources FROM fl GROUP BY 1, 2)"""


@query("ag11_entity_ranking", with_sql(_ENTITIES + "SELECT *, CAST(row_number() OVER (PARTITION BY tc_trace_id ORDER BY mention_errors DESC, callstack_hits DESC, emitter_errors DESC, mention_events DESC, CASE WHEN first_signal_index = 0 THEN 4611686018427387904 ELSE first_signal_index END, entity) AS INT) AS rank FROM es"))
def ag11(spark, sf):
    return localize.rank_entities(entities(spark, sf)[1])


@query("ag12_canonical_entities", with_sql(_ENTITIES + "SELECT tc_trace_id, entity, emitter_events, emitter_errors, mention_events, mention_errors, callstack_hits, first_signal_index, first_error_index, entity_sources FROM es WHERE entity IN (SELECT s FROM voc)"))
def ag12(spark, sf):
    e, stats = entities(spark, sf)
    return localize.canonical_entities(stats, e.select(F.col("tc_service").alias("service")))


@query("wn8_scheduler_boost")
def wn8(spark, sf):
    e, stats = entities(spark, sf)
    return localize.scheduler_boost(stats, e.withColumn("message", F.when(F.col("ordinal") % 50 == 0, "scheduler recusou 1 de 2 task").otherwise(F.col("message"))))


@query("ag21_evaluation", with_sql(_ENTITIES + """
, rn AS (SELECT tc_trace_id, entity, row_number() OVER (PARTITION BY tc_trace_id ORDER BY mention_errors DESC, callstack_hits DESC, emitter_errors DESC, mention_events DESC, CASE WHEN first_signal_index = 0 THEN 4611686018427387904 ELSE first_signal_index END, entity) AS r FROM es),
ro AS (SELECT analysis_trace_id AS tc_trace_id, max(tc_service) AS root, max(tc_tenant) AS category FROM tr WHERE analysis_trace_id <> '' GROUP BY 1),
be AS (SELECT ro.tc_trace_id, category, min(r) FILTER (lower(entity) = lower(root)) AS place FROM ro LEFT JOIN rn USING (tc_trace_id) WHERE lower(trim(root)) NOT IN ({rootless}) GROUP BY 1, 2),
c AS (SELECT category, count(*) AS cases, count(*) FILTER (place = 1) AS top1, count(*) FILTER (place <= 3) AS top3 FROM be GROUP BY GROUPING SETS ((category), ()))
SELECT *, coalesce(top1 / nullif(cases, 0), 0) AS top1_rate, coalesce(top3 / nullif(cases, 0), 0) AS top3_rate FROM c""".replace("{rootless}", ", ".join(f"'{x}'" for x in localize.ROOTLESS))))
def ag21(spark, sf):
    e, stats = entities(spark, sf)
    roots = e.groupBy("tc_trace_id").agg(F.max("tc_service").alias("root"), F.max("tc_tenant").alias("category"))
    return localize.evaluate(localize.rank_entities(stats), roots)


def evidence(spark, sf):
    e = traced(spark, sf).drop("tc_trace_id").withColumnRenamed("analysis_trace_id", "tc_trace_id")
    return cause.build_evidence(e.withColumn("level", fx.level(F.col("level"))))


@query("ag13_evidence", with_sql("""
SELECT analysis_trace_id AS tc_trace_id, count(*) AS raw_event_count, count(*) FILTER (lv = 'ERROR') AS error_count, count(*) FILTER (lv = 'WARN') AS warn_count, count(DISTINCT tc_tenant) AS tenant_count, min(timestamp) AS window_start, max(timestamp) AS window_end,
  (epoch_us(CAST(max(timestamp) AS TIMESTAMP)) - epoch_us(CAST(min(timestamp) AS TIMESTAMP))) // 1000 AS duration_ms, arg_min(tc_service, timestamp || lpad(ordinal::VARCHAR, 12, '0')) AS entry_service,
  coalesce(arg_min(tc_service, timestamp || lpad(ordinal::VARCHAR, 12, '0')) FILTER (lv = 'ERROR'), '') AS first_error_service, coalesce(arg_min(message, timestamp || lpad(ordinal::VARCHAR, 12, '0')) FILTER (lv = 'ERROR'), '') AS first_error_message
FROM tr WHERE analysis_trace_id <> '' GROUP BY 1"""))
def ag13(spark, sf):
    return evidence(spark, sf).select("tc_trace_id", "raw_event_count", "error_count", "warn_count", "tenant_count", "window_start", "window_end", "duration_ms", "entry_service", "first_error_service", "first_error_message")


@query("ml21_simple_hypotheses", with_sql("""
, e AS (SELECT analysis_trace_id AS tc_trace_id, trim(coalesce(arg_min(tc_service, timestamp || lpad(ordinal::VARCHAR, 12, '0')) FILTER (lv = 'ERROR'), '')) AS err, trim(arg_min(tc_service, timestamp || lpad(ordinal::VARCHAR, 12, '0'))) AS entry FROM tr WHERE analysis_trace_id <> '' GROUP BY 1)
SELECT tc_trace_id, CASE WHEN err <> '' THEN err WHEN entry <> '' THEN entry ELSE '<UNKNOWN_SERVICE>' END AS hypothesis_entity, CASE WHEN err <> '' THEN 'first_error_service' ELSE 'entry_service' END AS hypothesis_source,
  CASE WHEN err <> '' THEN 'medium_relative' ELSE 'low_relative' END AS relative_confidence FROM e"""))
def ml21(spark, sf):
    return cause.simple_hypotheses(evidence(spark, sf)).select("tc_trace_id", "hypothesis_entity", "hypothesis_source", "relative_confidence")


@query("ml22_explainable_hypotheses")
def ml22(spark, sf):
    return cause.explainable_hypotheses(evidence(spark, sf)).select("tc_trace_id", "hypothesis", "evidence_type", "candidate_entities", "top_warn_patterns", "tenants_observed")


# --- templates, features, detectors


def prepared(spark, sf):
    return adapted(spark, sf).select("ordinal", "tc_service", "level", fx.prepare_message(F.col("message")).alias("prepared"))


@query("ml1_mine_templates")
def ml1(spark, sf):
    return templates.mine(prepared(spark, sf))


@query("ml2_match_templates")
def ml2(spark, sf):
    p = prepared(spark, sf)
    return templates.match(p, templates.mine(p)).groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("events"))


@query("ag24_catalogue_stats")
def ag24(spark, sf):
    return templates.catalogue_stats(templates.mine(prepared(spark, sf)))


@query("ml25_compare_preparers")
def ml25(spark, sf):
    a = prepared(spark, sf)
    b = adapted(spark, sf).select("ordinal", fx.prepare_message(F.col("message"), "current").alias("prepared"))
    return templates.compare_assignments(templates.match(a, templates.mine(a)), templates.match(b, templates.mine(b)))


@query("ag25_text_catalogue", "SELECT sha256(text) AS text_hash, min(text) AS text, count(*) AS occurrences, count(DISTINCT text) AS texts FROM conversations GROUP BY 1")
def ag25(spark, sf):
    return features.text_catalogue(table(spark, sf, "conversations"), "text")


@query("ml7_tfidf", r"""
WITH d AS (SELECT item_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM (
   SELECT item_id, regexp_extract_all(line, '<(?:BLOCK_ID|JOB_ID|IP|PATH|\*)>|[A-Za-z0-9_]+(?:[.$:-][A-Za-z0-9_]+)*\*?') AS t FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark))),
e AS (SELECT item_id, unnest(g) AS term FROM d), c AS (SELECT item_id, term, count(*) AS tf FROM e GROUP BY 1, 2),
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1.0 AS idf FROM c GROUP BY 1),
w AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def ml7(spark, sf):
    b = table(spark, sf, "benchmark")
    return features.tfidf_transform(b, features.tfidf_fit(b, "text", "item_id"), "text", "item_id").withColumn("weight", F.round("weight", 6))


@query("ag31_mean_vectors", """
WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2)
SELECT label, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS x FROM m""")
def ag31(spark, sf):
    m = features.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding", 64)
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round(F.col("x").cast("double"), 4).alias("x"))


@query("ag32_vector_audit", "SELECT count(*) AS rows, count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.001) AS unit, CAST(0 AS BIGINT) AS not_finite FROM embeddings")
def ag32(spark, sf):
    return features.vector_audit(table(spark, sf, "embeddings"), "embedding")


@query("wn17_neighbours", """
WITH u AS (SELECT label AS key, vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE vec_id < 300),
p AS (SELECT a.vec_id AS key, b.vec_id AS other, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT key, other, round(cosine, 4) AS cosine, CAST(row_number() OVER (PARTITION BY key ORDER BY p.cosine DESC, other) AS INT) AS rank FROM p QUALIFY rank <= 3""".replace(" WHERE vec_id < 300", ""))
def wn17(spark, sf):
    return features.neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 4))


@query("ag30_standard_scaler", with_sql(_FEATURES + """
, p AS (SELECT avg(event_count) AS m, stddev_pop(event_count) AS s FROM g) SELECT tc_trace_id, round((event_count - m) / s, 9) AS scaled FROM g, p"""))
def ag30(spark, sf):
    f = sessions.trace_features(adapted(spark, sf)).select("tc_trace_id", F.col("event_count").alias("scaled"))
    return features.scaler_apply(f, ["scaled"], features.scaler_fit(f, ["scaled"])).withColumn("scaled", F.round("scaled", 9))


_INPUTS = ["event_count", "error_count", "warn_count", "service_count", "text_signal_count", "error_rate"]


@query("ml11_isolation_forest")
def ml11(spark, sf):
    f = sessions.trace_features(adapted(spark, sf))
    s = features.scaler_apply(f, _INPUTS, features.scaler_fit(f, _INPUTS))
    model = detect.IsolationForest().fit(detect.first_rows(s, "tc_trace_id", _INPUTS))
    return detect.score_rows(s, _INPUTS, model, "isolation_forest_score").select("tc_trace_id", "isolation_forest_score")


@query("ml12_one_class_svm")
def ml12(spark, sf):
    f = sessions.trace_features(adapted(spark, sf))
    s = features.scaler_apply(f, _INPUTS, features.scaler_fit(f, _INPUTS))
    model = detect.OneClassSVM(nu=0.05).fit(detect.drawn_rows(s, "tc_trace_id", _INPUTS, detect.OneClassSVM.most))
    return detect.score_rows(s, _INPUTS, model, "one_class_svm_score").select("tc_trace_id", "one_class_svm_score")


@query("ml13_sgd_one_class_svm")
def ml13(spark, sf):
    f = sessions.trace_features(adapted(spark, sf))
    s = features.scaler_apply(f, _INPUTS, features.scaler_fit(f, _INPUTS))
    model = detect.SGDOneClassSVM().fit(detect.first_rows(s, "tc_trace_id", _INPUTS))
    return detect.score_rows(s, _INPUTS, model, "sgd_one_class_svm_score").select("tc_trace_id", "sgd_one_class_svm_score")


@query("jn4_one_to_one", "SELECT doc_id, quality, length(text) AS n FROM labels JOIN documents USING (doc_id)")
def jn4(spark, sf):
    return review.join_one_to_one(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")


@query("jn13_aligned_audit", "SELECT (SELECT count(*) FROM labels) AS in_all, (SELECT count(*) FROM documents) AS in_any, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS differing")
def jn13(spark, sf):
    return review.aligned_audit({"a": table(spark, sf, "documents"), "b": table(spark, sf, "labels")}, "doc_id", ("doc_id",))


@query("jn17_train_normal", "SELECT doc_id, length(text) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def jn17(spark, sf):
    s = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"), F.when(F.col("toxic") == 0, "Normal").otherwise("Anomaly").alias("label"))
    return review.select_train_normal(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), s, "doc_id")


@query("jn18_subset", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def jn18(spark, sf):
    return review.subset_check(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("st3_overlap", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def st3(spark, sf):
    return review.overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("ag33_id_frequency", with_sql(r"""
, i AS (SELECT ordinal, message, unnest(regexp_extract_all(message, 'svc-\d+')) AS id FROM ev)
SELECT id, count(DISTINCT ordinal) AS lines, count(*) AS mentions, min(message) AS example FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def ag33(spark, sf):
    return review.id_frequency(adapted(spark, sf), "message", r"svc-\d+")


@query("ag35_drill_down", """
WITH p AS (SELECT '5' AS k UNION SELECT CAST(min(doc_id) AS VARCHAR) FROM labels WHERE toxic = 1 UNION SELECT CAST(min(doc_id) AS VARCHAR) FROM labels WHERE quality = 0)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS nth FROM events JOIN p ON CAST(user_id AS VARCHAR) = k QUALIFY nth <= 8""")
def ag35(spark, sf):
    s = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), F.when(F.col("toxic") == 1, "Anomaly").alias("label"), F.when(F.col("quality") == 0, "validation").alias("split"))
    return review.drill_down(table(spark, sf, "events").select("user_id", "event_id"), s, "user_id", "event_id", "5")


@query("ml15_frozen_evaluation", f"""
WITH {_SCORES}, b AS (SELECT t, length(text) <= 500 OR doc_id % 9 = 0 AS base, score >= 0.9 AS model FROM s JOIN documents USING (doc_id)),
r AS (SELECT 'baseline' AS rule, base AS p, t FROM b UNION ALL SELECT 'model', model, t FROM b UNION ALL SELECT 'either', base OR model, t FROM b),
c AS (SELECT rule, count(*) AS n, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM r GROUP BY 1)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS coverage FROM c""")
def ml15(spark, sf):
    s = scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("length"), (F.col("doc_id") % 9 == 0).cast("int").alias("unk")), "doc_id")
    return review.frozen_evaluation(s, F.col("t"), 500, "score", 0.9)


@query("ml18_false_positives", f"""
WITH {_SCORES}, r AS (SELECT 'base' AS rule, score >= 0.7 AS p, t FROM s UNION ALL SELECT 'base_and_evidence', score >= 0.7 AND doc_id % 2 = 0, t FROM s UNION ALL SELECT 'revised', score >= 0.9, t FROM s),
c AS (SELECT rule, count(*) AS n, count(*) FILTER (p AND t) AS tp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM r GROUP BY 1)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS coverage FROM c""")
def ml18(spark, sf):
    return review.false_positive_strategies(scored(spark, sf), F.col("t"), "score", 0.7, F.col("doc_id") % 2 == 0, "score", 0.9)


@query("ml24_compare_detectors")
def ml24(spark, sf):
    return review.compare_detectors(scored(spark, sf).withColumn("other", 1 - F.col("score")), F.col("t"), ["score", "other"])


@query("ml26_pilot_report")
def ml26(spark, sf):
    p = prepared(spark, sf)
    return review.pilot_report(templates.match(p, templates.mine(p)))


@query("jn12_attach_vectors")
def jn12(spark, sf):
    c = table(spark, sf, "conversations")
    vectors = features.embed(c, "text", features.hash_provider()).withColumn("text_hash", F.sha2("text", 256))
    return review.attach_vectors(c, vectors, "text").select("conv_id", "turn", "text_hash", F.round(features.l2(F.col("vector")), 4).alias("norm"))


@query("ml9_hybrid")
def ml9(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("counts", F.array(F.col("label"), F.lit(1)))
    return features.hybrid(v, "embedding", "counts").select("vec_id", F.size("hybrid").alias("size"))


@query("ml23_review_sheet")
def ml23(spark, sf):
    e = evidence(spark, sf)
    tops = localize.top_columns(localize.rank_signals(signals(spark, sf)), "tc_trace_id", "service", "candidate_rank")
    return localize.agreement(cause.review_sheet(e.select("tc_trace_id"), tops, e).withColumn("root_service_manual", F.col("first_error_service"))).select("tc_trace_id", "observed_fact_automatic", "top_candidate_1", "root_in_top3", "root_candidate_rank")


@query("ag22_confidence")
def ag22(spark, sf):
    h = cause.simple_hypotheses(evidence(spark, sf)).withColumn("root", F.col("first_error_service")).withColumn("traceability", F.lit(1.0))
    return review.evaluate_by_confidence(h, "relative_confidence", "hypothesis_entity", "root", "traceability")


@query("bench_order_traces", """
SELECT l_orderkey, count(*) AS events, count(DISTINCT l_suppkey) AS services, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag = 'A') AS warns, min(l_linenumber) AS first_ordinal, max(l_linenumber) AS last_ordinal FROM lineitem GROUP BY 1""")
def bench_orders(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("l_suppkey").alias("services"), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count_if(F.col("l_returnflag") == "A").alias("warns"), F.min("l_linenumber").alias("first_ordinal"), F.max("l_linenumber").alias("last_ordinal"))


from logloom.plans import files  # noqa: E402, F401  registers its queries
