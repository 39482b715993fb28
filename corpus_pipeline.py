"""The corpus pipeline: documents through five stages to token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next one.
All but the last give the columns of documents. Extra columns of docs are carried along; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, mixing, ngram_join, quality, token_output
from logloom.llm.common import cut, join_hot, read
from logloom.llm.queries import TOKENIZER


def _new(docs: DataFrame, name: str) -> str:
    """name, or with underscores before it if docs has such a column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that no two rows share and none lacks: doc_id, or, where ids are missing or clash, numbers given as docs are written once more."""
    clash = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1)
    if clash.isEmpty():
        return docs, "doc_id"
    key = _new(docs, "_row")
    return cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier scores 0.5 or more. Null ids, clashing ids and null texts are judged like others; without labels all stay."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    score = _new(docs, "_score")
    return quality.add_score(docs, model, column=score).filter(F.col(score) >= 0.5).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least id (null ids last); rows without words all stay.

    Repeated rows are copies. Rows that share an id, or have none, are judged apart, each by its text.
    """
    docs, key = _keyed(docs)
    found = ngram_join.jaccard_components(docs.select(F.col(key).cast("long").alias("row"), "text"), "row")
    if key != "doc_id":  # the rows' numbers don't follow the ids
        ids = docs.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"))
        found = cut(found.join(ids, "row"), "found")
        best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"), F.count(F.lit(1)).alias("w")).filter("w > 1")
        gone = join_hot(found, best, ["component_id"], "w").filter(F.col("row") != F.col("best.row"))
    else:
        gone = found.filter("row <> component_id")
    gone = cut(gone.select(F.col("row").alias(key)), "gone")
    return docs.join(gone, key, "left_anti").select(*[c for c in docs.columns if key == "doc_id" or c != key])


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage near a benchmark item. Null and empty texts stay; ids don't matter."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, by chance in proportion to the quality classifier's score: complete epochs of a source repeat its rows.

    Texts without words come with every complete epoch. Rows that share an id, or have none, are taken each on its own.
    """
    docs, key = _keyed(docs)
    model = quality.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))  # labels of all documents, not of those that are left
    score = quality.scorer(spark, model)
    rows = docs.select(F.col(key).alias("row"), "text", "source")
    taken = mixing.mix_sources(rows, id_col="row", weight=lambda raw, off: score(raw, off).round(2).clip(0.01)).filter("copies > 0")
    copies, nth = _new(docs, "_copies"), _new(docs, "_nth")
    taken = cut(taken.select(F.col("row").alias(key), F.col("copies").alias(copies)), "taken")
    out = docs.join(taken, key).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return out.select(*[c for c in docs.columns if key == "doc_id" or c != key])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id (a null one as the least long), start, n_tokens, ids_crc32. Repeated rows are written as often as they come."""
    return token_output.token_output(docs, TOKENIZER)


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", no_leaks), ("mixing sources to target weights", mix), ("token-ID / binary output", to_tokens)]

#: No SQL expresses a learned classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
