"""Registered queries over files: each writes rows to the shared folder as a user would have them, and reads them back."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as fx
from logloom.operators import detect, review, sessions, split, templates
from logloom.plans.catalogue import adapted, query, table, with_sql
from logloom.sources import readers, sinks

_LINE = "concat('e', event_id, ' of ', user_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE ' ok' END)"


def _lines(spark, sf) -> DataFrame:
    """The lines of the events as text files whose paths are in the order of the events."""
    path = sinks.scratch(spark, "lines")
    table(spark, sf, "events").select("event_id", F.expr(_LINE).alias("line")).repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    return readers.read_lines(spark, path)


@query("src1_read_lines", f"SELECT CAST(event_id + 1 AS BIGINT) AS line_id, {_LINE} AS line, TRUE AS decodes FROM events")
def src1(spark, sf):
    return _lines(spark, sf)


@query("src14_first_lines", f"SELECT CAST(event_id + 1 AS BIGINT) AS line_id, {_LINE} AS line, TRUE AS decodes FROM events WHERE event_id < 100")
def src14(spark, sf):
    return readers.first_lines(_lines(spark, sf), 100)


_CSV = "SELECT event_id, CAST(event_id AS {0}) AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(event_type, CASE WHEN event_id % 3 = 0 THEN concat({1}, ' \"quoted\", ', user_id) ELSE '' END) END AS message, CAST(user_id AS {0}) AS tc_user FROM events"


def _csv_rows(spark, sf) -> DataFrame:
    return spark.sql(_CSV.format("STRING", "chr(10)").replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


def _csv_tree(spark, sf, compression: str = "none") -> str:
    path = sinks.scratch(spark, "tree")
    rows = _csv_rows(spark, sf)
    for name, part in (("a", rows.filter("event_id % 2 = 0")), ("b/c", rows.filter("event_id % 2 = 1"))):
        sinks.write_csv(part.repartitionByRange(2, "event_id").sortWithinPartitions("event_id").drop("event_id"), f"{path}/{name}", compression)
    return path


_TREE = f"WITH r AS ({_CSV.format('VARCHAR', 'chr(10)')}) SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS event_ordinal, id, message, tc_user FROM r"


@query("src4_csv_tree", _TREE)
def src4(spark, sf):
    return readers.read_csv_tree(spark, _csv_tree(spark, sf), columns=["id", "message", "tc_user"], required=("message",), ordinal="event_ordinal")


@query("src5_csv_gzip", _TREE)
def src5(spark, sf):
    return readers.read_csv_tree(spark, _csv_tree(spark, sf, "gzip"), ordinal="event_ordinal")


@query("src7_csv_columns", f"WITH r AS ({_CSV.format('VARCHAR', 'chr(10)')}) SELECT tc_user, count(*) AS n, count(*) FILTER (message = '') AS blank FROM r GROUP BY 1")
def src7(spark, sf):
    rows = readers.read_csv_tree(spark, _csv_tree(spark, sf), required=("tc_user", "message")).select("tc_user", "message")
    return rows.groupBy("tc_user").agg(F.count(F.lit(1)).alias("n"), F.count_if(fx.blank(F.col("message"))).alias("blank"))


def _write_zips(rows: DataFrame, folder: str) -> None:
    """One archive a partition, each with its rows as a CSV member, written by the tasks that hold them."""
    base = urlparse(folder).path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            out, name = io.BytesIO(), f"{base}/part-{TaskContext.get().partitionId():05d}.zip"
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("events.csv", pd.concat(held).to_csv(index=False))
            with open(f"{name}.part", "wb") as f:
                f.write(out.getvalue())
            os.replace(f"{name}.part", name)
        yield pd.DataFrame({"n": [sum(map(len, held))]})

    os.makedirs(base)
    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


@query("src6_zip_csv", f"WITH r AS ({_CSV.format('VARCHAR', 'chr(10)')}) SELECT id, message, tc_user FROM r")
def src6(spark, sf):
    path = sinks.scratch(spark, "zips")
    _write_zips(_csv_rows(spark, sf).drop("event_id").repartition(3, "id"), path)
    return readers.read_zip_csv(spark, path, ["id", "message", "tc_user"]).drop("source_file")


@query("src3_master_split", "SELECT 'blk_' || doc_id AS BlockId, CASE WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS Label, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS Split FROM labels GROUP BY ALL")
def src3(spark, sf):
    path = sinks.scratch(spark, "split")
    rows = table(spark, sf, "labels").selectExpr("concat('blk_', doc_id) AS BlockId", "CASE WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS Label", "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS Split").distinct()
    sinks.write_csv(rows, path)
    return readers.read_split(spark, path)


_LEVELS = "SELECT ordinal, lv, analysis_trace_id_source AS source FROM tr"


def _levels(spark, sf) -> DataFrame:
    return sessions.assign_trace(adapted(spark, sf)).select("ordinal", fx.level(F.col("level")).alias("lv"), F.col("analysis_trace_id_source").alias("source"))


@query("snk1_publish", with_sql(_LEVELS))
def snk1(spark, sf):
    path, rows = sinks.scratch(spark, "published"), _levels(spark, sf)
    digest = sinks.publish(rows, path, sort_by=("ordinal",))
    if sinks.publish(rows, path) != digest:
        raise RuntimeError("the same rows have another hash")
    return sinks.load_published(spark, path, digest)


@query("snk4_partitioned", with_sql(_LEVELS + " WHERE analysis_trace_id_source = 'tc_trace_id'"))
def snk4(spark, sf):
    path = sinks.scratch(spark, "partitioned")
    sinks.publish(_levels(spark, sf), path, partition_by=("source",), sort_by=("ordinal",))
    return spark.read.parquet(path).filter("source = 'tc_trace_id'")


@query("snk6_routed", with_sql("SELECT ordinal, lv, analysis_trace_id_source = 'none' AS routed FROM tr"))
def snk6(spark, sf):
    path, rows = sinks.scratch(spark, "routed"), _levels(spark, sf)
    sinks.write_routed(rows.select("ordinal", "lv", F.when(F.col("source") != "none", False).otherwise(F.lit(True)).alias("r")).select("ordinal", "lv", "r"), F.col("r"), path)
    return spark.read.parquet(path).select("ordinal", "lv", F.col("routed").cast("boolean").alias("routed"))


@query("snk3_manifest", with_sql("SELECT count(*) AS rows, count(*) FILTER (lv = 'ERROR') AS errors, TRUE AS accepted FROM tr"))
def snk3(spark, sf):
    path = f"{sinks.scratch(spark, 'manifest')}.json"
    r = _levels(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("lv") == "ERROR").alias("errors")).first()
    sinks.store_json(spark, {"rows": r["rows"], "errors": r["errors"], "acceptance": {"accepted": True, "checks": {"has_rows": r["rows"] > 0}}}, path)
    text = spark.read.text(path, wholetext=True).first()[0]
    readers.require_accepted(text)
    return spark.read.option("multiLine", True).json(path).select("rows", "errors", "acceptance.accepted")


@query("snk10_keep_manual", "SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'n' || l.quality END AS notes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def snk10(spark, sf):
    fresh = table(spark, sf, "documents").select("doc_id", "lang", F.lit("").alias("notes"))
    old = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("n"), "quality").alias("notes"))
    return sinks.upsert_keep_manual(fresh, old, "doc_id", ("notes",))


@query("snk11_upsert_latest", """
WITH o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT user_id, event_id FROM n UNION ALL SELECT user_id, event_id FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def snk11(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    old = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return sinks.upsert_latest(old, e.filter("event_id % 3 = 0"), "user_id", "event_id")


# --- operators that no other query runs


@query("flt4_certain", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'anomalia' ELSE 'nao_anomalia' END AS label FROM labels WHERE doc_id % 6 <> 0 OR doc_id % 6 IS NULL")
def flt4(spark, sf):
    from logloom.operators import calibrate

    marks = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "incerto").when(F.col("doc_id") % 2 == 0, "anomalia").otherwise("nao_anomalia").alias("label"))
    return calibrate.certain(marks)


@query("ml5_unknown_events", with_sql("SELECT ordinal, message, sha256(message) AS text_hash FROM ev WHERE template_id = 0"))
def ml5(spark, sf):
    return templates.unknown_events(adapted(spark, sf).select("ordinal", "message", "template_id"), "message").select("ordinal", "message", "text_hash")


@query("ml4_match_counts", with_sql("""
SELECT template_id, count(*) FILTER (s = 'train') AS train, count(*) FILTER (s = 'validation') AS validation, count(*) FILTER (s = 'test') AS test, count(*) FILTER (s = 'none') AS none
FROM (SELECT template_id, CASE ordinal % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' WHEN 2 THEN 'none' ELSE 'train' END AS s FROM ev) GROUP BY 1"""))
def ml4(spark, sf):
    part = F.when(F.col("ordinal") % 5 == 0, "validation").when(F.col("ordinal") % 5 == 1, "test").when(F.col("ordinal") % 5 == 2, "none").otherwise("train")
    return templates.match_counts(adapted(spark, sf).withColumn("split", part))


@query("flt7_merges", with_sql("SELECT template_id, count(*) AS fit_count FROM ev GROUP BY 1 HAVING count(*) >= 100 ORDER BY fit_count DESC, template_id LIMIT 50"))
def flt7(spark, sf):
    return templates.merges(adapted(spark, sf).groupBy("template_id").agg(F.count(F.lit(1)).alias("fit_count")))


@query("ml3_frozen_catalogue", "SELECT TRUE AS same")
def ml3(spark, sf):
    """A mined catalogue, published, loaded under its hash and compared with itself."""
    path, mined = sinks.scratch(spark, "catalogue"), templates.mine(adapted(spark, sf).withColumn("prepared", fx.prepare_message(F.col("message"))))
    digest = sinks.publish(mined, path)
    return spark.createDataFrame([(templates.frozen(mined, sinks.load_published(spark, path, digest)),)], "same boolean")


@query("fn15_hash_text", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def fn15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.hash_text(F.col("text")).alias("text_hash"))


@query("fn20_exception_head", with_sql("SELECT ordinal, left(stack_trace, 200) AS head, string_split(logger_name, '.')[-1] AS logger FROM ev"))
def fn20(spark, sf):
    stack = F.concat(F.lit("  "), "stack_trace", F.lit("\n\tat com.acme.Step.run(Step.java:12)\n"))
    return adapted(spark, sf).select("ordinal", F.when(F.col("stack_trace") == "", "").otherwise(fx.exception_head(stack)).alias("head"), fx.short_logger(F.col("logger_name")).alias("logger"))


@query("fn34_completeness", with_sql("SELECT ordinal, CAST(trim(tc_trace_id) <> '' AS INT) + CAST(trim(tc_service) <> '' AS INT) + CAST(stack_trace <> '' AS INT) AS filled FROM ev"))
def fn34(spark, sf):
    return adapted(spark, sf).select("ordinal", fx.completeness(F.col("tc_trace_id"), F.col("tc_service"), F.col("stack_trace")).alias("filled"))


@query("fn36_clean_float", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR value IS NULL OR isnan(value) THEN 0.0 ELSE value END AS v FROM events")
def fn36(spark, sf):
    made = F.when(F.col("event_id") % 6 == 0, F.lit("Infinity").cast("double")).when(F.col("event_id") % 3 == 0, F.lit("NaN").cast("double")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", fx.clean_float(made).alias("v"))


@query("wn2_allocate", """
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT event_type, n, s, o, floor(n * r) AS f, n * r - floor(n * r) AS rest FROM n, (VALUES ('train', 0, 0.70), ('validation', 1, 0.15), ('test', 2, 0.15)) v(s, o, r))
SELECT event_type, s AS split, CAST(f + CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY rest DESC, o) <= n - sum(f) OVER (PARTITION BY event_type) THEN 1 ELSE 0 END AS BIGINT) AS rows FROM p""")
def wn2(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").count().collect()  # one row a label
    return spark.createDataFrame([(r[0], k, v) for r in counts for k, v in split.allocate(r[1]).items()], "event_type string, split string, rows long")


@query("sp6_first_rows", f"SELECT event_id, value FROM events ORDER BY event_id LIMIT {detect.MOST_FIT_ROWS}")
def sp6(spark, sf):
    rows = detect.first_rows(table(spark, sf, "events").withColumn("i", F.col("event_id")), "event_id", ["i", "value"])
    return spark.createDataFrame(pd.DataFrame({"event_id": rows[:, 0].astype("int64"), "value": rows[:, 1]}))


@query("sp7_pilot_sample", """
WITH p AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('pilot' || chr(0) || doc_id), doc_id) <= 20)
SELECT doc_id, lang, 'pilot' AS part FROM p UNION ALL SELECT doc_id, lang, 'rest' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def sp7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    pilot = split.sample_per_group(d, "lang", "doc_id", 20, "pilot")
    return pilot.withColumn("part", F.lit("pilot")).unionByName(d.join(pilot, "doc_id", "left_anti").withColumn("part", F.lit("rest")))


@query("jn3_labelled_features", with_sql("SELECT e.analysis_trace_id AS id, count(*) AS n, any_value(l.y) AS y FROM tr e JOIN (SELECT DISTINCT analysis_trace_id AS id, length(analysis_trace_id) % 2 AS y FROM tr WHERE analysis_trace_id <> '') l ON e.analysis_trace_id = l.id GROUP BY 1"))
def jn3(spark, sf):
    t = sessions.traceable(sessions.assign_trace(adapted(spark, sf)))
    features = t.groupBy(F.col("analysis_trace_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    labels = t.select(F.col("analysis_trace_id").alias("id")).distinct().withColumn("y", (F.length("id") % 2).cast("long"))
    return review.join_one_to_one(labels, features, "id")


@query("wn16_ordinal_by_split", with_sql("SELECT ordinal, lv, row_number() OVER (PARTITION BY lv ORDER BY ordinal) AS nth FROM tr"))
def wn16(spark, sf):
    path = sinks.scratch(spark, "by-level")
    _levels(spark, sf).repartitionByRange(4, "lv", "ordinal").sortWithinPartitions("lv", "ordinal").write.partitionBy("lv").parquet(path)
    rows = spark.read.parquet(path).select("ordinal", "lv", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return readers.with_ordinal_by(rows, "lv", "nth", ("_file", "_start"))
