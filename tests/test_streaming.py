from pyspark.sql import functions as F

from logloom.operators import templates
from logloom.streaming import traces

EVENTS = "tc_trace_id string, traceId string, level string, message string, stack_trace string, event_time timestamp"


def test_streams(spark, tmp_path):
    rows = [("a", "", "INFO", f"took {i} ms", "") for i in range(5)] + [("", "b", "error", "lost 10.0.0.1", "")]
    df = spark.createDataFrame([(*r, None) for r in rows], EVENTS).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", "", "INFO", "later", "", None)], EVENTS).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_090_000))).write.mode("append").parquet(str(tmp_path / "in"))
    stream = traces.prepare(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), salt="s")
    catalogue = templates.mine(traces.prepare(df, salt="s").withColumn("ordinal", F.monotonically_increasing_id()))
    traces.match_each_batch(stream, catalogue, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 7 and out.filter("template_id = 0").count() == 1 and out.filter("message like '%<IP_%'").count() == 1
    q = traces.trace_windows(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["analysis_trace_id"]: (r["event_count"], r["info_count"], r["error_count"]) for r in spark.table("windows").collect()}
    assert got.items() >= {"a": (5, 5, 0), "b": (1, 0, 1)}.items()
