"""Streaming forms of the stages that work incrementally. An addition: the batch operators are the reference for results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions import text as fx
from logloom.operators import sessions, templates


def prepare(stream: DataFrame, salt: str | None = None, fields: tuple[str, ...] = ("message", "stack_trace"), mask: Callable[[Column], Column] = fx.prepare_message) -> DataFrame:
    """Trace identity, anonymised fields (if a salt is given) and the prepared message. Stateless."""
    out = sessions.assign_trace(stream)
    if salt:
        out = sessions.anonymize(out, salt, fields)
    return out.withColumn("prepared", mask(F.coalesce("message", F.lit(""))))


def match_each_batch(stream: DataFrame, catalogue: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch with its templates of the frozen catalogue; a batch that is retried replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        templates.match(batch, catalogue).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_windows(stream: DataFrame, time: str = "event_time", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by level of every trace and window, closed by a watermark: late rows beyond it are dropped."""
    lv = fx.level_bucket(F.col("level"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "analysis_trace_id").agg(
        F.count(F.lit(1)).alias("event_count"), *[F.sum((lv == x).cast("long")).alias(f"{x}_count") for x in ("info", "warn", "error", "other")]
    )
