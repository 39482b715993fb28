"""Connected components of edges that never meet in one place: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex links its neighbours (large: those above it; else those below and itself) to the least vertex it sees."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, root) of every vertex of edges (a, b: longs), root the least vertex of its component; roots are listed too.

    Each round shuffles edges and minima only; a round's result is written to the shared folder. Self links are allowed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        edges = cut(_star(_star(edges, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
