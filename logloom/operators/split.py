"""Deterministic splits and samples by hash order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx

RATIOS = {"train": Decimal("0.70"), "validation": Decimal("0.15"), "test": Decimal("0.15")}


def validate_ratios(ratios: dict[str, Decimal]) -> None:
    if set(ratios) != {"train", "validation", "test"} or any(v <= 0 for v in ratios.values()) or sum(ratios.values()) != 1:
        raise ValueError(f"ratios must be positive parts of train, validation and test that sum to 1: {ratios}")


def allocate(total: int, ratios: dict[str, Decimal] = RATIOS) -> dict[str, int]:
    """Whole numbers in proportion to ratios that sum to total: floors, then one more for the largest remainders, earlier parts first."""
    validate_ratios(ratios)
    if total < 0:
        raise ValueError("total is negative")
    exact = {k: Decimal(total) * v for k, v in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    order = ("train", "validation", "test")
    for k in sorted(order, key=lambda k: (out[k] - exact[k], order.index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def with_hash_rank(rows: DataFrame, group: Column, digest: Column, key: str, name: str = "_rank") -> DataFrame:
    """rows with their rank by (digest, key) within the group and, in `<name>_of`, the group's size.

    Groups may hold most rows: ranges of the digest's first four hex digits are ranked by themselves and moved up by what lies
    before them, so a task orders a 65,536th of a group. Groups are few (labels), and so is what is broadcast: a row a range.
    """
    d = rows.withColumn("_g", group).withColumn("_d", digest).withColumn("_b", F.left("_d", F.lit(4)))
    sizes = d.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))).withColumn(f"{name}_of", F.sum("_n").over(Window.partitionBy("_g"))).drop("_n")
    out = d.join(sizes.withColumnsRenamed({"_g": "_g2", "_b": "_b2"}), F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2"))).drop("_g2", "_b2")
    return out.withColumn(name, F.col("_base") + F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_d", key))).drop("_g", "_d", "_b", "_base")


def stratified_split(rows: DataFrame, key: str, label: str, salt: str, ratios: dict[str, Decimal] = RATIOS) -> DataFrame:
    """rows with `split`: within each label the ids are ordered by salted digest and dealt out by ratio.

    One count per label reaches the driver.
    """
    validate_ratios(ratios)
    counts = {r[0]: allocate(r[1], ratios) for r in rows.groupBy(label).count().collect()}
    cuts = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.array(F.lit(v["train"]), F.lit(v["train"] + v["validation"])))]) if counts else F.create_map()
    cut = cuts[F.col(label)]
    ranked = with_hash_rank(rows, F.col(label), fx.stable_digest(F.col(key).cast("string"), salt), key)
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut[0], "train").when(F.col("_rank") <= cut[1], "validation").otherwise("test")).drop("_rank", "_rank_of")


def contingency(rows: DataFrame, split: str = "split", label: str = "label", labels: tuple = ("Normal", "Anomaly")) -> DataFrame:
    return rows.groupBy(split).pivot(label, list(labels)).count().na.fill(0)


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has: none if the sides hold the same ids."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def hash_holdout(rows: DataFrame, key: str, label: Column, seed: str, share: float = 0.3) -> DataFrame:
    """rows with `holdout`: of each class the first `share` by hash order (rounded to whole rows)."""
    ranked = with_hash_rank(rows, label, F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256), key)
    return ranked.withColumn("holdout", F.col("_rank") <= F.bround(F.col("_rank_of") * F.lit(share))).drop("_rank", "_rank_of")


def sample_traces(sizes: DataFrame, key: str, rows: str, target: int, seed: str) -> DataFrame:
    """Whole traces in the order of their salted digest until their rows reach target: those whose sum before is below it.

    Digests are spread by their first bits; sums of these ranges tell where the target falls, so no task orders all traces.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    d = sizes.withColumn("_d", digest).withColumn("_b", F.left("_d", F.lit(3)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    bases = d.groupBy("_b").agg(F.sum(rows).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    within = Window.partitionBy("_b").orderBy("_d", key).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(bases.filter(F.col("_base") < target).select("_b", "_base")), "_b")
    return out.withColumn("_before", F.col("_base") + F.coalesce(F.sum(rows).over(within), F.lit(0))).filter(F.col("_before") < target).drop("_d", "_b", "_base", "_before")


def sample_per_group(rows: DataFrame, group: str, key: str, most: int, seed: str = "sample") -> DataFrame:
    """Of each group the `most` rows that come first by hash order."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most).drop("_nth")


def sample_hash(rows: DataFrame, key: str, most: int, seed: str = "sample") -> DataFrame:
    """The `most` rows that come first by hash order."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256), key).limit(most)


def evenly_select(rows: DataFrame, order: list[Column], n: int, key: str) -> DataFrame:
    """n rows at even steps of the order, first and last included; fewer rows are all taken.

    Rows are dealt out by ranges of the order; counts of the ranges say which rank each begins at.
    """
    total = rows.count()
    if total <= n:
        return rows
    at = sorted({int(round(i * (total - 1) / (n - 1))) if n > 1 else 0 for i in range(n)})
    dealt = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = dealt.join(F.broadcast(bases.select("_p", "_base")), "_p").withColumn("_i", F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return ranked.filter(F.col("_i").isin(at)).drop("_i", "_p", "_base")
