"""Metrics, thresholds and alert levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx

POSITIVE, NEGATIVE, UNCERTAIN = "anomalia", "nao_anomalia", "incerto"


def certain(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.filter(F.col(label).isin(POSITIVE, NEGATIVE))


def _metrics(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = fx.ratio(tp, tp + fp), fx.ratio(tp, tp + fn)
    return [tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), fx.ratio(tn, tn + fp).alias("specificity"), fx.ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion(rows: DataFrame, truth: Column, predicted: Column, group: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, specificity, F1 (0 where undefined) and coverage, over all rows or by group."""
    flat = rows.select(*(group or []), truth.alias("t"), predicted.alias("p"))
    c = lambda e: F.count_if(e)
    t, p = F.col("t"), F.col("p")
    agg = [c(t & p).alias("tp"), c(~t & ~p).alias("tn"), c(~t & p).alias("fp"), c(t & ~p).alias("fn"), F.count(F.lit(1)).alias("n")]
    out = flat.groupBy(*group).agg(*agg) if group else flat.agg(*agg)
    return out.select(*(group or []), "n", *_metrics(*[F.col(x) for x in ("tp", "tn", "fp", "fn")]), fx.ratio(F.col("tp") + F.col("fp"), F.col("n")).alias("coverage"))


#: Ranges of a score that cumulative sums are taken over.
RANGES = 4096


def _cumulated(per: DataFrame, key: str, sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """per (one row a key) with `sums`, name to column: the sum of the column over this and all higher keys, and `totals`: over all keys.

    Keys lie in ranges of equal width; sums of ranges say what lies above each, and every range is ordered by itself.
    """
    lo, hi = per.agg(F.min(key), F.max(key)).first()
    width = (hi - lo) / RANGES if lo is not None and hi > lo else 1.0
    ranged = per.withColumn("_b", F.least(F.floor((F.col(key) - F.lit(lo or 0.0)) / F.lit(width)), F.lit(RANGES - 1)).cast("int"))
    blocks = ranged.groupBy("_b").agg(*[F.sum(c).alias(f"_{n}") for n, c in (sums | totals).items()])
    above, whole = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # RANGES rows at most
    blocks = blocks.select("_b", *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(whole).alias(n) for n in totals])
    down = Window.partitionBy("_b").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(blocks), "_b").withColumns({n: F.col(f"_{n}") + F.sum(c).over(down) for n, c in sums.items()})
    return out.drop("_b", *[f"_{n}" for n in sums])


def threshold_table(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """For every distinct score taken as a threshold (at or above is positive): counts and metrics. One row a score is ordered, not the rows."""
    per = rows.select(F.col(score).cast("double").alias("threshold"), truth.alias("t")).groupBy("threshold").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("q"))
    cum = _cumulated(per, "threshold", {"tp": "p", "fp": "q"}, {"_P": "p", "_N": "q"})
    return cum.select("threshold", *_metrics(F.col("tp"), F.col("_N") - F.col("fp"), F.col("fp"), F.col("_P") - F.col("tp")))


def best_threshold(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """The threshold of the largest F1, of equal ones the highest: one row, with precision, recall and F1 to four places."""
    t = threshold_table(rows, score, truth)
    b = t.agg(F.max_by(F.struct(*t.columns), F.struct(F.col("f1"), F.col("threshold"))).alias("b")).select("b.*")
    return b.select("threshold", "tp", "fp", "fn", *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def best_threshold_rounded(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """As best_threshold, but a later threshold must beat the F1 kept so far after that was rounded to four places.

    An ordered fold over one struct a score; for scores of a labelled sample.
    """
    t = threshold_table(rows, score, truth).select("threshold", "tp", "fp", "fn", "precision", "recall")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    t = t.withColumn("f1", f1)
    seq = t.agg(F.reverse(F.array_sort(F.collect_list(F.struct(*t.columns)))).alias("s"))
    start = F.struct(*[F.lit(None).cast(k).alias(c) for c, k in t.dtypes])
    step = lambda a, x: F.when(a["f1"].isNull() | (x["f1"] > a["f1"]), F.struct(*[x[c].alias(c) for c in t.columns if c != "f1"], F.bround(x["f1"], 4).alias("f1"))).otherwise(a)
    out = seq.select(F.aggregate("s", start, step).alias("b")).select("b.*")
    return out.select("threshold", "tp", "fp", "fn", F.bround("precision", 4).alias("precision"), F.bround("recall", 4).alias("recall"), "f1")


def min_recall_threshold(rows: DataFrame, score: str, truth: Column, least: float = 0.90, specificity: bool = True) -> DataFrame:
    """Of the thresholds that reach the recall, the one best in precision, F1, specificity, and lowest: one row, none if none does."""
    t = threshold_table(rows, score, truth).filter(F.col("recall") >= least)
    key = [F.col("precision"), F.col("f1"), *([F.col("specificity")] if specificity else []), -F.col("threshold")]
    return t.agg(F.max_by(F.struct(*t.columns), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])).alias("b")).filter("b is not null").select("b.*")


def average_precision(rows: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the precision-recall steps: sum of (recall - recall before) * precision from the highest score down."""
    per = rows.select(F.col(score).cast("double").alias("threshold"), truth.alias("t")).groupBy("threshold").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("q"))
    t = _cumulated(per, "threshold", {"tp": "p", "fp": "q"}, {"_P": "p"})
    step = fx.ratio(F.col("p"), F.col("_P"))  # what this score's positives add to the recall
    return t.withColumn("part", step * fx.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("average_precision"))


def alert_levels(scores: DataFrame, score: str, threshold: float, evidence: Column) -> DataFrame:
    """score_alert, and alert_level: high_confidence at or above the threshold with evidence, review without, none below."""
    hit = F.col(score) >= threshold
    return scores.withColumn("score_alert", hit.cast("int")).withColumn("alert_level", F.when(hit & evidence, "high_confidence").when(hit, "review").otherwise("none"))


def length_baselines(sessions: DataFrame, truth: Column, length: str = "length", unknown: str = "unk", limits: tuple[int, int] = (2, 50)) -> DataFrame:
    """F1 and counts of the rules length <= L and (unknown > 0 or length <= L) for every L.

    Sessions are counted by length first; cumulative sums give every L at once.
    """
    lo, hi = limits
    base = sessions.select(F.col(length).alias("len"), (F.col(unknown) > 0).alias("u"), truth.alias("t"))
    capped = base.withColumn("L", F.least(F.greatest("len", F.lit(lo)), F.lit(hi + 1)).cast("int"))
    per = capped.groupBy("L").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("q"), F.count_if(F.col("t") & F.col("u")).alias("pu"), F.count_if(~F.col("t") & F.col("u")).alias("qu"))
    grid = sessions.sparkSession.range(lo, hi + 2).select(F.col("id").cast("int").alias("L"))
    per = grid.join(per, "L", "left").na.fill(0)
    up, whole = Window.orderBy("L").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = lambda c, w: F.sum(c).over(w)
    c = per.select("L", s("p", up).alias("tp1"), s("q", up).alias("fp1"), (s("p", up) + s("pu", whole) - s("pu", up)).alias("tp2"), (s("q", up) + s("qu", whole) - s("qu", up)).alias("fp2"), s("p", whole).alias("P"), s("q", whole).alias("N")).filter(F.col("L") <= hi)
    rules = [F.struct(F.lit(n).alias("rule"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, n in ((1, "length"), (2, "length_or_unknown"))]
    long = c.select("L", "P", "N", F.explode(F.array(*rules)).alias("r"))
    return long.select("r.rule", "L", *_metrics(F.col("r.tp"), F.col("N") - F.col("r.fp"), F.col("r.fp"), F.col("P") - F.col("r.tp")))


def best_length(baselines: DataFrame) -> DataFrame:
    """The L of the largest F1 (to four places) of each rule, of equal ones the smallest."""
    b = baselines.withColumn("f1", F.bround("f1", 4))
    return b.groupBy("rule").agg(F.max_by(F.struct("L", "tp", "fp", "fn", "f1"), F.struct(F.col("f1"), -F.col("L"))).alias("b")).select("rule", "b.*")


#: The binary rules over trace features.
RULES = {
    "error": "error_count > 0",
    "warn": "warn_count > 0",
    "stack_trace": "has_stack_trace > 0",
    "text": "text_signal_count > 0",
    "error_or_warn": "error_count > 0 or warn_count > 0",
    "error_or_stack": "error_count > 0 or has_stack_trace > 0",
    "any_signal": "has_any_signal > 0",
}


def score_rules(labelled: DataFrame, truth: Column, rules: dict[str, str] = RULES) -> DataFrame:
    """Metrics of every rule in one pass."""
    marks = F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(e).alias("p")) for n, e in rules.items()])
    long = labelled.select(truth.alias("t"), F.explode(marks).alias("m")).select("t", "m.rule", "m.p")
    return confusion(long, F.col("t"), F.col("p"), ["rule"])


def threshold_summary(thresholds: DataFrame, column: str = "threshold") -> DataFrame:
    return thresholds.agg(F.median(column).alias("median"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def threshold_stability(rows: DataFrame, key: str, score: str, label: str, seeds: tuple[int, ...], least: float = 0.90) -> DataFrame:
    """One row a seed: the min-recall threshold chosen on its calibration part."""
    from logloom.operators.split import hash_holdout

    out = None
    for seed in seeds:
        part = hash_holdout(rows, key, F.col(label), str(seed)).filter(~F.col("holdout"))
        found = min_recall_threshold(part, score, F.col(label) == POSITIVE, least, specificity=False).withColumn("seed", F.lit(seed))
        out = found if out is None else out.unionByName(found)
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of every column, one row each."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one row each."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("y")).select("y.*")
