"""Checked joins, audits, drill-downs and evaluations around the main stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx
from logloom.operators import calibrate


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", complete: bool = True) -> DataFrame:
    """left joined with right; a key that either side repeats, or (complete) a row of left without partner, fails the query as it runs."""
    r = right.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    l = left.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(key)))
    out = l.join(r, key, "left" if complete else how)
    bad = (F.col("_m") > 1) | (F.coalesce("_n", F.lit(0 if complete else 1)) != 1)
    return out.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit(f"{key} isn't one to one: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok", "_n", "_m")


def select_train_normal(rows: DataFrame, split: DataFrame, key: str = "block_id", label: str = "label", name: str = "split") -> DataFrame:
    """rows of normal training sessions; raises ValueError if any such session has no row."""
    wanted = split.filter((F.col(name) == "train") & (F.col(label) == "Normal")).select(key).distinct()
    missing = wanted.join(rows, key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no row for {missing[0][0]}")
    return rows.join(wanted, key, "left_semi")


def subset_check(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Keys of part that whole lacks."""
    return part.select(key).distinct().join(whole, key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def aligned_audit(tables: dict[str, DataFrame], key: str, equal: tuple[str, ...] = ()) -> DataFrame:
    """One row: keys in every table, keys in any, and rows whose columns `equal` differ between the tables."""
    long = None
    for name, df in tables.items():
        part = df.select(F.col(key).alias("k"), F.lit(name).alias("t"), F.to_json(F.struct(*[F.col(c) for c in equal])).alias("v"))
        long = part if long is None else long.unionByName(part)
    per = long.groupBy("k").agg(F.count_distinct("t").alias("tables"), F.count(F.lit(1)).alias("rows"), F.count_distinct("v").alias("values"))
    return per.agg(F.count_if(F.col("tables") == len(tables)).alias("in_all"), F.count(F.lit(1)).alias("in_any"), F.count_if(F.col("rows") > F.col("tables")).alias("repeated"), F.count_if(F.col("values") > 1).alias("differing"))


def attach_vectors(events: DataFrame, catalogue: DataFrame, text: str) -> DataFrame:
    """events with the catalogue's vector of their text's hash."""
    return events.withColumn("text_hash", F.sha2(text, 256)).join(catalogue.select("text_hash", "vector"), "text_hash", "left")


def id_frequency(lines: DataFrame, content: str, pattern: str, most: int = 10) -> DataFrame:
    """The ids that most lines name, with the number of lines, mentions and an example."""
    ids = lines.select(F.col(content).alias("c"), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("ids")).withColumn("_i", F.monotonically_increasing_id())
    e = ids.select("_i", "c", F.explode("ids").alias("id"))
    return e.groupBy("id").agg(F.count_distinct("_i").alias("lines"), F.count(F.lit(1)).alias("mentions"), F.min("c").alias("example")).orderBy(F.desc("lines"), "id").limit(most)


def drill_down(events: DataFrame, sessions: DataFrame, key: str, order: str, fixed: str | None = None, most: int = 8) -> DataFrame:
    """The first events of three sessions: a fixed one, the least abnormal one, the least of the validation part. sessions: key, label, split."""
    picks = sessions.agg(F.lit(fixed).alias("a"), F.min(F.when(F.col("label") == "Anomaly", F.col(key))).alias("b"), F.min(F.when(F.col("split") == "validation", F.col(key))).alias("c"))
    ids = picks.select(F.explode(F.array_distinct(F.array(F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string")))).alias("_k")).filter("_k is not null")
    chosen = events.join(F.broadcast(ids), events[key].cast("string") == ids["_k"]).drop("_k")
    return chosen.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("nth") <= most)


def evaluate_by_confidence(rows: DataFrame, confidence: str, hypothesis: str, root: str, traceability: str) -> DataFrame:
    """Mean traceability and match rate of every confidence."""
    has = ~F.lower(fx.strip(F.col(root))).isin("", "nenhum")
    match = has & (F.lower(F.col(hypothesis)) == F.lower(fx.strip(F.col(root))))
    return rows.groupBy(confidence).agg(F.count(F.lit(1)).alias("rows"), F.avg(traceability).alias("mean_traceability"), F.count_if(has).alias("evaluated"), F.count_if(match).alias("matches")).withColumn("match_rate", fx.ratio(F.col("matches"), F.col("evaluated")))


def frozen_evaluation(sessions: DataFrame, truth: Column, limit: int, score: str, threshold: float, length: str = "length", unknown: str = "unk") -> DataFrame:
    """Metrics of the trivial baseline, of a frozen detector, and of either, in one pass."""
    base = (F.col(unknown) > 0) | (F.col(length) <= limit)
    model = F.col(score) >= threshold
    marks = F.array(F.struct(F.lit("baseline").alias("rule"), base.alias("p")), F.struct(F.lit("model").alias("rule"), model.alias("p")), F.struct(F.lit("either").alias("rule"), (base | model).alias("p")))
    long = sessions.select(truth.alias("t"), F.explode(marks).alias("m")).select("t", "m.rule", "m.p")
    return calibrate.confusion(long, F.col("t"), F.col("p"), ["rule"])


def false_positive_strategies(scored: DataFrame, truth: Column, score: str, threshold: float, evidence: Column, revised: str | None = None, revised_threshold: float = 0.0) -> DataFrame:
    """Metrics of the base threshold, of base with evidence, and of a revised detector."""
    rules = [F.struct(F.lit("base").alias("rule"), (F.col(score) >= threshold).alias("p")), F.struct(F.lit("base_and_evidence").alias("rule"), ((F.col(score) >= threshold) & evidence).alias("p"))]
    if revised:
        rules.append(F.struct(F.lit("revised").alias("rule"), (F.col(revised) >= revised_threshold).alias("p")))
    long = scored.select(truth.alias("t"), F.explode(F.array(*rules)).alias("m")).select("t", "m.rule", "m.p")
    return calibrate.confusion(long, F.col("t"), F.col("p"), ["rule"])


def compare_detectors(scored: DataFrame, truth: Column, scores: list[str], least: float = 0.90) -> DataFrame:
    """For every detector its min-recall threshold, the metrics there, and its average precision."""
    out = None
    for s in scores:
        best = calibrate.min_recall_threshold(scored, s, truth, least)
        part = best.crossJoin(calibrate.average_precision(scored, s, truth)).withColumn("detector", F.lit(s))  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def pilot_report(assigned: DataFrame, text: str = "prepared", most: int = 10) -> DataFrame:
    """Templates marked frequent (the most events), rare (one event) or general (most wildcards), at most `most` of each."""
    t = assigned.filter("template_id > 0").groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("events"), F.min(text).alias("example"))
    t = t.withColumn("wildcards", F.size(F.filter(F.split("template", " "), lambda x: x == "<*>")))
    top = lambda kind, *o: t.orderBy(*o, "template_id").limit(most).withColumn("kind", F.lit(kind))
    rare = t.filter("events = 1").orderBy("template_id").limit(most).withColumn("kind", F.lit("rare"))
    return top("frequent", F.desc("events")).unionByName(rare).unionByName(top("general", F.desc("wildcards")))


def consolidate_manifests(manifests: dict[str, dict]) -> dict:
    """One report of many: names in order, all accepted or not, and which aren't."""
    bad = [k for k, m in manifests.items() if (m.get("acceptance", m)).get("accepted") is not True]
    return {"stages": sorted(manifests), "accepted": not bad, "not_accepted": sorted(bad), "results": {k: manifests[k].get("results", {}) for k in sorted(manifests)}}
