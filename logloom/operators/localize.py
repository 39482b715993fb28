"""Which services a trace's evidence points to: statistics, rankings, agreement, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx

FAR = 2**62
ROOTLESS = ("", "nenhum", "none", "nao_aplicavel", "não_aplicável")


def alerted(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("alert_level").isin("review", "high_confidence"))


def of_alerts(events: DataFrame, alerts: DataFrame, trace: str = "analysis_trace_id") -> DataFrame:
    """Events of alerted traces."""
    return events.join(alerted(alerts).select(trace), trace, "left_semi")


def service_stats(assigned: DataFrame, trace: str = "analysis_trace_id", service: str = "tc_service", ordinal: str = "ordinal") -> DataFrame:
    sv, lv = F.coalesce(F.nullif(fx.strip(F.col(service)), F.lit("")), F.lit("<unknown_service>")), fx.level(F.col("level"))
    return assigned.groupBy(trace, sv.alias("tc_service")).agg(
        F.count(F.lit(1)).alias("service_events"), F.count_if(lv == "ERROR").alias("service_errors"), F.count_if(lv == "WARN").alias("service_warns"),
        F.count_distinct(F.coalesce("template_id", F.lit(0))).alias("service_unique_templates"), F.min(ordinal).alias("first_event_ordinal"),
    )


def rank(df: DataFrame, group: str | list[str], *order: Column, name: str = "candidate_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)))


def rank_services(stats: DataFrame, trace: str = "analysis_trace_id") -> DataFrame:
    """Errors, distinct templates, events (most first), first ordinal, name."""
    return rank(stats, trace, F.desc("service_errors"), F.desc("service_unique_templates"), F.desc("service_events"), F.asc("first_event_ordinal"), F.asc("tc_service"))


def signal_stats(events: DataFrame, trace: str = "tc_trace_id", ordinal: str = "ordinal") -> DataFrame:
    """Per trace and service: events, errors, stacks, text signals, first time, its and the first signal's ordinal, call stack hits."""
    sv = F.coalesce(F.nullif(fx.strip(F.col("tc_service")), F.lit("")), F.lit("<UNKNOWN_SERVICE>"))
    text = F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("stack_trace", F.lit("")))
    e = events.select(F.col(trace), sv.alias("service"), fx.level(F.col("level")).alias("lv"), (~fx.blank(F.col("stack_trace"))).alias("stack"), fx.any_term(text).alias("text"), fx.strip(F.col("timestamp")).alias("ts"), F.col(ordinal).alias("o"), F.col("tc_trace_call_stack").alias("cs"))
    signal = (F.col("lv") == "ERROR") | F.col("stack") | F.col("text")
    return e.groupBy(trace, "service").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("lv") == "ERROR").alias("error_count"), F.count_if("stack").alias("stack_count"), F.count_if("text").alias("text_count"),
        F.min("ts").alias("first_timestamp"), F.min_by("o", F.struct("ts", "o")).alias("first_event_index"), F.coalesce(F.min(F.when(signal, F.col("o"))), F.lit(0)).alias("first_signal_index"),
        F.sum(fx.call_stack_hits(F.col("cs"), F.col("service"))).alias("callstack_hits"),
    )


def rank_signals(stats: DataFrame, trace: str = "tc_trace_id") -> DataFrame:
    """Errors, stacks, text signals (most first), first time, name."""
    return rank(stats, trace, F.desc("error_count"), F.desc("stack_count"), F.desc("text_count"), F.asc("first_timestamp"), F.asc("service"))


def ranking_variants(stats: DataFrame, trace: str = "tc_trace_id") -> DataFrame:
    """(trace, variant, service, rank) of four ways to rank. A service without signal comes last in time."""
    per = lambda c: F.col(c) / F.col("event_count")
    late = F.when(F.col("first_signal_index") == 0, FAR).otherwise(F.col("first_signal_index"))
    # one sort key a variant: arrays of doubles compare element by element, small first
    d = lambda c: c.cast("double")
    col = lambda n: F.col(n)
    w = lambda *o: F.row_number().over(Window.partitionBy(trace).orderBy(*o))
    keyed = stats.select(
        trace, "service",
        w(F.desc("error_count"), F.desc("stack_count"), F.desc("text_count"), F.asc("first_timestamp"), F.asc("service")).alias("raw_evidence"),
        w(-per("error_count"), -per("stack_count"), -per("text_count"), F.desc("error_count"), F.asc("service")).alias("volume_normalized"),
        w(late, F.desc("error_count"), F.desc("stack_count"), F.asc("service")).alias("temporal_first_signal"),
        w(F.desc("callstack_hits"), F.desc("error_count"), F.desc("stack_count"), late, F.asc("service")).alias("call_stack_evidence"),
    )
    names = ["raw_evidence", "volume_normalized", "temporal_first_signal", "call_stack_evidence"]
    return keyed.select(trace, "service", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("rank")) for n in names])).alias("x")).select(trace, "x.variant", "service", "x.rank")


def variant_agreement(ranked: DataFrame, base: str = "raw_evidence", trace: str = "tc_trace_id") -> DataFrame:
    """Share of traces whose best service is the same as the base variant's."""
    top = ranked.filter("rank = 1").withColumn("_b", F.max(F.when(F.col("variant") == base, F.col("service"))).over(Window.partitionBy(trace)))
    return top.groupBy("variant").agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.col("service") == F.col("_b")).alias("agree")).withColumn("rate", fx.ratio(F.col("agree"), F.col("traces")))


def entity_stats(events: DataFrame, vocabulary: DataFrame, trace: str = "tc_trace_id", ordinal: str = "ordinal", logical: tuple[str, ...] = fx.LOGICAL_COMPONENTS) -> DataFrame:
    """Per trace and entity: how often it emitted, was mentioned or stood in a call stack, and its first signals.

    vocabulary has one column `service`. It is small (the names of services), and becomes one array; every text is searched for its entries.
    """
    names = vocabulary.filter(F.col("service") != "").select("service").distinct().agg(F.array_sort(F.collect_list("service")).alias("names"))
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("message", "stack_trace", "logger_name", "tc_trace_call_stack")])
    emitter = F.coalesce(F.nullif(fx.strip(F.col("tc_service")), F.lit("")), F.lit("<UNKNOWN_SERVICE>"))
    e = events.join(F.broadcast(names)).select(F.col(trace), F.col(ordinal).alias("o"), emitter.alias("emitter"), (fx.level(F.col("level")) == "ERROR").alias("err"), text.alias("text"), fx.call_stack_services(F.col("tc_trace_call_stack")).alias("stack"), "names")
    said = F.concat(F.filter("names", lambda s: F.contains(F.col("text"), s)), F.filter(F.array(*[F.lit(x) for x in logical]), lambda s: F.regexp_like(F.col("text"), F.concat(F.lit(r"(?iU)\b"), s, F.lit(r"\b")))))
    e = e.withColumn("said", F.array_distinct(said))
    every = e.withColumn("entity", F.explode(F.array_distinct(F.concat(F.array("emitter"), "said", "stack"))))
    own, told, stacked = F.col("entity") == F.col("emitter"), F.array_contains("said", F.col("entity")), F.array_contains("stack", F.col("entity"))
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("o"))), F.lit(0))
    out = every.groupBy(trace, "entity").agg(
        F.count_if(own).alias("emitter_events"), F.count_if(own & F.col("err")).alias("emitter_errors"), F.count_if(told).alias("mention_events"), F.count_if(told & F.col("err")).alias("mention_errors"),
        F.count_if(stacked).alias("callstack_hits"), first(told | F.col("err")).alias("first_signal_index"), first(F.col("err")).alias("first_error_index"),
        F.concat_ws("+", F.max(F.when(stacked, "callstack")), F.max(F.when(own, "emitter")), F.max(F.when(told, "mentioned"))).alias("entity_sources"),
    )
    return out


_ENTITY_SUMS = ("emitter_events", "emitter_errors", "mention_events", "mention_errors", "callstack_hits")


def rank_entities(stats: DataFrame, trace: str = "tc_trace_id") -> DataFrame:
    late = F.when(F.col("first_signal_index") == 0, FAR).otherwise(F.col("first_signal_index"))
    return rank(stats, trace, F.desc("mention_errors"), F.desc("callstack_hits"), F.desc("emitter_errors"), F.desc("mention_events"), late, F.asc("entity"), name="rank")


def canonical_entities(stats: DataFrame, vocabulary: DataFrame, trace: str = "tc_trace_id") -> DataFrame:
    """entity_stats under canonical names, summed; names that have none are dropped."""
    names = vocabulary.filter(F.col("service") != "").select(F.lower("service").alias("s")).distinct().agg(F.array_sort(F.collect_list("s")).alias("names"))
    c = stats.join(F.broadcast(names)).withColumn("entity", fx.canonical_name(F.col("entity"), F.col("names"))).filter("entity is not null").drop("names")
    first = lambda n: F.coalesce(F.min(F.nullif(F.col(n), F.lit(0))), F.lit(0)).alias(n)
    sources = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split("entity_sources", r"\+"))), lambda x: x != ""))), "+")
    return c.groupBy(trace, "entity").agg(*[F.sum(n).alias(n) for n in _ENTITY_SUMS], first("first_signal_index"), first("first_error_index"), sources.alias("entity_sources"))


def scheduler_boost(stats: DataFrame, events: DataFrame, trace: str = "tc_trace_id", ordinal: str = "ordinal") -> DataFrame:
    """entity_stats with the scheduler credited for every event that names it as the cause, ranked with those first."""
    text = F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("stack_trace", F.lit("")))
    hits = events.filter(fx.names_scheduler(text)).groupBy(trace).agg(F.count(F.lit(1)).alias("m"), F.min(ordinal).alias("f")).withColumn("entity", F.lit("scheduler"))
    s = stats.join(hits, [trace, "entity"], "full_outer").na.fill(0, [*_ENTITY_SUMS, "first_signal_index", "first_error_index", "m"])
    s = s.withColumn("mention_errors", F.col("mention_errors") + F.col("m")).withColumn("mention_events", F.col("mention_events") + F.col("m"))
    s = s.withColumn("first_signal_index", F.when(F.col("m") > 0, F.col("f")).otherwise(F.col("first_signal_index")))
    s = s.withColumn("entity_sources", F.concat_ws("+", F.nullif("entity_sources", F.lit("")), F.when(F.col("m") > 0, "explicit_scheduler_rule"))).withColumnRenamed("m", "explicit_scheduler_matches").drop("f")
    late = F.when(F.col("first_signal_index") == 0, FAR).otherwise(F.col("first_signal_index"))
    return rank(s, trace, F.desc("explicit_scheduler_matches"), F.desc("mention_errors"), F.desc("callstack_hits"), F.desc("emitter_errors"), F.desc("mention_events"), late, F.asc("entity"), name="rank")


def top_columns(ranked: DataFrame, trace: str, name: str, rank_col: str, k: int = 3) -> DataFrame:
    """The k best of each trace as columns top_candidate_1 and on, empty where there are fewer."""
    aggs = [F.coalesce(F.max(F.when(F.col(rank_col) == i, F.col(name))), F.lit("")).alias(f"top_candidate_{i}") for i in range(1, k + 1)]
    return ranked.filter(F.col(rank_col) <= k).groupBy(trace).agg(*aggs)


def evaluate(ranked: DataFrame, roots: DataFrame, trace: str = "tc_trace_id", name: str = "entity", rank_col: str = "rank", category: str = "category") -> DataFrame:
    """Top-1 and top-3 rates over all traces that have a root (category null), and by category."""
    r = roots.filter(~F.lower(fx.strip(F.col("root"))).isin(*ROOTLESS))
    hit = r.join(ranked.select(F.col(trace), F.lower(F.col(name)).alias("_n"), F.col(rank_col).alias("_r")), trace, "left")
    best = hit.groupBy(trace, category, "root").agg(F.min(F.when(F.col("_n") == F.lower("root"), F.col("_r"))).alias("root_rank"))
    aggs = [F.count(F.lit(1)).alias("cases"), F.count_if(F.col("root_rank") == 1).alias("top1"), F.count_if(F.col("root_rank") <= 3).alias("top3")]
    out = best.groupBy(category).agg(*aggs).unionByName(best.agg(*aggs).withColumn(category, F.lit(None).cast("string")))
    return out.withColumn("top1_rate", fx.ratio(F.col("top1"), F.col("cases"))).withColumn("top3_rate", fx.ratio(F.col("top3"), F.col("cases")))


def agreement(rows: DataFrame, root: str = "root_service_manual", k: int = 3) -> DataFrame:
    """root_in_top3 (sim, nao, or empty without a root) and root_candidate_rank."""
    r = fx.strip(F.col(root))
    place = F.coalesce(*[F.when(F.col(f"top_candidate_{i}") == r, F.lit(str(i))) for i in range(1, k + 1)], F.lit(""))
    none = (r == "") | (r == "nenhum")
    return rows.withColumn("root_candidate_rank", F.when(none, "").otherwise(place)).withColumn("root_in_top3", F.when(none, "").when(F.col("root_candidate_rank") != "", "sim").otherwise("nao"))
