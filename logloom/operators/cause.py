"""Cause hypotheses with the evidence they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx

LIMITATION = "hipótese baseada em evidência do trace; não prova causalidade"


def trace_evidence(events: DataFrame, trace: str = "analysis_trace_id", ordinal: str = "ordinal") -> DataFrame:
    """First event, first error, and first explicit component of every trace, in file order, from one aggregation."""
    e = events.select(F.col(trace), F.struct(F.col(ordinal).alias("ordinal"), fx.strip(F.col("tc_service")).alias("service"), fx.level(F.col("level")).alias("level"), fx.strip(F.col("message")).alias("message")).alias("e"))
    e = e.withColumn("x", fx.explicit_component(F.col("e.message")))
    return e.groupBy(trace).agg(
        F.min_by("e", F.col("e.ordinal")).alias("first_event"),
        F.min_by("e", F.when(F.col("e.level") == "ERROR", F.col("e.ordinal"))).alias("first_error"),
        F.min_by(F.struct("x", "e"), F.when(F.col("x") != "", F.col("e.ordinal"))).alias("explicit"),
    )


def hypotheses(alerts: DataFrame, events: DataFrame, candidates: DataFrame, trace: str = "analysis_trace_id", score: str = "anomaly_score") -> DataFrame:
    """One row an alerted trace: the first of explicit component, first error's service, best candidate, entry service that there is."""
    wanted = alerts.filter(F.col("alert_level").isin("review", "high_confidence"))
    ev = trace_evidence(events.join(wanted.select(trace), trace, "left_semi"), trace)
    top = candidates.filter("candidate_rank = 1").select(trace, F.col("tc_service").alias("candidate_service_top1"))
    j = wanted.join(ev, trace, "left").join(top, trace, "left")
    said, err, cand = F.coalesce(F.col("explicit.x"), F.lit("")), F.col("first_error"), F.coalesce("candidate_service_top1", F.lit(""))
    source = F.when(said != "", "explicit_logical_component").when(err.isNotNull(), "first_error_service").when(cand != "", "candidate_service_top1").otherwise("entry_service")
    j = j.withColumn("hypothesis_source", source).withColumn("_e", F.when(said != "", F.col("explicit.e")).when(err.isNotNull(), err).otherwise(F.col("first_event")))
    entry = F.coalesce(F.col("first_event.service"), F.lit(""))
    s = F.col("hypothesis_source")
    hypothesis = F.when(s == "explicit_logical_component", said).when(s == "first_error_service", err["service"]).when(s == "candidate_service_top1", cand).otherwise(entry)
    return j.select(
        trace, "alert_level", F.col(score).alias("anomaly_score"), F.coalesce("manual_label", F.lit("")).alias("manual_label"), hypothesis.alias("hypothesis_service"), "hypothesis_source",
        cand.alias("candidate_service_top1"), F.coalesce(err["service"], F.lit("")).alias("first_error_service"), entry.alias("entry_service"), said.alias("explicit_logical_component"),
        F.col("_e.ordinal").alias("evidence_event_ordinal"), F.when(s == "explicit_logical_component", "").otherwise(F.coalesce(F.col("_e.level"), F.lit(""))).alias("evidence_level"),
        F.left(F.coalesce(F.col("_e.message"), F.lit("")), F.lit(1000)).alias("evidence_message"), F.lit(LIMITATION).alias("limitation"),
    )


def _counted(df: DataFrame, trace: str, value: str, out: str, most: int | None, form: str) -> DataFrame:
    """The values of each trace by count (ties: seen first), as text."""
    n = df.groupBy(trace, value).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("f"))
    n = n.withColumn("i", F.row_number().over(Window.partitionBy(trace).orderBy(F.desc("n"), "f")))
    if most:
        n = n.filter(F.col("i") <= most)
    text = {"pair": F.concat_ws(":", value, F.col("n").cast("string")), "value": F.col(value), "times": F.concat(F.lit("x"), F.col("n").cast("string"), F.lit(" "), F.col(value))}[form]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"])
    return n.groupBy(trace).agg(F.array_join(ordered, " || " if form == "times" else "|").alias(out), F.count(F.lit(1)).alias(f"_n_{out}"))


def build_evidence(events: DataFrame, trace: str = "tc_trace_id", ordinal: str = "ordinal") -> DataFrame:
    """One row a trace: window, tenants, users, error services, first error and the four most frequent warnings.

    Events are ordered by their time as text, then by ordinal.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    e = events.select(trace, c("timestamp").alias("ts"), F.col(ordinal).alias("seq"), c("tc_service").alias("service"), c("tc_tenant").alias("tenant"), c("tc_user").alias("user"), c("level").alias("level"), c("logger_name").alias("logger"), c("tc_primitive").alias("primitive"), c("message").alias("message"), c("stack_trace").alias("stack"))
    e = e.withColumn("o", F.struct("ts", "seq"))
    row = F.struct("ts", "service", "tenant", "logger", "primitive", "message", "stack")
    base = e.groupBy(trace).agg(
        F.min_by(row, "o").alias("a"), F.max_by(F.col("ts"), F.col("o")).alias("z"), F.count(F.lit(1)).alias("raw_event_count"), F.count_if(F.col("level") == "ERROR").alias("error_count"), F.count_if(F.col("level") == "WARN").alias("warn_count"),
        F.min_by(row, F.when(F.col("level") == "ERROR", F.col("o"))).alias("x"),
    )
    pattern = F.concat(F.col("service"), F.lit("/"), fx.short_logger(F.col("logger")), F.lit(": "), fx.normalize_message(F.col("message")))
    warns = e.filter("level = 'WARN'").select(trace, "o", pattern.alias("p"))
    out = base.join(_counted(e, trace, "tenant", "tenants_observed", None, "pair"), trace).join(_counted(e, trace, "user", "trigger_user", 2, "value"), trace)
    out = out.join(_counted(e.filter("level = 'ERROR'"), trace, "service", "error_services", None, "pair"), trace, "left").join(_counted(warns, trace, "p", "top_warn_patterns", 4, "times"), trace, "left")
    start, end = fx.parse_ts(F.col("a.ts")), fx.parse_ts(F.col("z"))
    text = lambda col: F.coalesce(col, F.lit(""))
    return out.select(
        trace, text(F.col("tenants_observed")).alias("tenants_observed"), F.col("_n_tenants_observed").alias("tenant_count"), "trigger_user", F.col("a.service").alias("entry_service"), F.col("a.primitive").alias("entry_primitive"),
        F.col("a.ts").alias("window_start"), F.col("z").alias("window_end"), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).alias("duration_ms"), "raw_event_count", "error_count", "warn_count", text(F.col("error_services")).alias("error_services"),
        text(F.col("x.ts")).alias("first_error_timestamp"), text(F.col("x.service")).alias("first_error_service"), text(F.col("x.tenant")).alias("first_error_tenant"), text(fx.short_logger(F.col("x.logger"))).alias("first_error_logger"),
        text(F.col("x.primitive")).alias("first_error_primitive"), F.left(fx.collapse(F.col("x.message")), F.lit(300)).alias("first_error_message"), fx.exception_head(F.col("x.stack")).alias("first_exception"), text(F.col("top_warn_patterns")).alias("top_warn_patterns"),
    )


def _evidence_text():
    return F.concat_ws(" ", "first_error_message", "first_exception", "top_warn_patterns")


def simple_hypotheses(evidence: DataFrame) -> DataFrame:
    """scheduler if the text names it (high), else the first error's service (medium), else the entry service (low)."""
    named, err = fx.names_scheduler(_evidence_text()), fx.strip(F.col("first_error_service"))
    entry = F.coalesce(F.nullif(fx.strip(F.col("entry_service")), F.lit("")), F.lit("<UNKNOWN_SERVICE>"))
    pick = lambda a, b, c: F.when(named, a).when(err != "", b).otherwise(c)
    return evidence.withColumns({"hypothesis_entity": pick(F.lit("scheduler"), err, entry), "hypothesis_source": pick(F.lit("explicit_logical_component"), F.lit("first_error_service"), F.lit("entry_service")), "relative_confidence": pick(F.lit("high_relative"), F.lit("medium_relative"), F.lit("low_relative")), "explicit_scheduler_evidence": named.cast("int")})


def explainable_hypotheses(evidence: DataFrame) -> DataFrame:
    """The hypothesis, the kind of evidence for it, and all candidates in order without repeats."""
    named, targets = fx.names_scheduler(_evidence_text()), fx.target_services(_evidence_text())
    services = F.transform(F.filter(F.split("error_services", r"\|"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.substring_index(x, ":", 1))
    err, entry = fx.strip(F.col("first_error_service")), fx.strip(F.col("entry_service"))
    some = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.when(named, F.array(F.lit("scheduler"))).otherwise(F.array().cast("array<string>")), targets, services, some(err), some(entry)))
    many, told = (F.size(services) > 1) & named, (F.size(services) == 0) & (F.size(targets) > 0)
    kind = F.when(many, "logical_component_plus_multiple_error_services").when(told, "explicit_service_target_without_error").when(named, "explicit_logical_component").when(err != "", "first_error_service").otherwise("entry_service")
    what = F.when(many, "MULTI_HYPOTHESIS").when(told, F.try_element_at(targets, F.lit(1))).when(named, "scheduler").when(err != "", err).otherwise(F.coalesce(F.nullif(entry, F.lit("")), F.lit("<UNKNOWN_SERVICE>")))
    return evidence.withColumns({"hypothesis": what, "evidence_type": kind, "candidate_entities": F.array_join(every, "|"), "target_entities": F.array_join(targets, "|"), "error_service_names": F.array_join(services, "|")})


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which each field isn't blank, of all rows, one row a field."""
    n = F.count(F.lit(1))
    parts = [F.struct(F.lit(f).alias("field"), F.count_if(~fx.blank(F.col(f).cast("string"))).alias("present"), n.alias("total")) for f in fields]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*").withColumn("rate", fx.ratio(F.col("present"), F.col("total")))


def consolidate(alerts: DataFrame, services: DataFrame, causes: DataFrame, trace: str = "analysis_trace_id") -> DataFrame:
    return alerts.join(services, trace, "left").join(causes, trace, "left")


def pick_examples(alerts: DataFrame, found: DataFrame, trace: str = "analysis_trace_id", score: str = "anomaly_score") -> DataFrame:
    """The best trace under each of five rules that no rule before it took. One row a rule that finds any."""
    extra = [c for c in found.columns if c not in ("alert_level", "manual_label", score)]
    data = alerts.join(found.select(*extra), trace)
    long = F.length(F.coalesce("evidence_message", F.lit("")))
    rules = [
        ("high_confidence_first_error", (F.col("alert_level") == "high_confidence") & (F.col("hypothesis_source") == "first_error_service"), []),
        ("review_candidate", (F.col("alert_level") == "review") & (F.col("hypothesis_source") == "candidate_service_top1"), []),
        ("highest_score", F.lit(True), []),
        ("high_confidence_long_evidence", F.col("alert_level") == "high_confidence", [long.desc()]),
        ("review_with_error", (F.col("alert_level") == "review") & (F.coalesce("first_error_service", F.lit("")) != ""), []),
    ]
    # five best of each rule are enough: the rules before it can take four of them
    best = None
    for i, (name, keep, order) in enumerate(rules):
        part = data.filter(keep).orderBy(*order, F.desc(score), trace).limit(len(rules)).select(trace)
        part = part.withColumn("rule_no", F.lit(i)).withColumn("selection_reason", F.lit(name)).withColumn("nth", F.monotonically_increasing_id())
        best = part if best is None else best.unionByName(part)
    used, chosen = set(), []
    for r in sorted(best.collect(), key=lambda r: (r["rule_no"], r["nth"])):
        if r[trace] not in used and all(c[0] != r["rule_no"] for c in chosen):
            used.add(r[trace])
            chosen.append((r["rule_no"], r["selection_reason"], r[trace]))
    picks = data.sparkSession.createDataFrame(chosen, f"rule_no int, selection_reason string, {trace} string")
    return F.broadcast(picks).join(data, trace)


def review_sheet(alerts: DataFrame, tops: DataFrame, evidence: DataFrame, trace: str = "tc_trace_id") -> DataFrame:
    """Rows for a reviewer: three candidates, the observed fact, and empty columns to fill in."""
    out = alerts.join(tops, trace, "left").join(evidence, trace, "left")
    fact = F.concat_ws("; ", F.concat(F.lit("errors="), F.col("error_count").cast("string")), F.concat(F.lit("first_error="), F.col("first_error_service")), F.concat(F.lit("entry="), F.col("entry_service")))
    blank = ["interpretation_manual", "cause_hypothesis_manual", "evidence_reference_manual", "confidence_manual", "alternative_hypothesis_manual", "root_service_manual"]
    return out.withColumn("observed_fact_automatic", fact).withColumns({c: F.lit("") for c in blank})
