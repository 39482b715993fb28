"""Events to sessions and traces: identity, indexes, counts, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx


def assign_trace(events: DataFrame, first: str = "tc_trace_id", second: str = "traceId") -> DataFrame:
    """events with analysis_trace_id (empty if none) and analysis_trace_id_source."""
    a, b = F.col(first), F.col(second)
    return events.withColumn("analysis_trace_id", F.coalesce(fx.trace_id(a, b), F.lit(""))).withColumn("analysis_trace_id_source", fx.trace_id_source(a, b))


def traceable(events: DataFrame) -> DataFrame:
    return events.filter(F.col("analysis_trace_id") != "")


def anonymize(events: DataFrame, salt: str, fields: tuple[str, ...]) -> DataFrame:
    return events.withColumns({c: fx.anonymize_text(F.coalesce(F.col(c), F.lit("")), salt) for c in fields if c in events.columns})


def sequential_tokens(rows: DataFrame, column: str, order: str, prefix: str) -> DataFrame:
    """value and token for every distinct value of column: <PREFIX_1> for the one that comes first by `order`, and so on.

    Values are dealt out by ranges of their first place; counts of the ranges say which number each begins at.
    """
    firsts = rows.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    dealt = firsts.repartitionByRange("_first", "value").withColumn("_p", F.spark_partition_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    number = F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy("_first", "value"))
    return dealt.join(F.broadcast(bases.select("_p", "_base")), "_p").select("value", F.concat(F.lit(f"<{prefix}_"), number.cast("string"), F.lit(">")).alias("token"))


def trace_index(events: DataFrame, trace: str = "analysis_trace_id", ts: str = "timestamp", service: str = "tc_service", ordinal: str = "ordinal") -> DataFrame:
    """One row a trace: counts by level, first and last time and ordinal, services. Times compare as text; blanks are never first."""
    when, lv, sv = fx.strip(F.col(ts)), fx.level_bucket(F.col("level")), fx.strip(F.col(service))
    out = events.groupBy(trace).agg(
        F.when(F.count_distinct("analysis_trace_id_source") > 1, "mixed").otherwise(F.min("analysis_trace_id_source")).alias("analysis_trace_id_source"),
        F.count(F.lit(1)).alias("event_count"),
        F.coalesce(F.min(F.nullif(when, F.lit(""))), F.lit("")).alias("first_timestamp"),
        F.max(when).alias("last_timestamp"),
        F.array_sort(F.collect_set(F.nullif(sv, F.lit("")))).alias("_services"),
        *[F.count_if(lv == x).alias(f"{x}_count") for x in ("info", "warn", "error", "other")],
        F.count_if(~fx.blank(F.col("stack_trace"))).alias("stack_trace_count"),
        F.min(ordinal).alias("first_event_ordinal"),
        F.max(ordinal).alias("last_event_ordinal"),
    )
    return out.withColumn("service_count", F.size("_services")).withColumn("services", F.array_join("_services", "|")).drop("_services")


def trace_features(events: DataFrame, trace: str = "tc_trace_id", service: str = "tc_service") -> DataFrame:
    """One row a trace with counts, rates and text flags; rows with a blank id are left out."""
    text = F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("stack_trace", F.lit("")))
    lv = fx.level_bucket(F.col("level"))
    out = events.filter(~fx.blank(F.col(trace))).groupBy(fx.strip(F.col(trace)).alias(trace)).agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.count_if(lv == x).alias(f"{x}_count") for x in ("info", "warn", "error", "other")],
        F.max((~fx.blank(F.col("stack_trace"))).cast("int")).alias("has_stack_trace"),
        F.count_distinct(F.nullif(fx.strip(F.col(service)), F.lit(""))).alias("service_count"),
        *[F.max(fx.has_term(text, t).cast("int")).alias(n) for n, t in fx.TERMS.items()],
    )
    out = out.withColumn("error_rate", fx.ratio(F.col("error_count"), F.col("event_count"))).withColumn("warn_rate", fx.ratio(F.col("warn_count"), F.col("event_count")))
    out = out.withColumn("text_signal_count", sum((F.col(n) for n in list(fx.TERMS)[1:]), F.col(list(fx.TERMS)[0])))
    any_signal = (F.col("error_count") > 0) | (F.col("warn_count") > 0) | (F.col("has_stack_trace") > 0) | (F.col("text_signal_count") > 0)
    return out.withColumn("has_any_signal", any_signal.cast("int"))


def extra_features(features: DataFrame) -> DataFrame:
    """The other rate and the logarithm of the length, and the profile of signals."""
    f = features.withColumn("other_rate", F.col("other_count") / F.greatest("event_count", F.lit(1))).withColumn("log_events", F.log1p(F.col("event_count").cast("double")))
    return f.withColumn("signal_profile", fx.signal_profile(F.col("error_count") > 0, F.col("warn_count") > 0, F.col("has_stack_trace") > 0, F.col("text_signal_count") > 0))


def level_coverage(events: DataFrame, trace: str = "analysis_trace_id") -> DataFrame:
    """How many traces have errors, warnings, or informational events only."""
    lv = fx.level(F.col("level"))
    per = events.groupBy(trace).agg(F.bool_or(lv == "ERROR").alias("e"), F.bool_or(lv == "WARN").alias("w"), F.bool_and(lv == "INFO").alias("i"))
    return per.agg(F.count(F.lit(1)).alias("traces"), F.count_if("e").alias("with_error"), F.count_if("w").alias("with_warn"), F.count_if("i").alias("only_info"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and percentages of the values of keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a value
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def template_histogram(assigned: DataFrame, trace: str = "analysis_trace_id", template: str = "template_id") -> DataFrame:
    """A map template -> count for each trace, and the same as text."""
    counts = assigned.groupBy(trace, template).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(trace).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(template).cast("int").alias("key"), F.col("n").alias("value"))))).alias("counts"))
    return out.withColumn("template_counts", fx.encode_counts(F.col("counts")))


def count_vector(assigned: DataFrame, templates: int, session: str = "block_id", template: str = "template_id") -> DataFrame:
    """Counts of templates 1..N, then of unknown ones (0 or null), as one array for each session, and its length."""
    known = F.col(template).between(1, templates)
    per = assigned.withColumn("_t", F.when(known, F.col(template).cast("int")).otherwise(templates + 1)).groupBy(session, "_t").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("_t", "n"))).alias("m"), F.sum("n").alias("length"))
    return out.select(session, "length", F.transform(F.sequence(F.lit(1), F.lit(templates + 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("counts"))


def check_counts(vectors: DataFrame, session: str = "block_id") -> DataFrame:
    """Vectors whose sum isn't their length: none if all is well."""
    return vectors.filter(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) != F.col("length")).select(session)


def sequences(assigned: DataFrame, session: str, order: str, template: str = "template_id") -> DataFrame:
    """The templates of each session in order, as an array and as text; unknown ones are 0."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(template), F.lit(0)).alias("t")))), lambda x: x["t"])
    out = assigned.groupBy(session).agg(ordered.alias("ids"))
    return out.select(session, F.size("ids").alias("length"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("sequence"))


def session_documents(events: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """The events' texts of each session joined by line feeds, and the SHA-256 of that."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    out = events.groupBy(session).agg(F.array_join(ordered, "\n").alias("document"), F.count(F.lit(1)).alias("length"))
    return out.withColumn("document_hash", F.sha2("document", 256))


def expand_sequences(seqs: DataFrame, templates: DataFrame, unknown: DataFrame, session: str = "block_id") -> DataFrame:
    """Texts of sequences (session, ids): a template's text for its id, and for each 0 the session's next unknown text in order.

    unknown has (session, line_id, text). A 0 without a text left stays null.
    """
    pos = seqs.select(session, F.posexplode("ids").alias("pos", "id"))
    zeros = pos.filter("id = 0").withColumn("nth", F.row_number().over(Window.partitionBy(session).orderBy("pos")))
    texts = unknown.select(session, F.col("text").alias("u_text"), F.row_number().over(Window.partitionBy(session).orderBy("line_id")).alias("nth"))
    filled = zeros.join(texts, [session, "nth"], "left").select(session, "pos", "id", F.col("u_text").alias("text"))
    known = pos.filter("id <> 0").join(templates.select(F.col("template_id").alias("id"), F.col("template").alias("text")), "id", "left").select(session, "pos", "id", "text")
    return known.unionByName(filled)


def zip_positional(left: DataFrame, right: DataFrame, on: str = "line_id", equal: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on ordinals; `aligned` says whether both sides have the row and agree in the columns `equal`."""
    r = right.select(F.col(on).alias("_on"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c != on])
    ok = F.col(on).isNotNull() & F.col("_on").isNotNull()
    out = left.join(r, F.col(on) == F.col("_on"), "full_outer")
    for c in equal:
        ok = ok & F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return out.withColumn("aligned", ok).withColumn(on, F.coalesce(on, "_on")).drop("_on")


def assign_split(events: DataFrame, split: DataFrame, ids: str = "block_ids") -> DataFrame:
    """events (with an array of ids) joined with split (block_id, label, split); `status`: assigned, unassigned, ambiguous or missing."""
    n = F.size(F.array_distinct(ids))
    one = events.withColumn("block_id", F.when(n == 1, F.element_at(ids, 1)))
    out = one.join(split, "block_id", "left")
    status = F.when(n == 0, "unassigned").when(n > 1, "ambiguous").when(F.col("split").isNull(), "missing").otherwise("assigned")
    return out.withColumn("status", status).withColumn("is_train_normal", (F.col("split") == "train") & (F.col("label") == "Normal"))


def reconcile(events: DataFrame, labels: DataFrame, key: str = "block_id") -> DataFrame:
    """Ids of one side that the other lacks, with `side`: no_label or no_event."""
    a, b = events.select(key).distinct(), labels.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("no_label")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("no_event")))


def log_audit(lines: DataFrame, content: str = "content") -> DataFrame:
    """One row of counters over parsed lines (content null where the header didn't parse)."""
    ids = fx.block_mentions(F.coalesce(F.col(content), F.lit("")))
    n, d = F.size(ids), F.size(F.array_distinct(ids))
    ok = F.col(content).isNotNull()
    flat = lines.select(ok.alias("ok"), n.alias("n"), d.alias("d"))
    return flat.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("unparseable"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("d"))), F.lit(0)).alias("associations"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("mentions"),
        F.count_if(F.col("ok") & (F.col("d") == 0)).alias("without_id"), F.count_if(F.col("ok") & (F.col("d") == 1)).alias("single_id"), F.count_if(F.col("ok") & (F.col("d") > 1)).alias("multiple_ids"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n") - F.col("d"))), F.lit(0)).alias("repeated_mentions"),
    )


def file_audit(events: DataFrame, file: Column, trace: str = "tc_trace_id", fallback: str = "traceId") -> DataFrame:
    """Rows, distinct ids, blanks and fallbacks of every file, and of all together (file null)."""
    t, f = fx.strip(F.col(trace)), fx.strip(F.col(fallback))
    flat = events.select(file.alias("file"), t.alias("t"), f.alias("f"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.nullif("t", F.lit(""))).alias("distinct_ids"), F.count_if(F.col("t") == "").alias("blank_ids"), F.count_if((F.col("t") == "") & (F.col("f") != "")).alias("fallback_ids")]
    return flat.groupBy("file").agg(*aggs).unionByName(flat.agg(*aggs).withColumn("file", F.lit(None).cast("string")))


def acceptance(counts: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: each named check and `accepted`, whether all hold."""
    flat = counts.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    all_of = F.lit(True)
    for n in checks:
        all_of = all_of & F.col(n)
    return flat.withColumn("accepted", all_of)


def offending_samples(rows: DataFrame, reason: str = "reason", order: str = "row_no", most: int = 10) -> DataFrame:
    """The first `most` rows of every reason."""
    return rows.filter(F.col(reason).isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy(reason).orderBy(order))).filter(F.col("nth") <= most)
