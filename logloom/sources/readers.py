"""Scans: log text, label and split files, CSV directories, ZIP archives, accepted manifests."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx

#: The columns of the event files.
EVENT_COLUMNS = "@timestamp @version level level_value logger_name message stack_trace tc_app_name tc_domain tc_empresa tc_instance tc_primitive tc_profiles tc_service tc_service_canary tc_tenant tc_tenant_canary tc_terminal_id tc_trace_call_stack tc_trace_id tc_uri_host tc_uri_method tc_uri_path tc_uri_url tc_user tc_version thread_name traceId".split()


def with_ordinal(df: DataFrame, name: str = "ordinal", places: tuple[str, ...] = ()) -> DataFrame:
    """df with dense numbers from 1. One count per partition is shuffled, no row is.

    places: columns that say where a row's file and part of a file are (they go); rows are then numbered in their order, however
    Spark packs files into partitions. Without them the order is df's own.
    """
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    if not places:
        marked, places = marked.withColumn("_p", F.spark_partition_id()), ("_p",)
    counts = marked.groupBy(*places).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)  # one row a part of a file
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = marked.join(bases.select(*places, "_first", "_base"), list(places))
    return out.withColumn(name, F.col("_base") + F.col("_m") - F.col("_first") + 1).drop(*places, "_m", "_first", "_base")


def with_ordinal_by(df: DataFrame, group: str, name: str, places: tuple[str, ...]) -> DataFrame:
    """df with dense numbers from 1 within each group, in the order of places; every part of a file holds rows of one group."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    counts = marked.groupBy(group, *places).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy(group).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)  # one row a part of a file
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = marked.join(bases.select(group, *places, "_first", "_base"), [group, *places])
    return out.withColumn(name, F.col("_base") + F.col("_m") - F.col("_first") + 1).drop(*places, "_m", "_first", "_base")


def _places() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_id (from 1, files in the order of their paths), line, and decodes: whether the bytes were strict UTF-8. A lone carriage return ends no line."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.is_valid_utf8("value").alias("decodes"), F.regexp_replace("value", "\r$", "").alias("line"), *_places())
    return with_ordinal(raw, "line_id", ("_file", "_start")).select("line_id", "line", "decodes")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.filter(F.col("line_id") <= n)


def read_csv_tree(spark: SparkSession, path: str, columns: list[str] | None = None, required: tuple[str, ...] = (), ordinal: str | None = None, source: str | None = None) -> DataFrame:
    """All CSV files under path, as text; a missing value is an empty string. Every header must equal the first (or `columns`).

    Quoted fields may hold newlines and doubled quotes; byte order marks and gzip are understood. ordinal, source: columns for the
    row's number (from 1, files in the order of their paths) and its file's name.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").option("maxCharsPerColumn", -1).option("enforceSchema", False)
    df = reader.csv(path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    if columns is not None and names != columns:
        raise ValueError(f"columns differ: {names}")
    if missing := set(required) - set(names):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    named = [F.element_at(F.split("_metadata.file_path", "/"), -1).alias(source)] if source else []
    out = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(df.columns, names)], *named, *(_places() if ordinal else []))
    return with_ordinal(out, ordinal, ("_file", "_start")) if ordinal else out


def read_split(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "validation", "test"), labels: tuple[str, ...] = ("Normal", "Anomaly")) -> DataFrame:
    """A master split (BlockId, Label, Split) from CSV with exactly these columns. A row with a blank or repeated id, or another label or split, raises when it is met."""
    df = read_csv_tree(spark, path, columns=["BlockId", "Label", "Split"])
    same = Window.partitionBy("BlockId")
    wrong = F.when(fx.blank(F.col("BlockId")), "blank id").when(~F.col("Label").isin(*labels), "unknown label").when(~F.col("Split").isin(*splits), "unknown split").when(F.count(F.lit(1)).over(same) > 1, "repeated id")
    checked = df.withColumn("_wrong", wrong)
    return checked.select(F.when(F.col("_wrong").isNull(), F.col("BlockId")).otherwise(F.raise_error(F.concat("_wrong", F.lit(": "), "BlockId"))).alias("BlockId"), "Label", "Split")


def read_zip_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the CSV members of ZIP archives, undecodable bytes replaced. Members are read as streams, in batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(x for x in z.namelist() if x.lower().endswith(".csv")):
                        with z.open(member) as f:
                            rows = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline=""))
                            held = []
                            for r in rows:
                                held.append([f"{name}!{member}", *[r.get(c) or "" for c in columns]])
                                if len(held) >= 5000:
                                    yield pd.DataFrame(held, columns=["source_file", *columns])
                                    held = []
                            if held:
                                yield pd.DataFrame(held, columns=["source_file", *columns])

    schema = ", ".join(f"`{c}` string" for c in ["source_file", *columns])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the matrices in .npy files and of the members of .npz archives: source_file, member (empty in .npy), row (from 0), vector. Pickled objects are refused."""
    import numpy as np

    def rows(name: str, member: str, x: np.ndarray) -> Iterator[pd.DataFrame]:
        x = np.atleast_2d(x).astype(np.float64)
        for i in range(0, len(x), 5000):
            part = x[i : i + 5000]
            yield pd.DataFrame({"source_file": name, "member": member, "row": np.arange(i, i + len(part)), "vector": list(part)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                if isinstance(found, np.ndarray):
                    yield from rows(name, "", found)
                else:
                    for member in sorted(found.files):
                        yield from rows(name, member, found[member])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInPandas(run, "source_file string, member string, row long, vector array<double>")


def check_labels(rows: DataFrame, id_col: str = "BlockId", label_col: str = "Label", order: str = "row_no", labels: tuple[str, ...] = ("Normal", "Anomaly"), id_pattern: str = r"^blk_-?\d+$") -> DataFrame:
    """rows with `reason`: null if accepted, else the first that holds of blank, bad_id, bad_label, duplicate, conflict.

    The first row of an id wins; a later one with another label is a conflict.
    """
    i, v = fx.strip(F.col(id_col)), fx.strip(F.col(label_col))
    early = F.when((i == "") | (v == ""), "blank").when(~i.rlike(id_pattern), "bad_id").when(~v.isin(*labels), "bad_label")
    good = rows.withColumn("_early", early)
    w = Window.partitionBy(F.col("_early").isNull(), F.when(F.col("_early").isNull(), i).otherwise(F.col(order).cast("string"))).orderBy(order)
    good = good.withColumn("_nth", F.row_number().over(w)).withColumn("_first", F.first(v).over(w))
    late = F.when((F.col("_nth") > 1) & (v == F.col("_first")), "duplicate").when(F.col("_nth") > 1, "conflict")
    return good.withColumn("reason", F.coalesce("_early", late)).drop("_early", "_nth", "_first")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV with a header of BlockId and Label in any case and order; returns check_labels() of its rows."""
    df = spark.read.option("header", True).csv(path)
    names = {c.strip().lower().lstrip("﻿"): c for c in df.columns}
    if set(names) != {"blockid", "label"}:
        raise ValueError(f"unexpected header: {df.columns}")
    return check_labels(with_ordinal(df.select(F.col(f"`{names['blockid']}`").alias("BlockId"), F.col(f"`{names['label']}`").alias("Label")), "row_no"))


def strictly_increasing(df: DataFrame, key: str, order: str | None = None, partition: Column | None = None) -> DataFrame:
    """Rows whose key isn't above the one before it: none for a well-ordered table.

    partition: the groups that are ordered by themselves. Without it, rows are dealt out by ranges of the order; each range is
    checked by itself, and its first row against the last key of the ranges before it.
    """
    order = order or key
    if partition is not None:
        return df.withColumn("_before", F.lag(key).over(Window.partitionBy(partition).orderBy(order))).filter(F.col(key) <= F.col("_before")).drop("_before")
    dealt = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    ends = dealt.groupBy("_p").agg(F.max_by(key, order).alias("_last"))
    last = ends.select("_p", F.last("_last", True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_last"))  # one row a partition
    within = dealt.withColumn("_before", F.lag(key).over(Window.partitionBy("_p").orderBy(order)))
    return within.join(last, "_p").filter(F.col(key) <= F.coalesce("_before", "_last")).drop("_p", "_before", "_last")


def require_accepted(manifest: dict | str) -> dict:
    """The manifest, if it is accepted and has checks that are all true; else ValueError."""
    found = json.loads(manifest) if isinstance(manifest, str) else manifest
    acceptance = found.get("acceptance", found)
    checks = acceptance.get("checks") or {}
    if acceptance.get("accepted") is not True or not checks or any(v is not True for v in checks.values()):
        raise ValueError("manifest is not accepted")
    return found
