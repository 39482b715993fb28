"""Sinks: published tables that are never overwritten, manifests, reports, upserts, content hashes."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in a temporary one where that is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def content_hash(df: DataFrame) -> str:
    """A hash of df's rows that doesn't depend on their order or on files."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{r['n']}:{r['a']}:{r['b']}".encode()).hexdigest()


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> str:
    """Writes df as Parquet once. The same rows again are fine; other rows under the same path raise FileExistsError."""
    spark, digest = df.sparkSession, content_hash(df)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        if content_hash(spark.read.parquet(path)) != digest:
            raise FileExistsError(path)
        return digest
    writer = (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return digest


def write_routed(df: DataFrame, flag: Column, path: str) -> None:
    """One pass that writes rows to path/routed=true and path/routed=false."""
    df.withColumn("routed", F.coalesce(flag, F.lit(False))).write.mode("errorifexists").partitionBy("routed").parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').option("compression", compression).csv(path)


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def write_json(data: dict, path: str | Path, overwrite: bool = False) -> None:
    """Sorted keys, a line feed at the end, put in place by a rename."""
    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    part = Path(f"{path}.tmp")
    part.write_text(json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(part, path)


def store_json(spark: SparkSession, data: dict, path: str, overwrite: bool = False) -> None:
    """write_json for any store that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.tmp"))
    store = target.getFileSystem(conf)
    if store.exists(target):
        if not overwrite:
            raise FileExistsError(path)
        store.delete(target, False)
    out = store.create(part, True)
    out.write(bytearray((json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()
    store.rename(part, target)


def load_published(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """What publish() wrote, if its content hash is still this one; else ValueError."""
    df = spark.read.parquet(path)
    if (found := content_hash(df)) != digest:
        raise ValueError(f"{path} holds other rows: {found}")
    return df


def markdown_report(title: str, sections: dict[str, dict[str, object]]) -> str:
    lines = [f"# {title}", ""]
    for name, values in sections.items():
        lines += [f"## {name}", "", "| field | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in values.items()], ""]
    return "\n".join(lines)


def resolve_under(root: str | Path, relative: str) -> Path:
    """The path of relative under root; ValueError if it leads out."""
    base = Path(root).resolve()
    found = (base / relative).resolve()
    if not found.is_relative_to(base):
        raise ValueError(f"path leaves the root: {relative}")
    return found


def upsert_keep_manual(fresh: DataFrame, existing: DataFrame, key: str, manual: tuple[str, ...]) -> DataFrame:
    """fresh with the manual columns of existing kept by key."""
    old = existing.select(key, *[F.col(c).alias(f"_old_{c}") for c in manual])
    base = fresh.drop(*manual).join(old, key, "left")
    return base.select(*[c for c in fresh.columns if c not in manual], *[F.coalesce(f"_old_{c}", F.lit("")).alias(c) for c in manual])


def upsert_latest(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with the rows of new in place of those with the same key; of several new ones the last by order."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(order)).alias("r")).select("r.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)
