"""What the training-data operators share: the shared folder, cuts of the lineage, slices of text, joins on hot keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and that normalised texts lack: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that the vectorised code works on at once, and about the most bytes of an Arrow batch.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Rows whose fingerprints go to one owner, about.
OWNER_ROWS = 8192


#: Paths that new_path gave.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a new temporary one only where that is unset on one machine (tests). Raises on a cluster without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session is made to bound Arrow batches by bytes, not by rows alone: 10,000 rows of text may be any size, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    return df


def owners_for(df: DataFrame) -> int:
    """Owners of fingerprint ranges: enough that each has those of some thousand rows, however many rows df has."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // OWNER_ROWS)


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    _WRITTEN.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> None:
    """Removes what this application has written under the shared folder with new_path; for when no result is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors never make Spark repeat what came before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat "name type, ..." string; works on executors too."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def tidy() -> None:
    """Gives memory that is free back to the system: Python workers outlive their tasks, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """run, a function of batches, followed by tidy()."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def own_key(chunk: int, piece: int = 0) -> int:
    """The negative key under which a piece of a chunk's own row passes the owners: one of 2**30, so that they are spread over the tasks."""
    return -1 - ((chunk >> 32) * 1_000_003 + (chunk & 0xFFFFFFFF) * 7_919 + piece * 15_485_863) % (1 << 30)


def strip_spaces(col):
    """col without any of SPACES; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), SPACES, "")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 65_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most `most` bytes of text (a longer single text makes its own), each with the text's bytes and offsets. Null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), i + rows, len(col))
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row a key and in `weight` the rows of that key.

    At most 1,000 keys can hold over a thousandth of all rows each, so these few are broadcast whatever the input's size;
    the rest can't be skewed and joins by a shuffle.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = keyed.filter(F.col(weight) * 1000 > total)
    cold = keyed.filter(F.col(weight) * 1000 <= total).drop(weight)
    hot_keys = hot.select(*on).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_keys), on, "left")
    return marked.filter("_hot").drop("_hot").join(F.broadcast(hot.drop(weight)), on).unionByName(marked.filter("_hot is null").drop("_hot").join(cold, on, how), allowMissingColumns=True)
