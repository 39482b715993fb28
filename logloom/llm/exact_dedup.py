"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each partition sends its sorted distinct 64-bit fingerprints, Golomb-Rice coded, to the owners of their ranges. An owner
answers every sender with a bitmap of the fingerprints that some other chunk or row has too. Only rows under such
fingerprints are suspects; only their texts are shuffled, grouped and compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import arrow, batch, bounded, cut, join_hot, own_key, owners_for, strip_spaces, tidied

#: Rows of one chunk: the unit that sends fingerprints and receives bitmaps.
CHUNK_ROWS = 65_536
#: Most bits (as a power of two) of the Bloom filter by which the second scan leaves out texts that can't be suspects: 32 MiB. It has a
#: dozen bits a suspect; past some twenty million suspects it lets more and more texts through that the join then drops.
BLOOM_BITS = 28

_MESSAGE = "chunk long, owner int, payload binary, ids binary, shas binary, lens binary"


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal count, held
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            held, chunk = [], (part << 32) | count
            count += 1
            fps = table.column("fp").to_numpy().view(np.uint64)
            distinct, times = np.unique(fps, return_counts=True)
            owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
            out = [(chunk, own_key(chunk), fps.tobytes(), table.column("row_id").to_numpy().tobytes(), b"".join(table.column("sha").to_pylist()), table.column("n").to_numpy().tobytes())]
            for o in range(owners):
                a, b = cuts[o], cuts[o + 1]
                if b > a:
                    out.append((chunk, o, golomb.encode(distinct[a:b]), np.packbits(times[a:b] > 1).tobytes(), None, None))
            yield batch(out, _MESSAGE)

        rows = 0
        for b in batches:
            for i in range(0, b.num_rows, CHUNK_ROWS):
                held.append(b.slice(i, CHUNK_ROWS))
                rows += held[-1].num_rows
                if rows >= CHUNK_ROWS:
                    yield from flush()
                    rows = 0
        yield from flush()

    return run


def _own(key: tuple, table: pa.Table) -> pa.Table:
    """One owner: a bitmap for each sender. What a chunk keeps for itself passes through."""
    if key[0].as_py() < 0:
        return table
    coded = [golomb.decode(x) for x in table.column("payload").to_pylist()]
    own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(table.column("ids").to_pylist(), coded)]
    values, times = np.unique(np.concatenate(coded), return_counts=True)
    several = times > 1
    maps = [np.packbits(several[np.searchsorted(values, v)] | o).tobytes() for v, o in zip(coded, own)]
    return table.select(["chunk", "owner"]).append_column("payload", pa.array(maps, pa.binary())).append_column("ids", pa.nulls(len(maps), pa.binary())).append_column("shas", pa.nulls(len(maps), pa.binary())).append_column("lens", pa.nulls(len(maps), pa.binary())).cast(arrow(_MESSAGE))


def _receive(owners: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["owner"] < 0)
        fps = np.frombuffer(base["payload"], np.uint64)
        distinct = np.unique(fps)
        owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        flags = np.zeros(len(distinct), bool)
        for r in rows:
            if r["owner"] >= 0:
                a, b = np.searchsorted(owner, np.array([r["owner"], r["owner"] + 1], np.uint64))
                flags[a:b] = np.unpackbits(np.frombuffer(r["payload"], np.uint8), count=b - a).astype(bool)
        shas = base["shas"]
        return pa.table({
            "row_id": pa.array(np.frombuffer(base["ids"], np.int64)),
            "n": pa.array(np.frombuffer(base["lens"], np.int32)),
            "fp": pa.array(fps.view(np.int64)),
            "sha": pa.array([shas[i : i + 32] for i in range(0, len(shas), 32)], pa.binary()),
            "suspect": pa.array(flags[np.searchsorted(distinct, fps)]),
        })

    return run


def _bloom_of(col: DataFrame, bits: int) -> golomb.Bloom:
    """A Bloom filter of the one long column of col: partitions fill tables, segments of them are or-ed, 2**bits bits reach the driver."""
    seg = 1 << 16

    def fill(batches):
        b = golomb.Bloom(bits)
        for x in batches:
            b.add(x.column(0).to_numpy(zero_copy_only=False))
        for i in range(0, len(b.table), seg):
            if b.table[i : i + seg].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // seg], pa.int32()), pa.array([b.table[i : i + seg].tobytes()], pa.binary())], ["seg", "data"])

    def merge(key, table):
        out = np.zeros(seg, np.uint8)
        for x in table.column("data").to_pylist():
            out[: len(x)] |= np.frombuffer(x, np.uint8)
        return pa.table({"seg": [key[0].as_py()], "data": [out.tobytes()]}, schema=pa.schema([("seg", pa.int32()), ("data", pa.binary())]))

    made = golomb.Bloom(bits)
    for r in col.mapInArrow(fill, "seg int, data binary").groupBy("seg").applyInArrow(merge, "seg int, data binary").collect():
        part = np.frombuffer(bytes(r["data"]), np.uint8)[: len(made.table) - r["seg"] * seg]
        made.table[r["seg"] * seg : r["seg"] * seg + len(part)] = part
    return made


def prune(df: DataFrame, key: str, wanted: DataFrame, size: int, then=None, schema=None) -> DataFrame:
    """The rows of df whose long column `key` may be in the one column of wanted, which has at most `size` rows; a join must follow for the exact rows.

    then, a function of batches, is applied to them in the same Python worker and gives rows of schema.
    """
    bits = min(BLOOM_BITS, max(16, (12 * size).bit_length()))
    shared = df.sparkSession.sparkContext.broadcast(_bloom_of(wanted, bits).table)

    def run(batches):
        bloom = golomb.Bloom(bits, shared.value)
        kept = (b.filter(pa.array(bloom.has(b.column(key).fill_null(0).to_numpy(zero_copy_only=False)))) for b in batches)
        yield from then(kept) if then else kept

    return df.mapInArrow(tidied(run), schema or df.schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (ASCII). Of equal ones the longest original, then the smallest id
    stays. Null text counts as empty; all empty texts are one group. Ties: repeated rows with one id and text form one
    group, and each of them that has the id that stays is marked kept. A null id is taken for the smallest long.
    An empty table gives an empty result; other columns are not looked at. Raises if two texts share a SHA-256.
    """
    owners = owners_for(docs)
    norm = strip_spaces(F.col(text_col))
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("row_id")
    base = bounded(docs).select(ids, F.unhex(F.sha2(norm, 256)).alias("sha"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), F.xxhash64(norm).alias("fp"))
    sent = base.mapInArrow(_send(owners), _MESSAGE)
    marked = cut(sent.groupBy("owner").applyInArrow(_own, _MESSAGE).groupBy("chunk").applyInArrow(_receive(owners), "row_id long, n int, fp long, sha binary, suspect boolean"), "dedup")

    # texts of suspects only, compared whole: the grouping key is the normalised text itself
    suspects = marked.filter("suspect")
    texts = docs.select(ids, norm.alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), F.xxhash64(norm).alias("fp"))
    texts = prune(texts, "fp", suspects.select("fp").distinct(), suspects.count())
    big = "18446744073709551616BD"  # 2**64
    rank = F.expr(f"cast(cast(n as decimal(12,0)) * {big} as decimal(38,0)) - cast(row_id as decimal(20,0))")
    grouped = texts.groupBy("norm").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("size"))
    grouped = grouped.filter("size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "best", "size")
    groups = grouped.groupBy("sha").agg(F.max("best").alias("best"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    groups = groups.withColumn("size", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share one SHA-256")).cast("long")))
    # best = n * 2**64 - id, |id| <= 2**63: the id is what is missing up to the nearest multiple
    over = f"pmod(best, {big})"
    keep = F.expr(f"cast(if({over} < 9223372036854775808BD, -{over}, {big} - {over}) as long)")
    keep = F.when(F.expr(f"{over} = 9223372036854775808BD"), F.lit(-(2**63)).cast("long")).otherwise(keep)
    groups = cut(groups.select("sha", keep.alias("keep_id"), F.col("size").alias("group_size"), F.col("size").alias("_w")), "groups")

    found = join_hot(suspects.select("row_id", "sha"), groups, ["sha"], "_w", "left")
    alone = marked.filter("not suspect").select("row_id", "sha", F.col("row_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    both = found.select("row_id", "sha", F.coalesce("keep_id", "row_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")).unionByName(alone)
    return both.select(F.col("row_id").alias(id_col), "keep_id", "group_size", (F.col("keep_id") == F.col("row_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
