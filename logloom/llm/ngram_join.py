"""Jaccard join of 5-word shingle sets by a size-aware heavy-light join, with connected components of the links.

1. Every text gives its shingle count, a 128-bit key of its set (texts with one key are one class), and fingerprints of its
   shingles. A chunk of texts sends its distinct ones, Golomb-coded, to the owners of their ranges; an owner answers with a
   bitmap of those that some other text has too. To link with anything a set needs three quarters of its shingles shared, so
   all other texts are done.
2. One text of each class left sends its full shingles the same way and learns how many classes have each of them.
3. Candidates. In one order (rarest first) two sets that link share a shingle of their prefixes, and two of the prefixes one
   longer. Small sets enumerate the fixed-size subsets (pairs) of their longer prefix and meet under a common pair; large sets
   meet under the inverted lists of single prefix shingles, which small sets near the boundary join. The boundary is the size
   where the pairs to enumerate begin to cost more than the lists to scan. A list links its members to the least one: lists are
   never expanded into pairs.
4. Components of these candidates bring together whole sets, one copy each; large ones are cut into blocks of sets of like size,
   and every pair of blocks counts overlaps exactly through a local inverted index. What leaves a block is one row a set: its
   number of links and its least partner's root.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import arrow, batch, bounded, cut, join_hot, own_key, owners_for, slices, tidied, tidy
from .components import components
from .exact_dedup import prune
from .wordhash import shingles, words

#: Shingle length in words; links need PER_CENT * union <= 100 * intersection.
K, PER_CENT = 5, 75
#: Bits of the fingerprints in step 1: log2 of all shingles plus a few, so that few are shared by chance (which costs work only).
FP_BITS = 48
#: A chunk closes at so many texts or shingles.
CHUNK_TEXTS, CHUNK_SHINGLES = 32_768, 1 << 20
#: What a chunk keeps for itself passes the owners in pieces of so many bytes.
PIECE_BYTES = 1 << 16
#: Sets in a block of step 4.
BLOCK = 1024
#: Set sizes up to this one are weighed one by one for the boundary, larger ones in classes of eight to a doubling.
EXACT_SIZES = 64
#: What an entry in the list of one shingle costs, in entries under pairs: its candidates are more often false and have to be verified.
LIST_COST = 8

_MESSAGE = "chunk long, owner int, payload binary, extra binary"


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _needed(n):
    """Least overlap of a set of n with any set it links to."""
    return -(-PER_CENT * n // 100)


def _sets(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of every text."""
    h, by = words(raw, off)
    s, first = shingles(h, by, K)
    return [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that don't depend on its order."""
    a, b = golomb.mix(s), golomb.mix(s ^ np.uint64(0x94D049BB133111EB))
    return int(np.add.reduce(a, dtype=np.uint64).view(np.int64)), int(np.add.reduce(b, dtype=np.uint64).view(np.int64))


class _Sender:
    """Collects sets, and closes a chunk into one row for itself and one for each owner: every shingle of the chunk once."""

    def __init__(self, owners: int, bits: int, full: bool) -> None:
        self.owners, self.shift, self.full, self.part, self.count = owners, np.uint64(64 - bits), full, TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.sets, self.size = [], [], 0

    def add(self, row_id: int, s: np.ndarray) -> bool:
        self.ids.append(row_id)
        self.sets.append(s)
        self.size += len(s)
        return self.size >= CHUNK_SHINGLES or len(self.ids) >= CHUNK_TEXTS

    def close(self) -> list[tuple]:
        if not self.ids:
            return []
        chunk = (self.part << 32) | self.count
        self.count += 1
        counts = np.array([len(s) for s in self.sets], np.int64)
        every = np.concatenate(self.sets)
        base = [np.array([len(counts)], np.int64).tobytes(), np.array(self.ids, np.int64).tobytes(), counts.tobytes()]
        if self.full:
            distinct, times = np.unique(every, return_counts=True)
            base.append(every.tobytes())
        else:
            order = np.argsort(every >> self.shift, kind="stable")
            h, text = every[order], np.repeat(np.arange(len(counts), dtype=np.uint16), counts)[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] >> self.shift != h[:-1] >> self.shift
            distinct = h[new]
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            base += [np.array([_key(s) for s in self.sets], np.int64).reshape(-1, 2).tobytes(), text.tobytes(), np.packbits(new).tobytes()]
        own = b"".join(base)
        out = [(chunk, own_key(chunk, i), own[i : i + PIECE_BYTES], i.to_bytes(8, "big")) for i in range(0, len(own), PIECE_BYTES)]
        cuts = np.searchsorted(_owner(distinct, self.owners), np.arange(self.owners + 1, dtype=np.uint64))
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[o], cuts[o + 1]
            extra = zlib.compress(times[a:b].astype(np.uint32).tobytes(), 1) if self.full else np.packbits(times[a:b] > 1).tobytes()
            out.append((chunk, o, golomb.encode(distinct[a:b] >> self.shift), extra))
        self.clear()
        return out


def _send(owners: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(owners, bits, False)
        for b in batches:
            for part, raw, off in slices(b, "text"):
                for row_id, s in zip(part.column("doc_id").to_pylist(), _sets(raw, off)):
                    if sender.add(row_id, s):
                        yield batch(sender.close(), _MESSAGE)
        if sender.ids:
            yield batch(sender.close(), _MESSAGE)

    return run


def _send_full(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(owners, 64, True)
        for b in batches:
            for cid, s in zip(b.column("cid").to_pylist(), b.column("tokens")):
                if sender.add(cid, np.frombuffer(s.as_buffer(), np.uint64)):
                    yield batch(sender.close(), _MESSAGE)
        if sender.ids:
            yield batch(sender.close(), _MESSAGE)

    return run


def _answer(full: bool):
    """One owner, for each chunk. Not full: a bitmap of its shingles that another text has too. Full: for each the number of sets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        rows = table.to_pylist()
        coded = [golomb.decode(r["payload"]) for r in rows]
        values, group = np.unique(np.concatenate(coded), return_inverse=True)
        if full:
            times = [np.frombuffer(zlib.decompress(r["extra"]), np.uint32) for r in rows]
        else:
            times = [np.unpackbits(np.frombuffer(r["extra"], np.uint8), count=len(v)) + 1 for r, v in zip(rows, coded)]
        total = np.bincount(group, np.concatenate(times), len(values))
        out, at = [], 0
        for r, v in zip(rows, coded):
            own, at = total[group[at : at + len(v)]], at + len(v)
            if full:
                data = zlib.compress(np.minimum(own, 2**32 - 1).astype(np.uint32).tobytes(), 1)
            else:
                data = np.array([len(v)], np.int64).tobytes() + np.packbits(own > 1).tobytes()
            out.append((r["chunk"], r["owner"], data, None))
        del coded, values, group, times, total, rows
        tidy()
        return pa.Table.from_batches([batch(out, _MESSAGE)])

    return run


def _base(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, list[dict]]:
    """Of a chunk: ids, counts and what else it kept for itself, and its owners' answers in their order."""
    rows = table.to_pylist()
    data = b"".join(r["payload"] for r in sorted((r for r in rows if r["owner"] < 0), key=lambda r: r["extra"]))
    answers = sorted((r for r in rows if r["owner"] >= 0), key=lambda r: r["owner"])
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), data[8 + 16 * n :], answers


_TEXTS = "doc_id long, n long, key1 long, key2 long, shared long"


def _shared_counts(key: tuple, table: pa.Table) -> pa.Table:
    """One chunk: how many shingles of each of its texts some other text has."""
    ids, counts, rest, answers = _base(table)
    n, total = len(ids), int(counts.sum())
    keys, text = np.frombuffer(rest, np.int64, 2 * n).reshape(-1, 2), np.frombuffer(rest, np.uint16, total, 16 * n)
    new = np.unpackbits(np.frombuffer(rest, np.uint8, -1, 16 * n + 2 * total), count=total)
    flags = [np.unpackbits(np.frombuffer(r["payload"], np.uint8, -1, 8), count=int(np.frombuffer(r["payload"], np.int64, 1)[0])) for r in answers]
    flags = np.concatenate([*flags, np.zeros(0, np.uint8)]).astype(bool)
    shared = np.bincount(text[flags[np.cumsum(new, dtype=np.int64) - 1]], minlength=n) if total else np.zeros(n, np.int64)
    return pa.Table.from_arrays([pa.array(x) for x in (ids, counts, keys[:, 0], keys[:, 1], shared)], schema=arrow(_TEXTS))


#: A set's longer prefix without the shingles that no other set has: how many of it are in the prefix, the shingles, rarest first;
#: pairs and scan: what enumerating costs, and what the lists of the prefix cost, which are scanned once.
_PREFIXES = "cid long, n long, one long, prefix binary, pairs long, scan long"


def _prefixes(key: tuple, table: pa.Table) -> pa.Table:
    """One chunk: the prefixes of its sets in the order of their shingles' numbers of sets."""
    ids, counts, data, answers = _base(table)
    every = np.frombuffer(data, np.uint64)
    inverse = np.unique(every, return_inverse=True)[1]
    df = np.concatenate([*(np.frombuffer(zlib.decompress(r["payload"]), np.uint32) for r in answers), np.zeros(0, np.uint32)]).astype(np.int64)[inverse]
    out = []
    for c, n, end in zip(ids.tolist(), counts.tolist(), np.cumsum(counts).tolist()):
        s, d = every[end - n : end], df[end - n : end]
        by = np.lexsort((s, d))[: n - int(_needed(n)) + 2]
        p = n - int(_needed(n)) + 1
        alone = int(np.searchsorted(d[by], 1, "right"))
        by, one = by[alone:], max(0, p - alone)
        k = len(by) if _needed(n) > 1 else 0
        one = min(one, len(by))
        out.append((c, n, one, s[by].tobytes(), k * (k - 1) // 2, LIST_COST * one))
    del answers, every, inverse, df
    tidy()
    return pa.Table.from_batches([batch(out, _PREFIXES)])


#: kind 0: a shingle of the prefix; 1: a pair of the longer prefix.
_SIGNS = "sign long, kind int, cid long"


def _signs(small: int):
    """Sets of up to `small` shingles under the pairs of their longer prefix; larger ones, and those that a larger one can link to, under single shingles."""
    single = int(_needed(small + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sign, kind, cid = [], [], []
            for c, n, one, prefix in zip(*(b.column(x).to_pylist() for x in ("cid", "n", "one", "prefix"))):
                s = np.frombuffer(prefix, np.uint64)
                if n >= single:
                    sign.append(s[:one].view(np.int64))
                    kind.append(np.zeros(one, np.int32))
                    cid.append(np.full(one, c))
                if n <= small and _needed(n) > 1:
                    two = np.sort(s)
                    i, j = np.triu_indices(len(two), 1)
                    sign.append(golomb.mix(golomb.mix(two[i]) ^ two[j]).view(np.int64))
                    kind.append(np.ones(len(i), np.int32))
                    cid.append(np.full(len(i), c))
            if sign:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sign, kind, cid)], schema=arrow(_SIGNS))

    return run


def boundary(prefixes: DataFrame) -> int:
    """The size up to which sets count as small: where pairs to enumerate and lists to scan cost least together."""
    n = F.col("n").cast("double")
    size = F.when(F.col("n") < EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(8 * F.log2(n / EXACT_SIZES))).cast("int")
    costs = {r["size"]: (float(r["pairs"]), float(r["scan"])) for r in prefixes.groupBy(size.alias("size")).agg(F.sum("pairs").alias("pairs"), F.sum("scan").alias("scan")).collect()}
    pairs, scan = np.zeros(max(costs, default=0) + 1), np.zeros(max(costs, default=0) + 1)
    for k, (a, b) in costs.items():
        pairs[k], scan[k] = a, b
    best = int(np.argmin(np.cumsum(pairs) + scan.sum() - np.cumsum(scan)))
    return best if best < EXACT_SIZES else math.ceil(EXACT_SIZES * 2 ** ((best - EXACT_SIZES + 1) / 8)) - 1


_LINKS = "cid long, links long, root long"


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    """Exact links inside a block (side 0 only) or between two (sides 0 and 1): for each set how many rows it links to, and a root."""
    cid, copies, side = (table.column(x).to_numpy() for x in ("cid", "copies", "side"))
    tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens").combine_chunks()] if table.num_rows else []
    n = np.array([len(t) for t in tokens])
    cross = key[1].as_py() != key[2].as_py()
    every = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(every, kind="stable")
    owner_sorted = owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(every)))
    group = np.empty(len(every), np.int64)
    group[order] = np.cumsum(new) - 1
    ends = np.cumsum(n)
    root = np.arange(len(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = np.zeros(len(n), np.int64)
    for i in range(len(n)):
        g = group[ends[i] - n[i] : ends[i]]
        g = g[length[g] > 1]
        if not len(g):
            continue
        size = length[g]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[g], size)
        both = np.bincount(owner_sorted[at], minlength=len(n))
        ok = 100 * both >= PER_CENT * (n + n[i] - both)
        ok[i] = False
        if cross:
            ok &= side != side[i]
        found = np.flatnonzero(ok)
        links[i] = copies[found].sum()
        for j in found[found > i]:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    roots = [find(i) for i in range(len(n))]
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, cid[i]), cid[i])
    return pa.Table.from_arrays([pa.array(cid), pa.array(links), pa.array(np.array([least[r] for r in roots], np.int64))], schema=arrow(_LINKS))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """members (cid, n, copies, tokens, comp) with the pairs of blocks they belong to: comp, one, two, side.

    A component of up to `block` sets is one block. Larger ones are cut by size class (a factor of 4/3 each, so links reach the
    next class at most) and by hash.
    """
    light = cut(members.select("comp", "cid", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4.0 / 3)) + 1e-9).cast("int").alias("class")), "members")
    sizes = light.groupBy("comp", "class").agg(F.count(F.lit(1)).alias("in_class"))
    whole = sizes.groupBy("comp").agg(F.sum("in_class").alias("size"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("in_class") / block).cast("int")))).alias("cuts"))
    whole = cut(whole.filter("size > 1"), "sizes")  # one row a component, with one entry a size class
    small = whole.filter(F.col("size") <= block).select("comp")
    large = whole.filter(F.col("size") > block).select("comp", "cuts")
    # components have no links with one another, so small ones share blocks
    packs = 1 + int((whole.filter(F.col("size") <= block).agg(F.sum("size")).first()[0] or 0) // max(1, block // 2))
    one = members.join(small, "comp").select(F.pmod(F.xxhash64("comp"), F.lit(packs)).alias("comp"), F.lit(-1).alias("one"), F.lit(-1).alias("two"), "cid", "copies", "tokens", F.lit(0).alias("side"))
    m = members.join(large, "comp").withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4.0 / 3)) + 1e-9).cast("int"))
    at = lambda c: F.coalesce(F.try_element_at("cuts", c), F.lit(0))
    m = m.withColumn("b", F.pmod(F.xxhash64("cid"), at(F.col("c"))).cast("int"))
    until = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c, b: c * 1_000_000 + b
    own = F.transform(until(at(F.col("c"))), lambda j: F.struct(name(F.col("c"), F.least("b", j)).alias("one"), name(F.col("c"), F.greatest("b", j)).alias("two"), (F.col("b") > j).cast("int").alias("side")))
    up = F.transform(until(at(F.col("c") + 1)), lambda j: F.struct(name(F.col("c"), F.col("b")).alias("one"), name(F.col("c") + 1, j).alias("two"), F.lit(0).alias("side")))
    down = F.transform(until(at(F.col("c") - 1)), lambda j: F.struct(name(F.col("c") - 1, j).alias("one"), name(F.col("c"), F.col("b")).alias("two"), F.lit(1).alias("side")))
    many = m.withColumn("x", F.explode(F.concat(own, up, down))).select("comp", "x.one", "x.two", "cid", "copies", "tokens", "x.side")
    return one.unionByName(many)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, n_links.

    A text of fewer than five words is one shingle, one without words has none and links to nothing. component_id is the least
    id reachable by links; n_links counts the other rows linked to this one, equal sets included. Null text counts as empty, a
    null id as the least long. Repeated rows are equal sets; rows that share an id but not a text are judged apart,
    each by its own text. Very long texts are read whole.
    """
    owners = owners_for(docs)
    texts = bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.col(text_col).alias("text"))
    sent = texts.mapInArrow(tidied(_send(owners, FP_BITS)), _MESSAGE)
    sets = cut(sent.groupBy("owner").applyInArrow(_answer(False), _MESSAGE).groupBy("chunk").applyInArrow(_shared_counts, _TEXTS), "sets")

    # one row a class, numbered once and for all as it is written
    keys = ["key1", "key2", "n"]
    classes = sets.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("shared").alias("shared"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    left = classes.filter(F.col("shared") >= F.ceil(F.col("n") * PER_CENT / 100)).select("doc_id", *keys, "cid", "copies")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, off in slices(b, "text"):
                own = _sets(raw, off)
                both = np.array([_key(s) for s in own], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", *keys, "tokens"])

    tokens = prune(texts, "doc_id", left.select("doc_id"), left.count(), whole, "doc_id long, key1 long, key2 long, n long, tokens binary")
    full = cut(tokens.join(left, ["doc_id", *keys]).select("cid", "n", "copies", "tokens").dropDuplicates(["cid"]), "full")

    owners = owners_for(full)
    messages = full.select("cid", "tokens").mapInArrow(tidied(_send_full(owners)), _MESSAGE)
    prefixes = cut(messages.groupBy("owner").applyInArrow(_answer(True), _MESSAGE).groupBy("chunk").applyInArrow(_prefixes, _PREFIXES), "prefixes")
    signs = cut(prefixes.mapInArrow(tidied(_signs(boundary(prefixes))), _SIGNS), "signs")
    lists = cut(signs.groupBy("sign", "kind").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("w")).filter("w > 1"), "lists")
    edges = join_hot(signs.withColumnRenamed("cid", "a"), lists, ["sign", "kind"], "w").select("a", "b")
    comps = components(edges)

    members = full.join(comps.select(F.col("v").alias("cid"), F.col("root").alias("comp")), "cid")
    checked = cut(_blocks(members, block).groupBy("comp", "one", "two").applyInArrow(_verify, _LINKS), "links")
    counts = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(checked.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "doc_id").join(roots.withColumnRenamed("v", "cid"), "cid")
    least = cut(named.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_w")), "least")
    named = join_hot(named.select("cid", "root"), least, ["root"], "_w").select("cid", "least")
    done = classes.join(counts, "cid", "left").join(named, "cid", "left")
    done = cut(done.select(*keys, F.coalesce("least", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("_w")), "done")
    linked = join_hot(sets.filter("n > 0").select("doc_id", *keys), done, keys, "_w")
    alone = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", "n", "component_id", "n_links").unionByName(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
