"""Benchmark decontamination: windows of a document near a benchmark item in edit distance over words.

CGK embedding: a walk reads a string and at every step a random bit of (step, symbol) says whether it moves on; strings at small
edit distance give walks at small Hamming distance. LSH over the embedded windows samples steps of the walk, several times over.
Windows are as long as the items, one at every word of a text and, with padding, over its ends, so that passages cut short there
are windows too. Two bounds that lose nothing say which windows need embedding. If at most e words of an item are edited, one of
e + 1 pieces of it is left as it was: a window must hold the first words of some piece. And it has at most e words that no item
of its size has. Candidates are verified by exact edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, slices, tidied
from .golomb import mix
from .wordhash import words

#: Edits allowed for each word of an item: a similarity of 0.75 or more.
EDITS = 0.25
#: Independent walks, samples of each walk, and steps in a sample: so many in windows of less than so many words, since the longer a
#: walk, the further it strays. Recall at the limit of edits is measured in the tests.
WALKS, SAMPLES, STEPS = 6, 16, ((45, 3), (250, 2), (2**62, 1))
#: Items and bytes of their texts that are held in memory and broadcast at once; more are taken in turns.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 5_000, 4 << 20
#: Most words of a piece that the first bound looks for.
PIECE = 3
#: Windows embedded at once.
WINDOWS = 8_192
_FILTER_BITS = 20
#: Bytes of text searched at once.
SLICE = 2 << 20
#: What windows have past their own end, before their text and after it.
_END, _BEFORE, _AFTER = (np.uint64(x) for x in (0, 1, 2))


def _length_class(n: int) -> int:
    """Items of m to 1.25 m words share windows of m words."""
    m = 1
    while m * 1.25 + 1 <= n:
        m = int(m * 1.25 + 1)
    return m


def _symbols(symbols: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The symbols at these places, of texts from lo to hi; other places are padding."""
    s = symbols[np.minimum(np.maximum(at, 0), len(symbols) - 1)]
    s[at < lo] = _BEFORE
    s[at >= hi] = _AFTER
    return s


def walk(symbols: np.ndarray, starts: np.ndarray, m: int, seed: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Embedded windows of m symbols from each start, in texts from lo to hi: 2 m steps of the walk."""
    at, out = np.zeros(len(starts), np.int64), np.zeros((2 * m, len(starts)), np.uint64)
    for j in range(2 * m):
        s = _symbols(symbols, starts + at, lo, hi)
        if j >= m:
            s[at >= m] = _END
        out[j] = s
        at += (mix(s + np.uint64((seed * 100_003 + j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(np.int64)
    return out


def _sampled_steps(m: int, seed: int, samples: int, steps: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    rng, size = np.random.default_rng([seed, m]), next(k for below, k in steps if m < below)
    return [np.sort(rng.choice(2 * m, size=min(size, 2 * m), replace=False)) for _ in range(samples)]


def _keys(embedded: np.ndarray, chosen: np.ndarray, tag: int) -> np.ndarray:
    out = np.full(embedded.shape[1], np.uint64(tag * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    for j in chosen:
        out = mix(out ^ embedded[j])
    return out


def _runs(symbols: np.ndarray, q: int) -> np.ndarray:
    """Places in a table of 2**_FILTER_BITS entries for all runs of q symbols."""
    n = max(0, len(symbols) - q + 1)
    h = np.full(n, np.uint64(q))
    for j in range(q):
        h = mix(h ^ symbols[j : j + n])
    return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def near(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least edit distance of item to any run of text's words if at most `most`, and where the first such run ends (Myers' bit vectors)."""
    n = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        peq[w] |= 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


class Index:
    """The benchmark's items: tables for the bounds, LSH tables by length class, words for verification. Item ids may be null."""

    def __init__(self, items: list[tuple[int | None, str | None]], edits: float = EDITS, walks: int = WALKS, samples: int = SAMPLES, steps: tuple[tuple[int, int], ...] = STEPS) -> None:
        self.edits, self.walks, self.samples, self.steps = edits, walks, samples, steps
        self.sampled: dict[tuple[int, int], list[np.ndarray]] = {}
        items = sorted(((i, t or "") for i, t in items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        texts = [t.encode() for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        symbols, by = words(np.frombuffer(b"".join(texts), np.uint8), off)
        self.ids = [i for i, _ in items]
        self.words = [symbols[a:b] for a, b in zip(by[:-1], by[1:])]
        lengths = np.diff(by)
        of_class = np.array([_length_class(int(n)) if n else 0 for n in lengths], np.int64)
        self.pieces: dict[int, np.ndarray] = {}  # by words of a piece: whether any class has it, a bit for each class
        self.classes: list[dict] = []
        sizes_there = sorted(set(of_class.tolist()) - {0})
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(sizes_there) <= 8 * t().itemsize or t is np.uint64)
        for k, m in enumerate(sizes_there):
            own = np.flatnonzero(of_class == m)
            known = np.zeros(1 << _FILTER_BITS, bool)
            sizes = set()
            for i in own.tolist():
                w = self.words[i]
                known[_runs(w, 1)] = True
                e = int(edits * len(w))
                size = len(w) // (e + 1)
                q = min(PIECE, size)
                table = self.pieces.setdefault(q, np.zeros(1 << _FILTER_BITS, kind))
                table[_runs(w, q)[np.arange(e + 1) * size]] |= kind(1 << min(k, 63))
                sizes.add(q)
            # windows of m words at every place of the items
            count = lengths[own] - m + 1
            item = np.repeat(own, count)
            starts = by[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            keys = self.keys(symbols, starts, m, by[item], by[item + 1])
            flat, which = keys.ravel(), np.tile(item, len(keys))
            pairs = np.unique(np.stack([flat, which.astype(np.uint64)], axis=1), axis=0)
            found, first = np.unique(pairs[:, 0], return_index=True)
            self.classes.append({"m": m, "bit": min(k, 63), "sizes": sorted(sizes), "lost": int(edits * lengths[own].max()), "known": known, "keys": found, "first": np.append(first, len(pairs)), "items": pairs[:, 1].astype(np.int32)})

    @classmethod
    def of(cls, state: dict) -> Index:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def keys(self, symbols: np.ndarray, starts: np.ndarray, m: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty((self.walks * self.samples, len(starts)), np.uint64)
        for r in range(self.walks):
            e = walk(symbols, starts, m, r + 1, lo, hi)
            if (m, r) not in self.sampled:
                self.sampled[m, r] = _sampled_steps(m, r + 1, self.samples, self.steps)
            for s, chosen in enumerate(self.sampled[m, r]):
                out[r * self.samples + s] = _keys(e, chosen, (r * self.samples + s + 1) * 1000 + m)
        return out

    def _windows(self, c: dict, at: np.ndarray, q: int, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold one of the pieces of q words at these places and few enough unknown words, and the place in `at` of one piece of each."""
        m, lost = c["m"], c["lost"]
        a, b = np.maximum(at - m + q, lo - lost), np.minimum(at, hi - m + lost)
        same = np.append(False, lo[1:] == lo[:-1])
        a = np.where(same, np.maximum(a, np.append(0, b[:-1]) + 1), a)
        size = np.maximum(0, b - a + 1)
        piece = np.repeat(np.arange(len(at)), size)
        starts = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size - a, size)
        unknown = np.zeros(len(starts), np.int64)
        for j in range(m):
            unknown += ~c["known"][_runs(_symbols(symbols, starts + j, lo[piece], hi[piece]), 1)]
        few = unknown <= lost
        return starts[few], piece[few]

    def search(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int | None, int, int]]:
        """(text, item id, edit distance, word at which the nearest run ends) for all texts at once."""
        symbols, by = words(raw, off)
        text_of = np.repeat(np.arange(len(by) - 1), np.diff(by))
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        hits = {}
        for q, table in self.pieces.items():
            bits = table[_runs(symbols, q)]
            at = np.flatnonzero(bits)
            at = at[text_of[at] == text_of[at + q - 1]]
            hits[q] = at, bits[at]
        for c in self.classes:
            for q in c["sizes"]:
                at, bits = hits[q]
                at = at[(bits & bits.dtype.type(1 << c["bit"])) != 0]
                for i in range(0, len(at), WINDOWS):
                    some = at[i : i + WINDOWS]
                    text = text_of[some]
                    starts, piece = self._windows(c, some, q, symbols, by[text], by[text + 1])
                    text = text[piece]
                    for j in range(0, len(starts), WINDOWS):
                        s, t = starts[j : j + WINDOWS], text[j : j + WINDOWS]
                        found = self.keys(symbols, s, c["m"], by[t], by[t + 1])
                        place = np.minimum(np.searchsorted(c["keys"], found), len(c["keys"]) - 1)
                        for r, n in zip(*np.nonzero(c["keys"][place] == found)):
                            x = place[r, n]
                            for k in c["items"][c["first"][x] : c["first"][x + 1]].tolist():
                                pairs[int(t[n]), k].append(int(s[n]))
        out = []
        for (t, k), starts in sorted(pairs.items()):
            item, n, best = self.words[k], len(self.words[k]), None
            spans: list[list[int]] = []
            for s in sorted(set(starts)):
                lo, hi = max(int(by[t]), s - 2 * n), min(int(by[t + 1]), s + 3 * n)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                near_by = symbols[lo:hi]
                if np.isin(item, near_by, invert=True).sum() > int(self.edits * n):  # each word that is missing was edited
                    continue
                got = near(item.tolist(), near_by.tolist(), int(self.edits * n))
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[1] + lo - int(by[t]))
            if best:
                out.append((t, self.ids[k], *best))
        return out


_HITS = "doc_id long, item_id long, edits long, end_word long"


def _indexes(items: DataFrame, id_col: str, text_col: str, at_once: int, bytes_at_once: int, **kw) -> Iterator[Index]:
    """The items in turns of about at_once items or bytes_at_once bytes; one item longer than that has a turn with what falls to it."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    turns = max(1, -(-n // at_once), -(-size // bytes_at_once))
    for turn in range(turns):
        part = items.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(turns)) == turn) if turns > 1 else items
        yield Index([(r[0], r[1]) for r in part.select(F.col(id_col).cast("long"), text_col).collect()], **kw)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE, **kw) -> DataFrame:
    """One row for every (row of docs, item) with a run of words within a quarter of the item's words in edits: id, item_id, edits, end_word.

    Items without words match nothing, nor do null or empty texts; words are compared with A-Z in lower case. Null ids of rows and
    of items stay null; items that share an id are items of their own. Repeated rows give repeated hits. end_word: the words of
    the text up to the end of the first nearest run. Embedding windows costs the square of an item's words.
    """
    spark, out = docs.sparkSession, None
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for index in _indexes(items, item_id, item_text, at_once, bytes_at_once, **kw):
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            for b in batches:
                for part, raw, off in slices(b, "text", SLICE):
                    ids = part.column("doc_id").to_pylist()
                    hits = [(ids[t], *rest) for t, *rest in index.search(raw, off)]
                    if hits:
                        yield batch(hits, _HITS)

        found = rows.mapInArrow(tidied(run), _HITS)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("doc_id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE, **kw) -> DataFrame:
    """docs without the rows whose text has a run near an item. Rows stay where they are: nothing is shuffled."""
    for index in _indexes(items, item_id, item_text, at_once, bytes_at_once, **kw):
        shared = bounded(docs).sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            for b in batches:
                for part, raw, off in slices(b, text_col, SLICE):
                    keep = np.ones(part.num_rows, bool)
                    keep[[t for t, *_ in index.search(raw, off)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
