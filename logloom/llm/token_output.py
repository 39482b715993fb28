"""Token ids as binary files: fixed-size blocks of ids, transposed into bit planes, each plane compressed with zstandard.

A shard file is

    magic "BPTK1\\n", 2 bytes of padding
    blocks   for each block its planes, one zstandard frame each (planes of zeros only are left out)
    documents  a zstandard frame of doc ids (int64) and lengths in ids (uint64), in order
    index    for each block: offset, ids in it, bitmap of the planes that are there, byte length of each (one zstandard frame)
    footer   offset and length of the documents, offset and length of the index, ids, documents, block size (7 x uint64), magic

Bit plane p holds bit p of every id of its block. Any run of ids is read from the blocks that cover it alone.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shards
from .common import arrow, batch, bounded, cut, slices, tidied
from .wordhash import cut_words, lower_ascii

MAGIC = b"BPTK1\n\0\0"
#: Ids in a block: a fixed size, a multiple of 8.
BLOCK = 65_536
PLANES = 32
#: A shard file is closed once it has this many ids.
SHARD_IDS = 1 << 24
#: The id that ends a document.
END_ID = 1
#: Bytes that a worker spends on words it remembers, twice over (the latest ones and the ones before), and those of an entry's objects.
WORD_BYTES, ENTRY_BYTES = 48 << 20, 200


def _transpose(x: np.ndarray) -> np.ndarray:
    """Each of the 64-bit words of x as an 8 x 8 matrix of bits, turned: bit i of byte j becomes bit j of byte i."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x


def planes(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, plane) for each bit p that some id has: bit i of the plane is bit p of id i, the lowest bit of a byte first."""
    n, top = len(ids), int(ids.max()).bit_length() if len(ids) else 0
    octets = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    octets[:n] = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    for k in range(-(-top // 8)):
        turned = _transpose(octets[:, k].copy().view("<u8")).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            if turned[:, j].any():
                yield 8 * k + j, np.ascontiguousarray(turned[:, j])


def from_planes(found: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The n ids whose planes are found; other planes are zeros."""
    octets = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    for k in {p // 8 for p in found}:
        turned = np.zeros((len(octets) // 8, 8), np.uint8)
        for j in range(8):
            if 8 * k + j in found:
                turned[:, j] = found[8 * k + j]
        octets[:, k] = _transpose(turned.view("<u8").reshape(-1)).astype("<u8", copy=False).view(np.uint8)
    return octets.reshape(-1).view("<u4")[:n]


class Writer:
    """Collects documents and gives the bytes of one shard file."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.held, self.size, self.ids, self.lengths = block, [], 0, [], []
        self.out, self.at, self.index, self.total = [MAGIC], len(MAGIC), [], 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids.astype(np.uint32, copy=False))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(ids[i : i + self.block])
            self.held, self.size = [ids[full:]], len(ids) - full

    def _put(self, ids: np.ndarray) -> None:
        lengths, there = [], 0
        for p, plane in planes(ids):
            there |= 1 << p
            lengths.append(self._write(self.zstd.compress(plane.tobytes())))
        self.index.append([self.at - sum(lengths), len(ids), there, *lengths])

    def _write(self, data: bytes) -> int:
        self.out.append(data)
        self.at += len(data)
        return len(data)

    def close(self) -> bytes:
        if self.size:
            self._put(np.concatenate(self.held))
        docs_at = self.at
        docs = self._write(self.zstd.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()))
        index_at = self.at
        flat = np.array([x for row in self.index for x in (len(row), *row)], "<u8")
        index = self._write(self.zstd.compress(flat.tobytes()))
        self._write(np.array([docs_at, docs, index_at, index, self.total, len(self.ids), self.block], "<u8").tobytes() + MAGIC)
        return b"".join(self.out)


class Reader:
    """Reads a shard file from its bytes. Raises ValueError for bytes that aren't one."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token shard")
        docs_at, docs, index_at, index, self.total, count, self.block = (int(x) for x in np.frombuffer(data, "<u8", 7, len(data) - len(MAGIC) - 56))
        zstd, self.data = zstandard.ZstdDecompressor(), data
        both = zstd.decompress(data[docs_at : docs_at + docs])
        self.doc_ids, self.lengths = np.frombuffer(both, "<i8", count), np.frombuffer(both, "<u8", count, 8 * count).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        flat, self.index = np.frombuffer(zstd.decompress(data[index_at : index_at + index]), "<u8"), []
        i = 0
        while i < len(flat):
            n = int(flat[i])
            self.index.append([int(x) for x in flat[i + 1 : i + 1 + n]])
            i += 1 + n
        self.zstd, self.last = zstd, (-1, None)

    def _block(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, there, *lengths = self.index[k]
            found = {}
            for p in range(PLANES):
                if there >> p & 1:
                    size, lengths = lengths[0], lengths[1:]
                    found[p] = np.frombuffer(self.zstd.decompress(self.data[at : at + size]), np.uint8)
                    at += size
            self.last = (k, from_planes(found, n))
        return self.last[1]

    def run(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        got = [self._block(k)[max(0, start - k * self.block) : stop - k * self.block] for k in range(first, (stop - 1) // self.block + 1)]
        return got[0] if len(got) == 1 else np.concatenate(got)


#: Units that are one unit of the tokenizer as they stand: letters whose normal form in lower case is themselves.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


def _byte_kinds() -> np.ndarray:
    """0 letter, 1 digit, 2 other, 3 apostrophe, 4 not ASCII."""
    out = np.full(256, 2, np.uint8)
    out[128:], out[39], out[48:58], out[65:91], out[97:123] = 4, 3, 1, 0, 0
    return out


_KIND = _byte_kinds()
#: Whether a unit ends between two bytes of these kinds: digits stand alone, letters and marks part, but an apostrophe may take letters.
_PARTS = np.array([[0, 1, 1, 1, 0], [1, 1, 1, 1, 0], [1, 1, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0]], bool).reshape(-1)
#: What a tokenizer must encode as the units one after another for texts to be cut below words.
_PROBES = ("it's we'll 'sa ''s x's,y", "a,b;c... don't_stop --x--", "a1b22c3.14 7'8", "house houses unbelievable zzxqj", "Stra\xdfe, \xe9l\xe8ve! na\xefve;", "#a @b $c% (d) [e] {f}", "W\u030a, e\u0301t\u0301. \u4e2d\u6587, x\u2026y")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for every byte: itself if printable, else the next one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordIds:
    """Ids of many texts at once: they are cut into units, and each distinct unit is encoded once by the tokenizer.

    Units are words between ASCII white space, which the tokenizer drops before it merges. If it encodes _PROBES as this class
    does, it cuts words further between letters, digits and marks of ASCII, and so does this class; units of letters then go to
    the tokenizer's model at once. Units of ASCII meet in lower case, others as they are written, since their normal form comes
    before the lower case. With added, texts that hold a token added to the vocabulary are encoded whole; without, such tokens
    are words.
    """

    def __init__(self, path: str, added: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.model._resize_cache(0)  # units are remembered here
        self.fine = True
        self.fine = all(self._same(x) for x in _PROBES)
        self.clear()
        if not all(self._same(x) for x in _PROBES):
            raise ValueError(f"{path} looks across white space")
        self.clear()

    def clear(self) -> None:
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def _same(self, text: str) -> bool:
        self.clear()
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(self.texts(raw, np.array([0, len(raw)]), 0))[:-1].tolist() == self.tokenizer.encode(text, add_special_tokens=False).ids

    def _units(self, raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All units, and their offsets by text."""
        chars, first, by_text = cut_words(raw, off)
        if len(first) == 1:
            return pa.array([], pa.large_binary()), by_text
        low = lower_ascii(chars)
        wide = np.flatnonzero(chars > 127)
        if len(wide):
            as_written = np.zeros(len(first), bool)
            as_written[np.searchsorted(first, wide, "right")] = True
            capital = np.flatnonzero(low != chars)
            capital = capital[as_written[np.searchsorted(first, capital, "right")]]
            low[capital] = chars[capital]
        if self.fine:
            kind = _KIND[chars]
            begins = np.empty(len(chars), bool)
            begins[1:] = _PARTS[kind[:-1] * np.uint8(5) + kind[1:]]
            begins[first[:-1]] = True
            begins = np.flatnonzero(begins)
            by_text = np.append(np.searchsorted(begins, first[:-1]), len(begins))[by_text]
            first = np.append(begins, len(chars))
        return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first), pa.py_buffer(low)]), by_text

    def texts(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, end_id last."""
        units, by_text = self._units(raw, off)
        coded = units.dictionary_encode()
        _, edges, data = coded.dictionary.buffers()
        data, edges = data.to_pybytes() if data else b"", np.frombuffer(edges, np.int64, len(coded.dictionary) + 1).tolist() if edges else [0]
        found = self.encode([data[a:b] for a, b in zip(edges, edges[1:])])
        # the end of a text is one more unit; what is taken lies one after another
        which = np.insert(coded.indices.to_numpy(), by_text[1:], len(found))
        taken = pa.array([*found, np.array([end_id], "<u4").tobytes()], pa.large_binary()).take(pa.array(which))
        _, ends, data = taken.buffers()
        out = np.frombuffer(data, "<u4")
        until = np.frombuffer(ends, np.int64, len(taken) + 1, 8 * taken.offset)[by_text + np.arange(len(by_text))] // 4
        special = set()
        if self.added:
            data = raw.tobytes().lower()
            for t in self.added:
                at = data.find(t)
                while at >= 0:
                    special.add(int(np.searchsorted(off, at, "right")) - 1)
                    at = data.find(t, at + 1)
        for i in range(len(off) - 1):
            if i in special:
                yield np.array([*self.tokenizer.encode(raw[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, end_id], np.uint32)
            else:
                yield out[until[i] : until[i + 1]]

    def encode(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as bytes."""
        found = list(map(self.now.get, units))
        for i, out in enumerate(found):
            if out is None:
                w = units[i]
                out = self.before.get(w)
                if out is None:
                    out = self._encode(w)
                found[i] = self.now[w] = out
                self.held += len(w) + len(out) + ENTRY_BYTES
        if self.held > WORD_BYTES:
            self.before, self.now, self.held = self.now, {}, 0
        return found

    def _encode(self, w: bytes) -> bytes:
        if self.fine and w.isalpha() and w.islower():
            return array("I", [t.id for t in self.model.tokenize(w.decode())]).tobytes()
        s = w.decode()
        if self.fine and _PLAIN.fullmatch(low := s.lower()):
            low = "".join(map(self.letters.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()


def _words(path: str, added: bool) -> WordIds:
    """One WordIds for all tasks of a Python worker: what a task has learned serves the next. Its size is bounded by WORD_BYTES."""
    kept = vars(sys.modules.setdefault("_logloom_worker", types.ModuleType("_logloom_worker")))  # functions travel by value, so their globals are new in every task
    if kept.get("tokens_for") != (path, added):
        kept["tokens_for"], kept["words"] = (path, added), WordIds(path, added)
    return kept["words"]


_FILES = "path string, shard long, attempt long, docs long, ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, added: bool = True) -> DataFrame:
    """Encodes texts and writes shard files in ascending id order; returns one row per file: path, shard, attempt, docs, ids.

    Null text counts as empty and still has its end id; a null id counts as the smallest long. Rows with equal ids are
    ordered by text. No rows, no files. Rows are dealt out by ranges of (id, text), so that no task has more than its share.
    added: tokens added to the vocabulary get their own ids in texts, as is the library's default; if False they are words.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, count, writer = _words(tokenizer, added), TaskContext.get().partitionId(), 0, Writer()

        def flush():
            nonlocal count, writer
            shard = (part << 20) | count
            path = shards.put(folder, f"shard-{shard:020d}-{{}}.bptk", writer.close())
            done = batch([(path, shard, TaskContext.get().taskAttemptId(), len(writer.ids), writer.total)], _FILES)
            count, writer = count + 1, Writer()
            return done

        for b in batches:
            for rows, raw, off in slices(b, "text", 2 << 20):
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), words.texts(raw, off, end_id)):
                    writer.add(doc_id, ids)
                    if writer.total >= SHARD_IDS:
                        yield flush()
        if writer.ids:
            yield flush()

    return rows.mapInArrow(tidied(run), _FILES)


_DOCS = "shard long, attempt long, at long, doc_id long, n_tokens long, ids_crc32 long"


def read_tokens(files: DataFrame) -> DataFrame:
    """Reads the shard files of these rows back, and no others beside them: doc_id, start, n_tokens, ids_crc32 for each document, all taken from the files' bytes."""
    spark = files.sparkSession
    folder = files.select("path").first()
    if folder is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bptk").load(folder[0].rpartition("/")[0])
    content = content.select(*(F.regexp_extract("path", r"shard-(\d+)-(\d+)\.bptk$", i).cast("long").alias(x) for i, x in ((1, "shard"), (2, "attempt"))), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, attempt, data in zip(b.column("shard").to_pylist(), b.column("attempt").to_pylist(), b.column("content")):
                r = Reader(data.as_buffer().to_pybytes())
                starts = r.ends - r.lengths
                crcs = [zlib.crc32(r.run(int(s), int(e)).tobytes()) for s, e in zip(starts, r.ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crcs), shard)), pa.array(np.full(len(crcs), attempt)), pa.array(starts), pa.array(r.doc_ids), pa.array(r.lengths), pa.array(crcs, pa.int64())], schema=arrow(_DOCS))

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = files.select("shard", "attempt", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return content.mapInArrow(tidied(run), _DOCS).join(bases, ["shard", "attempt"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, added: bool = True) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what reading them back gives. See write_tokens for edge cases."""
    folder = shards.new_folder(docs.sparkSession, "tokens")
    return read_tokens(cut(write_tokens(docs, folder, tokenizer, id_col, text_col, end_id, added), "shards"))
