"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

A text is cut into passages; each is encoded from counts of its bytes' trigrams and kinds, two learned gates give it a weight
within its document, and the weighted mean of the encoded passages is scored. Only document labels are needed to learn both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, slices, tidied, tidy

#: Bytes of a passage, trigram buckets, kinds of bytes.
PASSAGE, BUCKETS, KINDS = 512, 256, 8
#: The labelled sample to learn from: at most so many documents, and as many of these as have so many passages together (54 MB).
SAMPLE_DOCS, SAMPLE_PASSAGES = 4000, 100_000
#: Passages of a training step that are worked on at once (a document's stay together).
STEP_PASSAGES = 8192
HIDDEN, GATE = 24, 12
FEATURES = BUCKETS + KINDS + 2


def _kinds() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", bytes(range(128, 256)))):
        out[np.frombuffer(chars, np.uint8)] = k
    return out


KIND = _kinds()


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the passages' offsets by text. A text of no bytes has one passage of zeros."""
    length = np.diff(off)
    per = np.maximum(1, -(-length // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(length)), length)
    which = first[doc] + (np.arange(len(raw)) - off[doc]) // PASSAGE
    kinds = np.bincount(which * KINDS + KIND[raw], minlength=n * KINDS).reshape(n, KINDS).astype(np.float32)
    grams = np.zeros((n, BUCKETS), np.float32)
    if len(raw) > 2:
        code = raw.astype(np.uint32)
        h = ((code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA6B) ^ code[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        grams = np.bincount(which[at] * BUCKETS + h[at], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    size = np.maximum(1, kinds.sum(1, keepdims=True))
    total = grams.sum(1, keepdims=True)
    peak = np.sqrt(np.maximum(0, (grams * grams).sum(1, keepdims=True) - total) / np.maximum(1, total * (total - 1)))  # chance that two trigrams agree
    return np.concatenate([np.sqrt(grams / size), kinds / size, peak, np.minimum(1, size / PASSAGE)], axis=1, dtype=np.float32), first


def _forward(m: dict, x: np.ndarray, first: np.ndarray):
    x = (x - m["mean"]) / m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (t * s) @ m["w"]
    count = np.diff(first)
    e = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), count))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), count)
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return x, h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))


def score(m: dict, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    x, first = passages(raw, off)
    return _forward(m, x, first)[-1].astype(np.float64)


def gradients(m: dict, passed: tuple, y: np.ndarray, first: np.ndarray) -> dict:
    """The gradients of the mean log loss after a forward pass."""
    x, h, t, s, a, z, p = passed
    g, count = {}, np.diff(first)
    dp = ((p - y) / len(y)).astype(h.dtype)
    g["c"], g["d"] = z.T @ dp, np.array([dp.sum()], h.dtype)
    dz = np.repeat(dp[:, None] * m["c"], count, axis=0)
    dh = a[:, None] * dz
    da = (dz * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), count))
    g["w"] = (t * s).T @ da
    dts = da[:, None] * m["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (dh + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def _scales(bags: list[np.ndarray]) -> dict:
    """Mean and scale of the features of all passages, added row after row as by mean() and std() of one array, which is never made."""
    n = sum(map(len, bags))

    def total(f) -> np.ndarray:
        out = np.zeros((1, FEATURES), np.float32)
        for x in bags:
            for i in range(0, len(x), STEP_PASSAGES):
                out = np.concatenate([out, f(x[i : i + STEP_PASSAGES].astype(np.float32))]).sum(0, keepdims=True)
        return out[0]

    mean = total(lambda x: x) / np.float32(n)
    return {"mean": mean, "scale": np.sqrt(total(lambda x: np.square(x - mean)) / np.float32(n)) + np.float32(0.02)}


def _parts(pick: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """pick in runs of at most `most` passages, of one document at least."""
    i = 0
    while i < len(pick):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[pick[i:]]), most, "right")))
        yield pick[i:j]
        i = j


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 5, epochs: int = 25, rate: float = 0.01, batch: int = 64, decay: float = 1e-4, at_once: int = STEP_PASSAGES) -> dict:
    """Adam on the log loss of the documents. With no label to learn from, every score is 0.5.

    A step's gradient is summed over runs of about at_once passages, so that memory follows these, not the length of texts.
    """
    rng = np.random.default_rng(seed)
    m = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    fixed = _scales(bags or [np.zeros((1, FEATURES), np.float32)])
    y = y.astype(np.float32)
    if not len(bags):
        return m | fixed
    size = np.array([len(b) for b in bags])
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            pick, g = order[i : i + batch], {k: 0.0 for k in m}
            for part in _parts(pick, size, at_once):
                first = np.concatenate([[0], np.cumsum(size[part])])
                passed = _forward(m | fixed, np.concatenate([bags[j] for j in part], dtype=np.float32), first)
                some = gradients(m, passed, y[part], first)
                g = {k: g[k] + some[k] * np.float32(len(part) / len(pick)) for k in m}
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in m:
                grad = g[k] + decay * m[k]
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad * grad
                m[k] = (m[k] - now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m | fixed


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as no text, which leaves 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, most_passages: int = SAMPLE_PASSAGES) -> dict:
    """A model from labelled documents outside the held-out fold, taken whole in the order of a hash of their ids.

    The sample is the first `most` of them, or as many as have most_passages passages together, one at least. Labels of null ids
    and null labels are left out; of several labels of one document the largest counts; rows with one id and text are one
    document. Texts stay on the executors; the driver gets the sample's passages as features.
    """
    spark = docs.sparkSession
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    place = F.xxhash64(F.lit(11), F.col("id"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    # labels may be of a larger corpus: only such of documents that are there take places
    first = rows.select("id", "h", size.alias("size")).join(marks, "id").distinct().orderBy(place, "id", "h").limit(most).collect()
    until = np.cumsum([r["size"] for r in first])
    pick = spark.createDataFrame([(r["id"], r["h"], r["y"]) for r, n in zip(first, until) if n <= max(most_passages, until[0])], "id long, h long, y int")
    rows = rows.join(F.broadcast(pick), ["id", "h"]).dropDuplicates(["id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, off in slices(b, "text"):
                x, first = passages(raw, off)
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("h"), pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["id", "y", "h", "x"])

    order = {(r["id"], r["h"]): i for i, r in enumerate(first)}
    found = rows.mapInArrow(tidied(run), "id long, y int, h long, x binary").toArrow()  # one copy of the sample, half as wide as what a step works on
    bags = [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, FEATURES) for x in found.column("x")]
    by = sorted(range(len(bags)), key=list(map(order.get, zip(found.column("id").to_pylist(), found.column("h").to_pylist()))).__getitem__)
    y = found.column("y").to_numpy().astype(np.float32)
    model = train([bags[i] for i in by], y[by])
    del bags, found
    tidy()
    return model


def scorer(spark: SparkSession, model: dict):
    """A function of many texts' bytes and offsets, for tasks, that gives their scores. The model has a fixed size and is broadcast."""
    shared = spark.sparkContext.broadcast(model)
    return lambda raw, off: score(shared.value, raw, off)


def add_score(docs: DataFrame, model: dict, text_col: str = "text", column: str = "score") -> DataFrame:
    """docs with one column more: the chance of label 1. Null and empty texts are scored as one empty passage."""
    scores = scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, off in slices(b, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(raw, off))], names=[*part.schema.names, column])

    return bounded(docs).mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Equal texts have equal scores (to the last digits); with no labels every score is 0.5. Null and empty texts are scored as one
    empty passage. Null ids stay null, are not held out and take no labels. An empty table gives an empty result.
    """
    scored = add_score(docs.select(F.col(id_col), F.col(text_col)), learn(docs, labels, label_col, id_col, text_col), text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
