"""Representations: TF-IDF, embeddings, hybrid vectors, scaling, neighbours."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as fx


def tfidf_fit(docs: DataFrame, text: str, key: str, analyze: Callable[[Column], Column] = fx.analyze_document) -> DataFrame:
    """term, df, idf over docs. idf = ln((1 + n) / (1 + df)) + 1."""
    n = docs.count()
    terms = docs.select(key, F.explode(F.array_distinct(analyze(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def tfidf_transform(docs: DataFrame, vocabulary: DataFrame, text: str, key: str, analyze: Callable[[Column], Column] = fx.analyze_document) -> DataFrame:
    """key, term, weight: (1 + ln tf) * idf, each document scaled to length 1; terms outside the vocabulary are ignored."""
    tf = docs.select(key, F.explode(analyze(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocabulary.select("term", "idf"), "term").withColumn("w", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = l2(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(F.transform(a, lambda x: x.cast("float")))


def mean_vectors(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """Mean of each group's vectors in double precision, scaled to length 1, as floats."""
    out = vectors.groupBy(group).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)])
    return out.select(group, normalized(F.array(*[F.col(f"_{i}") for i in range(size)])).alias(vector))


def vector_audit(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows, rows of length 1 (to 1e-3), rows with a value that isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(l2(F.col(vector)) - 1) <= 1e-3).alias("unit"), F.count_if(bad).alias("not_finite"))


def neighbours(items: DataFrame, key: str, vector: str, k: int = 3, block: int = 4096) -> DataFrame:
    """The k nearest others of every item by cosine. Items are dealt into blocks of about `block`, and every pair of blocks meets in one task.

    Meant for catalogues (every item meets every other); a block keeps its k best, so at most k rows an item follow from each.
    """
    blocks = max(1, -(-items.count() // block))
    unit = items.select(key, normalized(F.col(vector)).alias("v")).withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    left = unit.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = unit.withColumn("o", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        a, c = group[group["side"] == 0], group[group["side"] == 1]
        if a.empty or c.empty:
            return pd.DataFrame({"key": [], "other": [], "cosine": []})
        sims = np.stack(a["v"]).astype(np.float64) @ np.stack(c["v"]).astype(np.float64).T
        ka, kc, rows = a[key].to_numpy(), c[key].to_numpy(), []
        for i in range(len(ka)):
            order = np.lexsort((kc, -sims[i]))
            rows += [(ka[i], kc[j], sims[i, j]) for j in order[: k + 1] if kc[j] != ka[i]][:k]
        return pd.DataFrame(rows, columns=["key", "other", "cosine"])

    near = left.unionByName(right).groupBy("b", "o").applyInPandas(run, "key long, other long, cosine double")
    w = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embed(texts: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Distinct texts with the provider's vectors; the provider is made for batches and travels to the executors."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({text: b[text], "vector": provider(b[text].tolist())})

    return texts.select(text).distinct().mapInPandas(run, f"`{text}` string, vector array<float>")


def hash_provider(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a sentence encoder: signed hashed words, scaled to length 1."""

    def run(texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return run


def hybrid(df: DataFrame, semantic: str, counts: str, out: str = "hybrid") -> DataFrame:
    return df.withColumn(out, F.concat(F.transform(semantic, lambda x: x.cast("double")), F.transform(counts, lambda x: x.cast("double"))))


def scaler_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of every column, values that aren't finite as 0."""
    return df.agg(*[e for c in columns for e in (F.avg(fx.clean_float(F.col(c))).alias(f"{c}_mean"), F.stddev_pop(fx.clean_float(F.col(c))).alias(f"{c}_std"))])


def scaler_apply(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """columns centred and scaled by the one row of stats; a deviation of 0 counts as 1."""
    row = stats.first().asDict()
    return df.withColumns({c: (fx.clean_float(F.col(c)) - F.lit(row[f"{c}_mean"])) / F.lit(row[f"{c}_std"] or 1.0) for c in columns})


def text_catalogue(texts: DataFrame, text: str) -> DataFrame:
    """Distinct texts by hash with their occurrences; `texts` over 1 marks a hash collision."""
    return texts.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(text).alias("text"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct(text).alias("texts"))


def token_audit(texts: DataFrame, key: str, text: str, count_tokens: Callable[[list[str]], list[int]], most: int) -> DataFrame:
    """Tokens of every text by a given tokenizer and whether it would be cut at `most`."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": count_tokens(b[text].fillna("").tolist())})

    return texts.select(key, text).mapInPandas(run, f"`{key}` long, tokens long").withColumn("truncated", F.col("tokens") > most)


def nearest_rank(df: DataFrame, value: str, percents: tuple[int, ...], group: list[str], half_even: bool = True) -> DataFrame:
    """Nearest-rank percentiles of each group as rows (percent, value): rank round(p/100 n), halves to even, or ceiling."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    exact = F.col("percent") * F.col("_n") / 100.0
    want = F.greatest(F.lit(1), (F.bround(exact) if half_even else F.ceil(exact)).cast("int"))
    return at.filter(F.col("_r") == want).select(*group, "percent", F.col(value).alias("value"))
