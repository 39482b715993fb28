"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight, u a hash of its id and text in (0, 1): in ascending order of keys, documents of a
source come as if drawn one after another with chances in proportion to their quality weights. A source's budget first buys
complete epochs; what remains is spent along that order until the prefix sum of sizes reaches it.

The order within a source is kept in ranges of the key's logarithm, which hold about as many rows each whatever the weights' scale:
sums of ranges tell which range the budget ends in, and only that range's rows are sorted. So no task ever sorts a source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, slices, tidied
from .wordhash import letters_and_words

#: Source weights, repeated along the sources in code point order.
WEIGHTS = (1, 2, 3)
#: A source is repeated at most so many times.
MOST_EPOCHS = 3
#: Rows that a range of keys has at most, about.
RANGE_ROWS = 4096
#: Mean letters of a word of prose, and the least quality weight.
PROSE_LETTERS, LEAST_WEIGHT = 5.0, 0.05


def quality_weights(letters: np.ndarray, others: np.ndarray, words: np.ndarray) -> np.ndarray:
    """LEAST_WEIGHT to 1: the share of letters in a text, times how near their mean number in a word is to that of prose."""
    share = letters / np.maximum(1, letters + others)
    mean = letters / np.maximum(1, words)
    return np.maximum(LEAST_WEIGHT, share / (1 + np.abs(mean - PROSE_LETTERS) / PROSE_LETTERS))


#: Weights of many texts at once, from their bytes and offsets.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def with_sizes(docs: DataFrame, text_col: str, size: str, weight: str, weigh: Weigh | None = None) -> DataFrame:
    """docs without text_col and with two columns more: the number of words [^\\x20\\x09-\\x0D]+ (null: 0) and the quality weight, weigh's if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, off in slices(b, text_col):
                letters, others, words = letters_and_words(raw, off)
                kept = [c for c in part.schema.names if c != text_col]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(words), pa.array(weigh(raw, off) if weigh else quality_weights(letters, others, words))], [*kept, size, weight])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    return bounded(docs).mapInArrow(tidied(run), T.StructType([*fields, T.StructField(size, T.LongType()), T.StructField(weight, T.DoubleType())]))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size) with target: shares of the total by weight, none above `most` times its size, the excess shared again."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # sources below the water line are full; the first that isn't sets the level of all that follow
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(by_ratio))
    s = s.withColumn("water", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("rank", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("water"), F.lit(0.0)) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | Weigh | None = None) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies.

    Null text has size 0; null sources are one source, the last. Rows with one id and text are taken or left together, others
    apart, whatever their ids (null too). After the prefix, the one document left that brings the source nearest to its target
    is added. Texts without words come with every complete epoch and take nothing. Empty sources have target 0. The draw depends
    on seed, ids, texts and weights only, so reruns agree. weight: the documents' quality weights, above 0, as a column or as
    a function of texts; such of 0 or less come last.
    """
    weigh = None if weight is None or isinstance(weight, Column) else weight
    weight = weight if weigh is None else None
    rid = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    own = [] if weight is None else [weight.cast("double").alias("own")]
    rows = with_sizes(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), rid.alias("rid"), *own, F.col(text_col).alias("text")), "text", "size", "qw", weigh)
    qw = F.col("qw" if weight is None else "own")
    u = (F.shiftrightunsigned("rid", 11).cast("double") + 0.5) / F.lit(float(2**53))
    key = F.when(qw > 0, F.greatest(-F.log(u) / qw, F.lit(1e-300))).otherwise(F.lit(1e300))
    rows = cut(rows.select("doc_id", "source", "size", "rid", key.alias("key")), "mix")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    info = targets.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    info = info.join(sources.select("source", "n").withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # a range is 1 / ranges of a unit of the logarithm, and no unit holds more than 1 / e of rows drawn with one weight
    info = cut(info.withColumn("ranges", (F.col("n") / RANGE_ROWS).cast("long") + 1).drop("n"), "sources")

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        """right has one row a source; its files' size tells Spark whether to broadcast it or to shuffle (and split hot sources)."""
        return left.join(right.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")

    place = F.floor(F.log("key") * F.col("ranges")).cast("long")
    ranged = with_source(rows, info).withColumn("range", place)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = with_source(sums.withColumn("before", F.coalesce(F.sum("range_size").over(along), F.lit(0))), info.select("source", "rest"))
    last = cut(sums.filter("before <= rest and before + range_size > rest").groupBy("source").agg(F.min(F.struct("range", "before")).alias("x")).select("source", F.col("x.range").alias("last"), F.col("x.before").alias("before")), "last")
    inside = with_source(ranged, last).filter("range = last")
    inside = inside.withColumn("cum", F.sum("size").over(Window.partitionBy("source").orderBy("key", "rid")))  # rows of one range; peers share a sum
    reached = inside.filter(F.col("before") + F.col("cum") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "rid")).alias("edge"), F.max("cum").alias("cum"))
    ends = with_source(last, reached).select("source", "last", F.col("edge.key").alias("edge_key"), F.col("edge.rid").alias("edge_rid"), (F.col("before") + F.coalesce("cum", F.lit(0))).alias("got"))
    ends = cut(with_source(info, ends).select("source", "source_size", "target", "epochs", "rest", "ranges", "last", "edge_key", "edge_rid", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap")), "ends")

    done = with_source(rows, ends).withColumn("range", place)
    chosen = (F.col("range") < F.col("last")) | ((F.col("range") == F.col("last")) & ((F.col("key") < F.col("edge_key")) | ((F.col("key") == F.col("edge_key")) & (F.col("rid") <= F.col("edge_rid")))))
    done = done.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    miss = F.abs(F.col("gap") - F.col("size"))
    extra = done.filter(~F.col("chosen") & (F.col("size") > 0) & (miss < F.col("gap"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "key", "rid")).alias("x"))
    extra = cut(extra.select("source", F.col("x.key").alias("x_key"), F.col("x.rid").alias("x_rid")), "extra")
    done = with_source(done, extra)
    more = F.coalesce(F.col("chosen") | ((F.col("key") == F.col("x_key")) & (F.col("rid") == F.col("x_rid"))), F.col("chosen"))
    return done.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more.cast("long"))).alias("taken"), (F.col("epochs") + more.cast("long")).alias("copies"))
