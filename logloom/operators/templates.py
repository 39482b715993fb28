"""Message templates: online mining by token count, frozen catalogues, and matching by a join."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANY = "<*>"


class _Miner:
    """Templates of one token count: a tree over the leading tokens, then the most similar template of the leaf.

    depth counts the levels from the root to the leaves (root and token count included); a node holds at most `children`
    named branches, later ones share the branch <*>. Of equally similar templates the one with more wildcards wins, then the older.
    """

    def __init__(self, sim: float, depth: int, children: int) -> None:
        self.sim, self.levels, self.children, self.root = sim, max(1, depth - 2), children, {}
        self.templates: list[list] = []

    def _leaf(self, tokens: list[str]) -> list[int]:
        node = self.root
        for t in tokens[: self.levels - 1] if len(tokens) >= self.levels else tokens[: max(0, len(tokens) - 1)]:
            t = ANY if any(c.isdigit() for c in t) else t
            if t not in node:
                named = sum(k != ANY for k in node)
                t = t if named < self.children - 1 else ANY
            node = node.setdefault(t, {})
        return node.setdefault("", [])

    def learn(self, tokens: list[str], times: int = 1, ordinal: int = 0) -> int:
        leaf, best, best_key = self._leaf(tokens), -1, (-1.0, -1)
        for i in leaf:
            t = self.templates[i][0]
            wild = sum(x == ANY for x in t)
            key = (sum(a == b for a, b in zip(t, tokens)) / max(1, len(tokens)), wild)
            if key > best_key:
                best, best_key = i, key
        if best >= 0 and best_key[0] >= self.sim:
            found = self.templates[best]
            found[0] = [a if a == b else ANY for a, b in zip(found[0], tokens)]
            found[1] += times
            return best
        self.templates.append([tokens, times, ordinal])
        leaf.append(len(self.templates) - 1)
        return len(self.templates) - 1


_MINED = "n_tokens int, first_ordinal long, template string, fit_count long"


def mine(messages: DataFrame, text: str = "prepared", ordinal: str = "ordinal", sim: float = 0.6, depth: int = 4, children: int = 100, exact: bool = False) -> DataFrame:
    """A catalogue (template_id from 1, template, n_tokens, fit_count) learned from messages in the order of their ordinals.

    Templates never span token counts, so every token count is learned by a task of its own. Unless exact, equal messages
    are merged first (the first ordinal and the count stay), which keeps the task small; a repeated message then counts for
    the template it first joined. Blank messages are left out.
    """
    rows = messages.filter(F.trim(text) != "").select(F.col(text).alias("m"), F.col(ordinal).cast("long").alias("o"))
    rows = rows.withColumn("times", F.lit(1).cast("long")) if exact else rows.groupBy("m").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("n", F.size(F.split("m", r"\s+")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        miner = _Miner(sim, depth, children)
        group = group.sort_values(["o", "m"])
        for m, o, times in zip(group["m"], group["o"], group["times"]):
            miner.learn(m.split(), int(times), int(o))
        n = int(group["n"].iloc[0])
        return pd.DataFrame([(n, o, " ".join(t), c) for t, c, o in miner.templates], columns=["n_tokens", "first_ordinal", "template", "fit_count"])

    mined = rows.groupBy("n").applyInPandas(run, _MINED)
    merged = mined.groupBy("template", "n_tokens").agg(F.min("first_ordinal").alias("first_ordinal"), F.sum("fit_count").alias("fit_count"))
    return merged.select(F.row_number().over(Window.orderBy("first_ordinal", "template")).alias("template_id"), "template", "n_tokens", "fit_count")  # one row a template


def match(messages: DataFrame, catalogue: DataFrame, text: str = "prepared", unknown: int = 0) -> DataFrame:
    """messages with template_id and template of the frozen catalogue; `unknown` and null where none matches.

    A template matches a message of the same token count whose tokens equal all its fixed ones. Of several, the one with the
    most fixed tokens wins, then the lowest id. Distinct messages are matched once and joined back. They meet templates on the
    token count and the first token; templates that begin with a wildcard, on the count alone.
    """
    distinct = messages.select(F.col(text).alias("_m")).distinct()
    d = distinct.withColumn("_t", F.split(F.trim("_m"), r"\s+")).withColumn("_n", F.size("_t")).withColumn("_h", F.element_at("_t", 1)).filter(F.trim("_m") != "")
    c = catalogue.select("template_id", "template", F.split("template", " ").alias("_c")).withColumn("_n", F.size("_c")).withColumn("_h", F.element_at("_c", 1))
    c = c.withColumn("_fixed", F.size(F.filter("_c", lambda x: x != ANY)))
    fits = F.forall(F.zip_with("_t", "_c", lambda a, b: (b == ANY) | (a == b)), lambda x: x)
    by_head = d.join(c.filter(F.col("_h") != ANY), ["_n", "_h"]).filter(fits)
    by_count = d.drop("_h").join(c.filter(F.col("_h") == ANY).drop("_h"), "_n").filter(fits)
    cols = ["_m", "template_id", "template", "_fixed"]
    best = by_head.select(*cols).unionByName(by_count.select(*cols)).groupBy("_m").agg(F.max_by(F.struct("template_id", "template"), F.struct(F.col("_fixed"), -F.col("template_id"))).alias("_b"))
    out = messages.join(best, messages[text] == best["_m"], "left")
    return out.select(*messages.columns, F.coalesce(F.col("_b.template_id"), F.lit(unknown)).alias("template_id"), F.col("_b.template").alias("template"))


def learn_if_train_normal(events: DataFrame, prepare: Callable[[Column], Column], text: str = "content", sim: float = 0.8, **kw) -> DataFrame:
    """The catalogue of the events of normal training sessions only."""
    return mine(events.filter("is_train_normal").withColumn("prepared", prepare(F.col(text))), sim=sim, **kw)


def catalogue_stats(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count(F.lit(1)).alias("templates"), F.count_if(F.col("fit_count") == 1).alias("singletons"), F.coalesce(F.try_divide(F.count_if(F.col("fit_count") == 1), F.count(F.lit(1))), F.lit(0.0)).alias("singleton_rate"), F.max("fit_count").alias("max_count"))


def match_counts(assigned: DataFrame, split: str = "split") -> DataFrame:
    """Events of every template by split."""
    return assigned.groupBy("template_id").pivot(split, ["train", "validation", "test", "none"]).count().na.fill(0)


def merges(catalogue: DataFrame, least: int = 100, most: int = 50) -> DataFrame:
    return catalogue.filter(F.col("fit_count") >= least).orderBy(F.desc("fit_count"), "template_id").limit(most)


def spread(assigned: DataFrame) -> DataFrame:
    """Templates that several services or levels emit."""
    return assigned.filter("template_id > 0").groupBy("template_id").agg(F.count_distinct("tc_service").alias("services"), F.count_distinct("level").alias("levels"), F.count(F.lit(1)).alias("events")).filter("services > 1 or levels > 1")


def unknown_events(assigned: DataFrame, text: str = "prepared") -> DataFrame:
    return assigned.filter("template_id = 0").withColumn("text_hash", F.sha2(text, 256))


def compare_assignments(a: DataFrame, b: DataFrame, on: str = "ordinal") -> DataFrame:
    """For each template of a, the templates of b that its events went to."""
    both = a.select(on, F.col("template_id").alias("a")).join(b.select(on, F.col("template_id").alias("b")), on)
    return both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("into"), F.count(F.lit(1)).alias("events"))


def frozen(before: DataFrame, after: DataFrame) -> bool:
    """Whether two catalogues hold the same templates."""
    x, y = before.select("template_id", "template"), after.select("template_id", "template")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
