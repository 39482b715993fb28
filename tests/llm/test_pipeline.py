import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import mixing, queries
from logloom.llm.common import cut
from tests import test_catalogue
from tests.llm.test_dedup_and_join import brute_components
from tests.llm.test_other_operators import planted
from tests.test_catalogue import duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):  # noqa: F811
    test_catalogue.check(spark, duck, queries.QUERIES, queries.ORACLES, name)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    items, rows = planted(9, 160)
    texts = [(d, t, "src%d" % (d % 4)) for d, t, _ in rows] + [(1000 + d, t + " extra", "src0") for d, t, _ in rows[:30] if len(t.split()) > 60]
    texts += [(2000 + i, "$$$ BUY!! NOW!! " * 40, "src1") for i in range(60)] + [(3000, None, None), (3001, "", "src2")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 2000 <= i < 3000 else 1, 0) for i, _, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, step = docs.columns, dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    good = cut(step[names[0]](spark, docs, corpus), "t")
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and not ids & set(range(2000, 2060)) and len(ids) >= 0.9 * (docs.count() - 60)  # learned from some 150 documents
    one = cut(step[names[1]](spark, good, corpus), "t")
    found = brute_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _, c, _ in found if i == c)
    clean = cut(step[names[2]](spark, one, corpus), "t")
    leaked = {r["doc_id"] for r in queries.decontaminate.find_leaks(one, spark.read.parquet(f"{corpus}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaked and leaked
    mixed = cut(step[names[3]](spark, clean, corpus), "t")
    want = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    plan, taken = mixing.mix_sources(clean).select("doc_id", "size", "target", "source_size").collect(), {}
    source = {r["doc_id"]: r["source"] for r in clean.collect()}
    targets = {source[r["doc_id"]]: r["target"] for r in plan}
    for r in plan:
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["size"] * want.get(r["doc_id"], 0)
        assert want.get(r["doc_id"], 0) >= (r["target"] // r["source_size"] if r["source_size"] else 0)
    assert mixed.columns == columns and all(abs(taken[s] - targets[s]) <= 200 for s in targets)
    last = step[names[4]](spark, mixed, corpus).collect()
    assert len(last) == sum(want.values()) and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect())) == sorted(map(tuple, last))


def test_stages_of_nothing(spark, corpus, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_repeated_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("score", F.lit("x")).withColumn("_copies", F.lit(1)).withColumn("component_id", F.lit(1))
    twice = docs.unionByName(docs.filter("doc_id = 0"))
    out = corpus_pipeline.one_of_each(spark, twice, corpus)
    assert out.columns == docs.columns and out.filter("doc_id = 0").count() == 1


def test_clashing_columns_in_every_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for c in ("_score", "_copies", "_nth", "score", "size", "key", "copies", "cid", "tokens"):
        docs = docs.withColumn(c, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() == docs.count()


def test_null_and_clashing_ids_in_every_stage(spark, corpus):
    prose = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 160")
    base = [r["text"] for r in prose.filter("doc_id % 2 = 0").collect() if len((r["text"] or "").split()) > 30][:8]
    rows = [(1, base[0]), (None, base[1]), (None, base[2]), (None, base[2] + " more"), (5, base[3] + " more"), (5, base[3]), (5, base[4]), (7, base[0] + " more"), (7, base[0] + " more"), (None, None), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    got = sorted(((r["doc_id"], r["text"]) for r in stages["n-gram Jaccard join"](spark, df, corpus).collect()), key=str)
    assert len(got) == 8 and [x for x in got if x[0] == 7] == [] and (1, base[0]) in got and (5, base[4]) in got and (None, base[1]) in got and (9, "") in got
    assert sum(x == (None, None) for x in got) == 2 and sum(x[0] == 5 for x in got) == 2 and sum((x[1] or "").startswith(base[2]) for x in got) == 1
    for name in ("quality classifier", "benchmark decontamination"):
        out = stages[name](spark, df, corpus)
        assert out.columns == df.columns and set(map(str, out.collect())) <= set(map(str, df.collect()))
    words = sum(len((t or "").split()) for _, t in rows)
    mixed = stages["mixing sources to target weights"](spark, df, corpus).collect()
    assert sum(len((r["text"] or "").split()) for r in mixed) == words and len(mixed) == len(rows)  # one source: one epoch, of all rows
    tokens = stages["token-ID / binary output"](spark, df, corpus).collect()
    assert len(tokens) == len(rows) and sum(r["doc_id"] == -(2**63) for r in tokens) == 5


def test_folder_is_the_sessions(spark):
    from logloom.llm.common import shared_dir

    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/") and os.path.isdir(shared_dir(spark).removeprefix("file://"))


def test_clear_removes_what_was_written(spark):
    from logloom.llm import common

    kept = cut(spark.range(3), "kept")
    path = common._WRITTEN[-1].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path)
    written, common._WRITTEN[:] = common._WRITTEN[:-1], common._WRITTEN[-1:]
    common.clear(spark)
    assert not os.path.exists(path) and common._WRITTEN == []
    common._WRITTEN[:] = written


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from logloom.llm import common

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getConf = "spark://x", staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
