import json
import random
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import text as fx
from logloom.operators import calibrate, cause, detect, features, localize, sessions, split, templates
from logloom.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()))


# splits


def test_allocation():
    assert split.allocate(558_223) == {"train": 390_756, "validation": 83_734, "test": 83_733}
    assert split.allocate(16_838) == {"train": 11_786, "validation": 2_526, "test": 2_526}
    assert split.allocate(0) == {"train": 0, "validation": 0, "test": 0}
    for bad in ({"train": Decimal(1)}, {"train": Decimal("0.5"), "validation": Decimal("0.5"), "test": Decimal(0)}, {"train": Decimal("0.5"), "validation": Decimal("0.2"), "test": Decimal("0.2")}):
        with pytest.raises(ValueError):
            split.allocate(5, bad)


def test_split_does_not_depend_on_order(spark):
    data = [(f"blk_{i}", "Normal" if i % 5 else "Anomaly") for i in range(200)]
    a = split.stratified_split(spark.createDataFrame(data, "id string, label string"), "id", "label", "s")
    random.Random(1).shuffle(data)
    b = split.stratified_split(spark.createDataFrame(data, "id string, label string").repartition(3), "id", "label", "s")
    assert rows(a) == rows(b)
    table = {r["split"]: (r["Normal"], r["Anomaly"]) for r in split.contingency(a).collect()}
    assert table == {"train": (112, 28), "validation": (24, 6), "test": (24, 6)}
    assert split.same_ids(a, b, "id").count() == 0


def test_sample_traces(spark):
    import hashlib

    sizes = [(f"t{i}", i % 7 + 1) for i in range(500)]
    want, total = set(), 0
    for t, n in sorted(sizes, key=lambda x: hashlib.sha256(f"z\0{x[0]}".encode()).hexdigest()):
        if total < 300:
            want.add(t)
        total += n
    assert {r["t"] for r in split.sample_traces(spark.createDataFrame(sizes, "t string, n long"), "t", "n", 300, "z").collect()} == want


# templates


def prepared(spark, messages, mask=fx.mask_c):
    df = spark.createDataFrame([(i + 1, m) for i, m in enumerate(messages)], "ordinal long, content string")
    return df.withColumn("prepared", mask(F.col("content")))


def test_template_goldens(spark):
    first = prepared(spark, ["Receiving block blk_1 src: /10.0.0.1:54106 dest: /10.0.0.2:50010", "Receiving block blk_2 src: /10.0.0.3:54107 dest: /10.0.0.4:50010", "Receiving block blk_-3 src: /10.0.0.3:54108 dest: /10.0.0.4:50010"])
    found = templates.mine(first, sim=0.8)
    assert [(r["template_id"], r["template"], r["fit_count"]) for r in found.collect()] == [(1, "Receiving block <BLOCK_ID> src: <*> dest: /<IP>:50010", 3)]
    other = prepared(spark, ["Receiving block blk_9 src: /10.9.9.9:1 dest: /10.0.0.1:60000", "Receiving block blk_9 src: /10.9.9.9:1 dest: /10.0.0.1:50010", " "])
    assert [r["template_id"] for r in templates.match(other, found).orderBy("ordinal").collect()] == [0, 1, 0]
    assert templates.frozen(found, templates.mine(first, sim=0.8))
    job = prepared(spark, ["BLOCK* NameSystem.allocateBlock: /mnt/hadoop/mapred/system/job_200811092030_0001/job.jar. blk_1"])
    learned = templates.mine(job, sim=0.8)
    assert "<JOB_ID>" in learned.first()["template"] and "<BLOCK_ID>" in learned.first()["template"]
    again = "BLOCK* NameSystem.allocateBlock: /mnt/hadoop/mapred/system/job_200811092030_0002/job.jar. blk_5"
    assert templates.match(prepared(spark, [again]), learned).first()["template_id"] == 1
    assert templates.match(prepared(spark, [again], fx.mask_a), learned).first()["template_id"] == 0


def test_mining_merged_and_exact_agree_and_every_fitted_message_matches(spark):
    rng = random.Random(4)
    p = prepared(spark, [f"user {rng.choice('abc')} did {rng.choice(['login', 'logout', 'read file'])} in {rng.randrange(3)} ms" for _ in range(300)])
    a, b = templates.mine(p), templates.mine(p, exact=True)
    assert rows(a) == rows(b) and templates.match(p, a).filter("template_id = 0").count() == 0
    stats = templates.catalogue_stats(a).first()
    assert stats["templates"] == a.count() and templates.unknown_events(templates.match(p, a)).count() == 0
    events = p.withColumn("is_train_normal", F.col("ordinal") <= 10)
    assert templates.learn_if_train_normal(events, fx.mask_c).agg(F.sum("fit_count")).first()[0] == 10


# calibration


def brute_thresholds(y, s):
    out = []
    for t in sorted(set(s), reverse=True):
        tp, fp = sum(a and b >= t for a, b in zip(y, s)), sum(not a and b >= t for a, b in zip(y, s))
        fn, tn = sum(y) - tp, len(y) - sum(y) - fp
        p, r = tp / (tp + fp), tp / (tp + fn)
        out.append((t, tp, tn, fp, fn, p, r, tn / (tn + fp), 2 * tp / (2 * tp + fp + fn)))
    return out


def test_thresholds(spark):
    rng = random.Random(6)
    for _ in range(4):
        y = [rng.random() < 0.3 for _ in range(60)]
        s = [round(rng.random() * 0.7 + 0.3 * a, 2) for a in y]
        df = spark.createDataFrame(list(zip(y, s)), "y boolean, s double")
        table = brute_thresholds(y, s)
        got = [tuple(r) for r in calibrate.threshold_table(df, "s", F.col("y")).orderBy(F.desc("threshold")).collect()]
        assert len(got) == len(table) and all(np.allclose(a, b) for a, b in zip(got, table))
        best = max(table, key=lambda r: (r[8], r[0]))
        assert calibrate.best_threshold(df, "s", F.col("y")).first()["threshold"] == best[0]
        kept = None
        for r in table:
            f1 = 2 * r[5] * r[6] / (r[5] + r[6]) if r[5] + r[6] else 0.0
            if kept is None or f1 > kept[1]:
                kept = (r[0], round(f1, 4))
        assert calibrate.best_threshold_rounded(df, "s", F.col("y")).first()["threshold"] == kept[0]
        chosen = max((r for r in table if r[6] >= 0.9), key=lambda r: (r[5], r[8], r[7], -r[0]))
        assert calibrate.min_recall_threshold(df, "s", F.col("y")).first()["threshold"] == chosen[0]
        ap = sum((r[6] - b) * r[5] for r, b in zip(table, [0.0, *[x[6] for x in table]]))
        assert calibrate.average_precision(df, "s", F.col("y")).first()[0] == pytest.approx(ap)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y boolean, s double")
    assert tuple(calibrate.confusion(empty, F.col("y"), F.col("s") > 1).first())[:6] == (0, 0, 0, 0, 0, 0.0)
    assert calibrate.threshold_table(empty, "s", F.col("y")).collect() == [] and calibrate.min_recall_threshold(empty, "s", F.col("y")).collect() == []


# detectors


def test_isolation_forest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 4)), [[9, 9, 9, 9.0]]])
    a, b = detect.IsolationForest(trees=60).fit(x).score(x), detect.IsolationForest(trees=60).fit(x).score(x)
    assert (a == b).all() and a.argmax() == 500 and (0 < a).all() and (a <= 1).all()
    df = spark.createDataFrame([(float(i), *map(float, r)) for i, r in enumerate(x[:50])] + [(50.0, float("nan"), 0.0, 0.0, 0.0)], "i double, a double, b double, c double, d double")
    m = detect.IsolationForest(trees=60).fit(x)
    got = [r["s"] for r in detect.score_rows(df, ["a", "b", "c", "d"], m, "s").orderBy("i").collect()]
    assert np.allclose(got[:50], a[:50]) and np.isclose(got[50], m.score(np.zeros((1, 4)))[0])


def test_one_class_machines():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    m = detect.OneClassSVM(nu=0.1).fit(x)
    s = m.score(x)
    assert 0.05 < (s > 1e-6).mean() < 0.15 and m.score(np.array([[8.0, 8, 8]]))[0] > np.quantile(s, 0.95) and len(m.support) >= 0.1 * len(x) - 1
    linear = detect.SGDOneClassSVM(nu=0.1, epochs=5).fit(x + 5)
    assert linear.score(np.zeros((1, 3)))[0] > linear.score(np.full((1, 3), 5.0))[0]


# features


def test_features(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, [-3.0, -4.0]), (4, [4.0, 3.0])], "k long, v array<float>")
    near = features.neighbours(v, "k", "v", k=2, block=2).filter("key = 1").orderBy("rank").collect()
    assert [r["other"] for r in near] == [2, 4] and near[0]["cosine"] == pytest.approx(1.0, abs=1e-6)
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",)], "t string")
    e = {r["t"]: r["vector"] for r in features.embed(texts, "t", features.hash_provider(8)).collect()}
    assert set(e) == {"a b", "c"} and sum(x * x for x in e["c"]) == pytest.approx(1.0)
    n = features.nearest_rank(spark.createDataFrame([(i,) for i in range(1, 11)], "x int").withColumn("g", F.lit(1)), "x", (25, 50, 99), ["g"])
    assert {r["percent"]: r["value"] for r in n.collect()} == {25: 2, 50: 5, 99: 10}
    scaled = features.scaler_fit(v.withColumn("x", F.col("k").cast("double")), ["x"])
    assert tuple(scaled.first()) == (2.5, pytest.approx(1.25**0.5))
    assert features.token_audit(texts.withColumn("k", F.lit(1).cast("long")), "k", "t", lambda xs: [len(x.split()) for x in xs], 1).filter("truncated").count() == 2


# sources and sinks


def test_csv_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.csv").write_text('﻿id,msg\n1,"two\nlines ""q"""\n2,\n', encoding="utf-8")
    (tmp_path / "d" / "b.csv").write_text("id,msg\n3,x\n", encoding="utf-8")
    got = readers.read_csv_tree(spark, str(tmp_path), ["id", "msg"])
    assert rows(got) == [("1", 'two\nlines "q"'), ("2", ""), ("3", "x")]
    with pytest.raises(ValueError):
        readers.read_csv_tree(spark, str(tmp_path), required=("trace",))


def test_zip_and_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.csv", b"id,msg\n1,ol\xe9\n")
        z.writestr("readme.txt", "no")
    got = readers.read_zip_csv(spark, str(tmp_path), ["id", "msg"]).collect()
    assert [(r["id"], r["msg"]) for r in got] == [("1", "ol�")] and got[0]["source_file"].endswith("x.zip!in/a.csv")
    (tmp_path / "log").write_bytes(b"first\r\nsecond\n\nbad \xff\n")
    lines = readers.read_lines(spark, str(tmp_path / "log")).orderBy("line_id").collect()
    assert [(r["line_id"], r["line"]) for r in lines][:3] == [(1, "first"), (2, "second"), (3, "")] and [r["decodes"] for r in lines] == [True, True, True, False]
    big = readers.with_ordinal(spark.range(100).repartition(5))
    assert sorted(r["ordinal"] for r in big.collect()) == list(range(1, 101))
    assert readers.first_lines(readers.read_lines(spark, str(tmp_path / "log")), 2).count() == 2


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Label , BlockId\nNormal,blk_1\n,blk_2\nNormal,x\nOdd,blk_3\nNormal,blk_1\nAnomaly,blk_1\nAnomaly,blk_4\n")
    got = [r["reason"] for r in readers.read_labels(spark, str(tmp_path / "l.csv")).orderBy("row_no").collect()]
    assert got == [None, "blank", "bad_id", "bad_label", "duplicate", "conflict", None]


def test_manifests(tmp_path):
    assert readers.require_accepted(json.dumps({"acceptance": {"accepted": True, "checks": {"a": True}}}))
    for bad in ({"accepted": True}, {"accepted": True, "checks": {}}, {"accepted": True, "checks": {"a": 1}}, {"accepted": False, "checks": {"a": True}}):
        with pytest.raises(ValueError):
            readers.require_accepted(bad)
    sinks.write_json({"b": 1, "a": "é"}, tmp_path / "m.json")
    assert (tmp_path / "m.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n' and len(sinks.sha256_file(tmp_path / "m.json")) == 64
    with pytest.raises(FileExistsError):
        sinks.write_json({}, tmp_path / "m.json")
    with pytest.raises(ValueError):
        sinks.resolve_under(tmp_path, "../x")
    assert "| n | 3 |" in sinks.markdown_report("R", {"s": {"n": 3}})


def test_publish(spark, tmp_path):
    df, path = spark.range(5).withColumn("s", F.lit("x")), str(tmp_path / "p")
    assert sinks.publish(df, path) == sinks.publish(df.repartition(3), path)
    with pytest.raises(FileExistsError):
        sinks.publish(df.limit(4), path)
    sinks.write_routed(df, F.col("id") > 2, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("routed = 'true'").count() == 2
    fresh, old = spark.createDataFrame([(1, "n", ""), (2, "n", "")], "k int, auto string, m string"), spark.createDataFrame([(1, "o", "keep")], "k int, auto string, m string")
    assert rows(sinks.upsert_keep_manual(fresh, old, "k", ("m",))) == [(1, "n", "keep"), (2, "n", "")]
    assert rows(sinks.upsert_latest(old, spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (3, "c", "z")], "k int, auto string, m string"), "k", "auto")) == [(1, "b", "y"), (3, "c", "z")]


# sessions and causes


def event(o, trace, service, level, message="", stack="", ts=None):
    return (o, trace, "", ts or f"2024-01-01T00:00:{o:02d}", level, service, message, stack, "a.b.C", "", "t1", "u1", "p")


EVENT = "ordinal long, tc_trace_id string, traceId string, timestamp string, level string, tc_service string, message string, stack_trace string, logger_name string, tc_trace_call_stack string, tc_tenant string, tc_user string, tc_primitive string"


def test_trace_index_edges(spark):
    e = spark.createDataFrame([event(1, "a", "", "info", ts=" "), event(2, "a", "s", " error ", stack="x\ny"), (3, " ", "a", "2023", None, "r", None, None, "", "", "", "", ""), (4, None, None, "z", "INFO", "q", "", "", "", "", "", "", "")], EVENT)
    out = sessions.trace_index(sessions.traceable(sessions.assign_trace(e))).collect()
    assert len(out) == 1
    r = out[0].asDict()
    assert (r["analysis_trace_id_source"], r["event_count"], r["first_timestamp"], r["services"], r["info_count"], r["error_count"], r["other_count"], r["stack_trace_count"]) == ("mixed", 3, "2023", "r|s", 1, 1, 1, 1)


def test_ranking_ties_and_hypotheses(spark):
    e = spark.createDataFrame([event(1, "a", "z", "INFO"), event(2, "a", "y", "INFO"), event(3, "b", "x", "ERROR", "Service target: db-1"), event(4, "c", "", "WARN"), event(5, "d", "k", "ERROR", "boom")], EVENT)
    e = sessions.assign_trace(e).withColumn("template_id", F.lit(1))
    alerts = e.groupBy("analysis_trace_id").agg(F.lit("review").alias("alert_level"), F.lit(1.0).alias("anomaly_score"), F.lit("").alias("manual_label"))
    ranked = localize.rank_services(localize.service_stats(localize.of_alerts(e, alerts)))
    assert [r["tc_service"] for r in ranked.filter("analysis_trace_id = 'a'").orderBy("candidate_rank").collect()] == ["z", "y"]
    found = {r["analysis_trace_id"]: (r["hypothesis_service"], r["hypothesis_source"], r["evidence_level"]) for r in cause.hypotheses(alerts, e, ranked).collect()}
    assert found == {"a": ("z", "candidate_service_top1", "INFO"), "b": ("db-1", "explicit_logical_component", ""), "c": ("<unknown_service>", "candidate_service_top1", "WARN"), "d": ("k", "first_error_service", "ERROR")}
    ev = cause.build_evidence(e)
    simple = {r["tc_trace_id"]: r["relative_confidence"] for r in cause.simple_hypotheses(ev).collect()}
    assert simple["a"] == "low_relative" and simple["d"] == "medium_relative"
    kinds = {r["tc_trace_id"]: r["evidence_type"] for r in cause.explainable_hypotheses(ev).collect()}
    assert kinds["b"] == "first_error_service" and kinds["a"] == "entry_service"
    d = ev.filter("tc_trace_id = 'd'").first()
    assert (d["tenants_observed"], d["error_services"], d["duration_ms"], d["first_error_logger"]) == ("t1:1", "k:1", 0, "C")


def test_scheduler_boost_and_agreement(spark):
    e = spark.createDataFrame([event(1, "a", "svc", "ERROR", "scheduler recusou 1 de 2 task"), event(2, "a", "svc", "INFO")], EVENT)
    stats = localize.entity_stats(e, e.select(F.col("tc_service").alias("service")))
    top = localize.scheduler_boost(stats, e).filter("rank = 1").first()
    assert top["entity"] == "scheduler" and top["explicit_scheduler_matches"] == 1
    sheet = spark.createDataFrame([("x", "y", "", "y"), ("x", "", "", "nenhum"), ("x", "", "", "q")], "top_candidate_1 string, top_candidate_2 string, top_candidate_3 string, root_service_manual string")
    assert [(r["root_in_top3"], r["root_candidate_rank"]) for r in localize.agreement(sheet).collect()] == [("sim", "2"), ("", ""), ("nao", "")]


def test_one_class_queries_fit_on_the_documented_rows(spark, monkeypatch):
    from logloom.plans import catalogue

    n, seen = 25_000, []
    columns = [F.when(F.col("id") < 5000, 0.0).otherwise(F.col("id") % 7 + F.lit(1 + i)).cast("double").alias(c) for i, c in enumerate(catalogue._INPUTS)]
    traces = spark.range(n).select(F.format_string("t%05d", "id").alias("tc_trace_id"), *columns)
    monkeypatch.setattr(catalogue, "adapted", lambda *a: traces)
    monkeypatch.setattr(catalogue.sessions, "trace_features", lambda x: x)
    for kind in (detect.OneClassSVM, detect.SGDOneClassSVM):
        monkeypatch.setattr(kind, "fit", lambda self, x: seen.append((self, x)) or self)
    monkeypatch.setattr(detect, "score_rows", lambda df, columns, model, name: df.withColumn(name, F.lit(0.0)))
    catalogue.QUERIES["ml12_one_class_svm"](spark, "")
    catalogue.QUERIES["ml13_sgd_one_class_svm"](spark, "")
    (_, drawn), (linear, first) = seen
    low = drawn[:, 0].min()
    assert len(drawn) == 20_000 and 0.17 < (drawn[:, 0] == low).mean() < 0.23
    assert len(first) == n and linear.epochs == 20
