import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import calibrate, sessions, split
from logloom.sources import readers, sinks


def test_lines_are_numbered_in_the_order_of_paths(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "2.log").write_text("five\nsix")
    (tmp_path / "b" / "1.log").write_text("three\r\nfour\n")
    (tmp_path / "a.log").write_bytes(b"one\n\xff\n")
    got = [(r["line_id"], r["line"], r["decodes"]) for r in readers.read_lines(spark, [f"{tmp_path}/b", f"{tmp_path}/a.log"]).orderBy("line_id").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6] and [g[1] for g in got][:1] + [g[1] for g in got][2:] == ["one", "three", "four", "five", "six"]
    assert [g[2] for g in got] == [True, False, True, True, True, True]


def test_split_file(spark, tmp_path):
    ok = "BlockId,Label,Split\nblk_1,Normal,train\nblk_2,Anomaly,test\n"
    (tmp_path / "ok.csv").write_text(ok)
    assert sorted(tuple(r) for r in readers.read_split(spark, f"{tmp_path}/ok.csv").collect()) == [("blk_1", "Normal", "train"), ("blk_2", "Anomaly", "test")]
    for name, extra, what in (("a", "blk_3,Odd,train\n", "unknown label"), ("b", "blk_3,Normal,none\n", "unknown split"), ("c", " ,Normal,train\n", "blank id"), ("d", "blk_1,Normal,train\n", "repeated id")):
        (tmp_path / f"{name}.csv").write_text(ok + extra)
        with pytest.raises(Exception, match=what):
            readers.read_split(spark, f"{tmp_path}/{name}.csv").collect()
    (tmp_path / "e.csv").write_text("BlockId,Split\n")
    with pytest.raises(ValueError):
        readers.read_split(spark, f"{tmp_path}/e.csv")


def test_published_rows_and_manifests(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    digest = sinks.publish(spark.range(5), path)
    assert sinks.load_published(spark, path, digest).count() == 5
    with pytest.raises(ValueError):
        sinks.load_published(spark, path, "x")
    sinks.store_json(spark, {"b": 1, "a": "é"}, f"file://{tmp_path}/m.json")
    assert (tmp_path / "m.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        sinks.store_json(spark, {}, f"file://{tmp_path}/m.json")
    sinks.store_json(spark, {"c": 2}, f"file://{tmp_path}/m.json", overwrite=True)
    assert json.loads((tmp_path / "m.json").read_text()) == {"c": 2}


def test_order_over_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("o"), F.when(F.col("id").isin(0, 100, 333), -1).otherwise(F.col("id")).alias("k")).repartition(7)
    assert sorted(r["o"] for r in readers.strictly_increasing(df, "k", "o").collect()) == [100, 333]
    assert readers.strictly_increasing(df.filter("false"), "k", "o").collect() == []
    assert sorted(r["o"] for r in split.evenly_select(df, [F.asc("o")], 5, "o").collect()) == [0, 125, 250, 374, 499]
    tokens = {r["value"]: r["token"] for r in sessions.sequential_tokens(df.select((F.col("o") % 50).alias("u"), "o"), "u", "o", "U").collect()}
    assert tokens == {i: f"<U_{i + 1}>" for i in range(50)}


def test_thresholds_by_ranges(spark):
    rows = [(i / 97, i % 3 == 0) for i in range(300)] + [(5e9, True), (-1.0, False)]
    df = spark.createDataFrame(rows, "s double, t boolean")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in calibrate.threshold_table(df, "s", F.col("t")).collect()}
    assert got == {x: (sum(s >= x and t for s, t in rows), sum(s >= x and not t for s, t in rows), sum(s < x and t for s, t in rows)) for x, _ in rows}
    assert calibrate.threshold_table(df.filter("false"), "s", F.col("t")).collect() == []
    assert calibrate.average_precision(df.filter("false"), "s", F.col("t")).collect()[0][0] == 0


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.savez(tmp_path / "b.npz", y=np.eye(2), x=np.array([7.0, 8.0]))
    np.save(tmp_path / "none.npy", np.zeros((0, 2)))
    got = sorted((r["source_file"].rpartition("/")[2], r["member"], r["row"], list(r["vector"])) for r in readers.read_npy(spark, str(tmp_path)).collect())
    assert got == [("a.npy", "", 0, [0.0, 1.0]), ("a.npy", "", 1, [2.0, 3.0]), ("a.npy", "", 2, [4.0, 5.0]), ("b.npz", "x", 0, [7.0, 8.0]), ("b.npz", "y", 0, [1.0, 0.0]), ("b.npz", "y", 1, [0.0, 1.0])]
