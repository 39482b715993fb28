import pytest
from pyspark.sql import functions as F

from logloom.operators import review


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, 5), (2, 6)], "k long, y int")
    assert sorted(map(tuple, review.join_one_to_one(a, b, "k").collect())) == [(1, "a", 5), (2, "b", 6)]
    for bad in (b.filter("k = 1"), b.unionByName(b)):
        with pytest.raises(Exception, match="one to one"):
            review.join_one_to_one(a, bad, "k").collect()


def test_train_normal_is_complete(spark):
    split = spark.createDataFrame([(1, "Normal", "train"), (2, "Anomaly", "train"), (3, "Normal", "test")], "block_id long, label string, split string")
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "block_id long, v int")
    assert [r["v"] for r in review.select_train_normal(rows, split).collect()] == [1]
    with pytest.raises(ValueError, match="no row for 1"):
        review.select_train_normal(rows.filter("block_id > 1"), split)


def test_aligned_audit(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "k long, n int"), spark.createDataFrame([(1, 9), (3, 3)], "k long, n int")
    assert tuple(review.aligned_audit({"a": a, "b": b}, "k", ("n",)).first()) == (1, 3, 1, 1)


def test_consolidation_and_detectors(spark):
    assert review.consolidate_manifests({"b": {"accepted": True, "results": {"n": 1}}, "a": {"accepted": False}})["not_accepted"] == ["a"]
    s = spark.createDataFrame([(True, 0.9, 0.1), (False, 0.2, 0.8), (True, 0.8, 0.3)], "t boolean, good double, bad double")
    got = {r["detector"]: r["average_precision"] for r in review.compare_detectors(s, F.col("t"), ["good", "bad"]).collect()}
    assert got["good"] == 1.0 and got["bad"] < 0.8
