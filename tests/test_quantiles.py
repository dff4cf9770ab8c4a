"""Quantiles by selection against sorted values: ties, NaN, infinite and null values, null groups, a group of ten million values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.operators import cohort as C
from tractspark.operators import quantiles as Q

P = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def at(values, p):
    place = (len(values) - 1) * p
    low, high = math.floor(place), math.ceil(place)
    a, b = values[low], values[high]
    return a if a == b or (a != a and b != b) else (high - place) * a + (place - low) * b


def same(a, b):
    return a == b or (a != a and b != b) or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("small", [100_000, 40])
def test_every_group_and_rank(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "RANGES", 32)
    rng = np.random.default_rng(1)
    groups = {
        ("a", 1): rng.standard_normal(700).tolist(), ("a", 2): [float(x) for x in rng.integers(0, 5, 900)], (None, 1): (10.0 ** rng.uniform(-300, 300, 500)).tolist(), ("b", None): [3.0] * 400 + [1.0, 7.0],
        ("c", 1): [math.nan] * 60 + [math.inf] * 90 + [-math.inf] * 70 + rng.random(80).tolist(), ("d", 1): [2.5], ("d", 2): [1.0, 2.0], ("e", 1): [1.0] * 200 + (1 + rng.random(200) * 1e-15).tolist(),
    }
    rows = [(k, g, v) for (k, g), vs in groups.items() for v in vs] + [("a", 1, None), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, "k string, g int, v double").repartition(5)
    got = {(r.k, r.g): r.q for r in Q.quantiles(df, "v", P, ["k", "g"]).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        values = sorted(values, key=lambda x: (x != x, x))
        assert all(same(x, at(values, p)) for x, p in zip(got[key], P)), key
    every = sorted((v for vs in groups.values() for v in vs), key=lambda x: (x != x, x))
    assert same(Q.medians(df, "v").first()[0], at(every, 0.5))
    assert Q.quantiles(df.limit(0), "v", P, ["k"]).count() == 0 and Q.quantiles(df.filter("k = 'nothing'"), "v", P, ["k"]).count() == 0


def test_a_group_of_ten_million_values(spark):
    n = 10_000_000
    # A permutation of 0 .. n - 1 (a multiplier prime to n), beside a small group.
    big = spark.range(n).select(F.lit("big").alias("type"), ((F.col("id") * 7_654_321 + 11) % n).cast("double").alias("v"))
    df = big.unionAll(spark.range(101).select(F.lit("small").alias("type"), F.col("id").cast("double").alias("v")))
    out = Q.quantiles(df, "v", [0.25, 0.5, 0.99], ["type"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.type: r.q for r in out.collect()}
    assert got["big"] == pytest.approx([(n - 1) * p for p in (0.25, 0.5, 0.99)], rel=1e-12) and got["small"] == [25.0, 50.0, 99.0]


def written(spark):
    """Records of all shuffles so far, as the session's status store has them."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("few", [10_000, 1])
def test_values_of_large_groups_stay_where_they_are(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "SMALL", 1_000)
    monkeypatch.setattr(Q, "FEW", few, raising=False)
    n, sizes = 100_000, {"a": 49_950, None: 49_950, "small": 100}
    name = F.when(F.col("id") < 100, "small").when(F.col("id") % 2 == 0, "a")
    df = spark.range(n).select(name.alias("model"), ((F.col("id") * 7_919) % n).cast("double").alias("v"))
    values = {k: sorted(float(i * 7_919 % n) for i in range(n) if (("small" if i < 100 else "a" if i % 2 == 0 else None) == k)) for k in sizes}
    before, threshold = written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark doesn't broadcast by itself: few of many partitions have rows
    try:
        got = {r.model: r.q for r in Q.quantiles(df, "v", [0.25, 0.5], ["model"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {k: len(v) for k, v in values.items()} == sizes and set(got) == set(sizes)
    assert all(same(x, at(values[k], p)) for k in sizes for x, p in zip(got[k], [0.25, 0.5]))
    # Beyond FEW groups the joins are Spark's choice, and the values the same.
    assert few == 1 or written(spark) - before < n / 4


def test_statistics_keep_null_groups_and_groups_without_values(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "x", 3.0), ("a", "x", None), ("a", "y", 5.0)], "type string, grader string, ratio double")
    got = {(r.type, r.grader): (r.n, r.median) for r in C.summary(df).collect()}
    assert got == {(None, "x"): (2, 2.0), ("a", "x"): (0, None), ("a", "y"): (1, 5.0)}
    assert {r.type: r.q2 for r in C.box_statistics(df).collect()} == {None: 2.0, "a": 5.0}
    assert C.normalise(df, "missing", per_grader=False).filter("ratio is not null").count() == 0
    assert C.normalise(df, "a").filter("grader = 'y'").first().ratio == 1.0
    orders = {r.type: (r.median, r.type_order) for r in C.order_types(df, "ratio").collect()}
    assert orders == {None: (2.0, 1), "a": (5.0, 2)}
