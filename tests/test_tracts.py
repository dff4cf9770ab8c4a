"""Hand cases and identities of the measurement operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.functions import geometry as G
from tractspark.functions import names as N
from tractspark.functions import special
from tractspark.operators import cohort as C
from tractspark.operators import matching as J
from tractspark.operators import pixels as P
from tractspark.operators import statistics as S


def trace(labels, step=1):
    return [(i * step, i * step, c) for i, c in enumerate(labels)]


@pytest.mark.parametrize(
    "labels, kind",
    [((1, 2), "one segment"), ((1, 1, 2, 2), "two segments"), ((1, 1, 2, 1), "termination"), ((2, 2, 1, 2), "origin"), ((1, 1, 2, 1, 2), "other"), ((1, 1), "one segment"), ((1, 2, 2), "one segment")],
)
def test_fiber_type(spark, labels, kind):
    df = spark.createDataFrame([(trace(labels),)], "p array<struct<y:int,x:int,label:int>>")
    p = F.col("p")
    assert df.select(G.fiber_type(G.colour_length(p, 1), G.colour_length(p, 2), G.runs(p))).first()[0] == kind


def test_lengths_and_tortuosity(spark):
    df = spark.createDataFrame([(trace([1] * 10),), (trace([2]),), ([],)], "p array<struct<y:int,x:int,label:int>>")
    p = F.col("p")
    rows = df.select(G.colour_length(p, 1), G.colour_length(p, 2), G.tortuosity(p), G.curvature(p)).collect()
    assert rows[0][0] == pytest.approx(9 * math.sqrt(2)) and rows[0][2] < 0 and rows[0][3] == 0
    assert tuple(rows[1]) == (0, 1, 0, 0) and tuple(rows[2]) == (0, 0, 0, 0)


def test_condition_names(spark):
    df = spark.createDataFrame([("hela-20min-1_R3D",), ("plain",), (None,)], "n string")
    n = F.col("n")
    assert [tuple(r) for r in df.select(N.condition_from_name(n), N.duration(n)).collect()][0] == ("hela-20min", "20 min")
    assert df.select(N.condition_from_name(n)).collect()[1][0] == ""
    table = {"H-": "Hela_", "U-": "U2OS_"}
    targets = [("siNT", "siNT"), ("siM", "siMMS22L"), ("siT", "siTONSL")]
    names = spark.createDataFrame([("H-siNT",), ("H-siM#1",), ("U-siT#2",), ("X-siT",)], "n string")
    assert [r[0] for r in names.select(N.rule_rename(n, table, targets)).collect()] == ["Hela_siNT", "Hela_siMMS22L#1", "U2OS_siTONSL#2", None]
    assert [r[0] for r in spark.range(0, 28).select(N.letters(F.col("id"))).collect()][25:] == ["Z", "AA", "AB"]


def test_box_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), g, i * 2 + (g == "b"), tuple(map(int, (*rng.integers(0, 300, 2), *rng.integers(0, 120, 2))))) for i in range(60) for g in "ab"]
    df = spark.createDataFrame(rows, "image long, grader string, fiber_id long, bbox struct<x:int,y:int,width:int,height:int>")

    def iou(p, q):
        w, h = (max(0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k])) for k in (0, 1))
        union = p[2] * p[3] + q[2] * q[3] - w * h
        return w * h / union if union else 0

    want = {(a[0], a[2], b[2]) for a, b in itertools.product(rows, rows) if a[1] == "a" and b[1] == "b" and a[0] == b[0] and iou(a[3], b[3]) > 0.1}
    pairs = J.box_pairs(df.filter("grader = 'a'"), df.filter("grader = 'b'"), 0.1)
    assert {(r.image, r.a, r.b) for r in pairs.collect()} == want
    assert J.difference(df.filter("grader = 'a'"), pairs).count() + J.intersection(df.filter("grader = 'a'"), pairs).count() == 60
    best, greedy = (m.agg(F.sum("iou")).first()[0] for m in (J.optimal_match(pairs, 0), J.greedy_match(pairs)))
    assert best >= greedy - 1e-12


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6)):
        v = rng.random((n, m))
        best = max(sum(v[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        a, b = (x.ravel().tolist() for x in np.indices((n, m)))
        taken = J.best_total(a, b, v.ravel().tolist())
        assert len(taken) == n and sum(v[a[k], b[k]] for k in taken) == pytest.approx(best)


def test_clusters_follow_chains(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "image long, fiber_id long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "image long, a long, b long")
    assert {r.fiber_id: r.cluster for r in J.clusters(nodes, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_rank_test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, r = rng.integers(0, 9, 40) / 2, rng.integers(0, 12, 30) / 2
    rows = [("AI", "t", float(v)) for v in x] + [("AI", "ref", float(v)) for v in r] + [("AI", "ref", None)]
    got = S.rank_test(spark.createDataFrame(rows, "grader string, type string, ratio double"), "ref").first()
    wins, ties = (r[:, None] > x).sum(), (r[:, None] == x).sum()
    assert got.u == wins + ties / 2 and got.delta == pytest.approx((wins - (r[:, None] < x).sum()) / (40 * 30)) and got.effect == -got.delta


def test_exact_rank_sum_p():
    for n1, n2 in ((2, 3), (4, 4), (3, 8)):
        us = [sum(a > b for a in c for b in set(range(n1 + n2)) - set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
        for u in (0, 1, n1 * n2 // 2):
            top = max(u, n1 * n2 - u)
            assert special.rank_sum_p(u, n1, n2, 0) == pytest.approx(min(1, 2 * sum(k >= top for k in us) / len(us)))


def test_tails():
    assert special.t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert special.t_quantile(0.975, 2) == pytest.approx(4.302653, abs=1e-5)
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.052922, abs=1e-5)


def test_regressions_against_numpy(spark):
    """Least squares, Kendall's tau and Deming's slope at an error ratio of 1, which is the main axis."""
    means = spark.createDataFrame([("a", 0.1, 0.12), ("b", 0.5, 0.44), ("c", 0.9, 1.0), ("d", 0.3, 0.2)], "type string, A double, B double")
    line, fit = S.agreement(means).first(), S.deming(means, 1.0).first()
    a, b = np.array([0.1, 0.5, 0.9, 0.3]), np.array([0.12, 0.44, 1.0, 0.2])
    assert line.slope == pytest.approx(np.polyfit(a, b, 1)[0]) and line.kendall == pytest.approx(1.0)
    w, v = np.linalg.eigh(np.cov(a, b))
    assert fit.slope == pytest.approx(v[1, 1] / v[0, 1])


def test_adjusted_p_never_below_raw(spark):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "type string, p double")
    rows = {r.type: r for r in C.adjust_p(df).collect()}
    assert all(r.p_bh >= r.p and r.p_holm >= r.p_bh for r in rows.values())
    assert rows["0"].p_holm == pytest.approx(0.04) and rows["1"].p_bh == pytest.approx(0.16 / 3)


def test_pixels(spark):
    ring = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 0, 2), (1, 2, 0), (1, 9, 9)]
    df = spark.createDataFrame(ring, "image long, y int, x int")
    ringed = P.neighbour_ring(df)
    assert {(r.y, r.x) for r in P.endpoints(ringed).collect()} == {(0, 0), (2, 2), (0, 2), (2, 0), (9, 9)}
    assert {(r.y, r.x) for r in P.junctions(ringed).collect()} == {(1, 1)}
    assert P.label_components(df).select("component").distinct().count() == 2
    line = spark.createDataFrame([(1, 5, i, i) for i in range(6)], "image long, fiber_id long, y int, x int")
    assert [r.y for r in P.trace(line).orderBy("pos").collect()] == list(range(6))


def test_segments_and_json(spark):
    import json

    from tractspark.sources import files

    points = "array<struct<x:int,y:int,label:int>>"
    rows = [(1, [(0, 0, 1), (3, 4, 1), (6, 8, 2)]), (2, [(6, 8, 2), (3, 4, 1), (0, 0, 1)]), (3, [(5, 5, 2)]), (4, [])]
    df = spark.createDataFrame(rows, f"fiber_id int, points {points}")
    got = {r.fiber_id: [(s.label, len(s.points), s.length_px) for s in r.s] for r in df.select("fiber_id", G.oriented_segments(F.col("points")).alias("s")).collect()}
    assert got == {1: [(1, 2, 5.0), (2, 1, 0.0)], 2: [(1, 2, 5.0), (2, 1, 0.0)], 3: [(2, 1, 0.0)], 4: []}
    box = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(7).alias("width"), F.lit(9).alias("height"))
    full = df.select(F.lit("i").alias("image"), "fiber_id", box.alias("bbox"), "points", F.lit(5.0).alias("red"), F.lit(0.0).alias("green"), F.lit("one segment").alias("fiber_type"), F.lit(None).cast("double").alias("ratio"), F.lit(0.25).alias("error_probability"))
    texts = {r.fiber_id: r.json for r in files.trace_json(full, 1.5).collect()}
    assert texts[4] is None
    one = json.loads(texts[1])
    assert one["points"] == ["1,3 6,9", "10,15"] and one["colors"] == ["red", "green"] and one["segmentLengthsPx"] == [2, 1]
    assert (one["x"], one["y"], one["width"], one["height"], one["ratio"], one["proba_error"]) == (1, 3, 10, 13, -1.0, 0.25)


def test_equivalence_intervals(spark):
    rng = np.random.default_rng(3)
    x, y = np.exp(rng.normal(0, 0.3, 300)).round(3), np.exp(rng.normal(0.4, 0.5, 250)).round(3)
    rows = [("t", "A", float(v)) for v in x] + [("t", "B", float(v)) for v in y] + [("same", g, float(v)) for g in "AB" for v in np.tile(x, 40)]
    df = spark.createDataFrame(rows, "type string, grader string, ratio double")
    got = {r.type: r for r in S.equivalence(df, "A", "B", replicates=400).collect()}
    draws = []
    for _ in range(400):
        a, b = rng.choice(x, len(x)), rng.choice(y, len(y))
        at = np.unique(np.concatenate([a, b]))
        gap = np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b))
        draws.append((a.var(ddof=1) / b.var(ddof=1), gap.max(), (gap[:-1] * np.diff(np.log(at))).sum()))
    want = np.percentile(draws, [2.5, 97.5], axis=0)
    r = got["t"]
    assert r.variance_ratio == pytest.approx(x.var(ddof=1) / y.var(ddof=1))
    for k, c in enumerate(("variance", "ks", "wasserstein")):
        assert r[f"{c}_low"] == pytest.approx(want[0, k], rel=0.15) and r[f"{c}_high"] == pytest.approx(want[1, k], rel=0.15)
    assert r.gmr_low < r.gmr < r.gmr_high and not r.equivalent and got["same"].equivalent


def test_partially_overlapping_alternatives(spark):
    df = spark.createDataFrame([(k, 1.0 * (k * 7 % 10) if k < 8 else None, 0.3 + k * 3 % 10 if k > 2 else None) for k in range(12)], "k int, x double, y double")
    both, less, more = (S.partially_overlapping_t(df, "k", alternative=a).first() for a in ("two.sided", "less", "greater"))
    assert less.p + more.p == pytest.approx(1) and both.p == pytest.approx(2 * min(less.p, more.p))
    assert both.low < both.estimate < both.high and less.low == -math.inf and more.high == math.inf and less.high < both.high and more.low > both.low
    assert both.low + both.high == pytest.approx(2 * both.estimate)
    with pytest.raises(Exception, match="two pairs or more"):
        S.partially_overlapping_t(df.filter("x is null or y is null"), "k").collect()
