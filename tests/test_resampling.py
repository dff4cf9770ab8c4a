"""Bootstraps by draws down a tree of value ranges: counts add up, and intervals are those of plain resampling in law."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.operators import statistics as S


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(0)
    values = {("A", "base"): rng.lognormal(0, 0.5, 300), ("A", "up"): rng.lognormal(0.2, 0.5, 250), ("B", "base"): np.round(rng.lognormal(0, 0.4, 200), 1), ("B", "up"): np.round(rng.lognormal(0.1, 0.6, 220), 1)}
    df = spark.createDataFrame([(t, g, float(v)) for (g, t), vs in values.items() for v in vs] + [("up", "A", None), ("alone", "C", 1.0)], "type string, grader string, ratio double")
    return values, df


def plain_delta(x, r):
    return 2 * np.mean((x[None] < r[:, None]) + (x[None] == r[:, None]) / 2) - 1


@pytest.mark.parametrize("chunk", [9, 4096])
def test_counts_of_every_replicate_add_up(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = spark.createDataFrame([(k, float(v), (v * 7) % 5, (v * 3) % 4) for k in ("a", None) for v in range(100)] + [("b", 1.0, 4, 9)], "k string, v double, x long, y long")

    def measure(row, v, following, counts, before, sizes):
        own = lambda c, b, n: (c * (b[:, None] + np.cumsum(c, axis=1) - c + c / 2)).sum(1) / float(n) ** 2
        return {"nx": counts[0].sum(1).astype(float), "ny": counts[1].sum(1).astype(float), "halfx": own(counts[0], before[0], sizes[0]), "halfy": own(counts[1], before[1], sizes[1]), "zero": (counts[0] * (np.array([h["x"] for h in row["h"]]) == 0)).sum(1).astype(float)}

    got = S._resampled(rows, ["k"], ("x", "y"), 30, 7, 1, measure, dict.fromkeys(("nx", "ny", "halfx", "halfy", "zero"), "sum")).collect()
    assert len(got) == 90 and {r.replicate for r in got} == set(range(30))
    sizes = {k: tuple(sum(r) for r in zip(*[(x[2], x[3]) for x in rows.collect() if x.k == k])) for k in ("a", "b", None)}
    # What lies before each value, summed over all values, is half of the square of the size, if the carried sums are right.
    assert all((r.nx, r.ny) == sizes[r.k] and r.halfx == pytest.approx(0.5) and r.halfy == pytest.approx(0.5) and r.zero == 0 for r in got)


@pytest.mark.parametrize("chunk", [11, 4096])
def test_intervals_of_delta_equal_plain_ones_in_law(spark, graded, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    values, df = graded
    got = {(r.grader, r.type): r for r in S.bootstrap_delta(df, "base", replicates=2000).collect()}
    assert set(got) == {("A", "up"), ("B", "up")}
    rng = np.random.default_rng(5)
    for g in "AB":
        x, r = values[g, "up"], values[g, "base"]
        draws = [plain_delta(rng.choice(x, len(x)), rng.choice(r, len(r))) for _ in range(1000)]
        low, high = np.quantile(draws, [0.025, 0.975])
        near = 0.25 * np.std(draws)
        assert got[g, "up"].low == pytest.approx(low, abs=near) and got[g, "up"].high == pytest.approx(high, abs=near)
        assert got[g, "up"].excludes_zero == (got[g, "up"].low > 0 or got[g, "up"].high < 0)


def test_intervals_of_equivalence_in_law_and_over_chunks(spark, graded, monkeypatch):
    values, df = graded
    rows = df.filter("type = 'up'")
    x, y = values["A", "up"], values["B", "up"]
    rng, draws = np.random.default_rng(6), []
    grid = np.unique(np.log(np.concatenate([x, y])))
    for _ in range(1000):
        a, b = np.sort(rng.choice(x, len(x))), np.sort(rng.choice(y, len(y)))
        gap = np.abs(np.searchsorted(np.log(a), grid, side="right") / len(a) - np.searchsorted(np.log(b), grid, side="right") / len(b))
        draws.append((a.var(ddof=1) / b.var(ddof=1), gap.max(), (gap[:-1] * np.diff(grid)).sum()))
    ends, near = np.quantile(draws, [0.025, 0.975], axis=0), 0.3 * np.std(draws, axis=0)
    for chunk in (13, 4096):
        monkeypatch.setattr(S, "CHUNK", chunk)
        r = S.bootstrap_equivalence(rows, "A", "B", replicates=1500).first()
        for k, c in enumerate(("variance", "ks", "wasserstein")):
            assert r[f"{c}_low"] == pytest.approx(ends[0][k], abs=near[k]) and r[f"{c}_high"] == pytest.approx(ends[1][k], abs=near[k])


def test_little_bootstraps_agree_with_the_full_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sides = [rng.normal(0, 1, 6000), rng.normal(0.3, 2, 4000)]
    df = spark.createDataFrame([("t", k, float(v)) for k, vs in enumerate(sides) for v in vs] + [("t", 0, None), ("few", 0, 1.0), ("few", 1, 1.0)], "type string, side int, value double")
    median = lambda x, wx, y, wy: S.weighted_median(x, wx) - S.weighted_median(y, wy)
    full = S.bootstrap(df, "type", median, 600).collect()
    assert len(full) == 1
    plain = [np.median(rng.choice(sides[0], 6000)) - np.median(rng.choice(sides[1], 4000)) for _ in range(600)]
    low, high = np.quantile(plain, [0.025, 0.975])
    width = high - low
    assert full[0].low == pytest.approx(low, abs=0.15 * width) and full[0].high == pytest.approx(high, abs=0.15 * width)
    monkeypatch.setattr(S, "WHOLE", 1000)
    bags = S.bootstrap(df, "type", median, 200, bags=8).first()
    assert (bags.high - bags.low) == pytest.approx(width, rel=0.35) and (bags.high + bags.low) / 2 == pytest.approx((low + high) / 2, abs=0.4 * width)
    one_large = S.bootstrap(df.filter(f"side = 0 or abs(value) < {np.quantile(np.abs(sides[1]), 0.1)}"), "type", median, 50).first()
    assert one_large.low < one_large.high


def test_weighted_median():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        v, w = np.sort(rng.integers(0, 9, n)).astype(float), rng.integers(0, 4, n)
        w[rng.integers(n)] += 1
        assert S.weighted_median(v, w) == np.median(np.repeat(v, w))


def test_draws_of_values_and_of_weights_have_one_law():
    rng = np.random.default_rng(8)
    for weights in (np.array([0, 1, 2, 0, 5, 1]), np.array([0, 1, 2, 0, 5, 1]) * 1000):
        totals = np.array([9, 0, 40] * 4000)
        got = S._drawn(rng, totals, weights)
        assert got.shape == (12000, 6) and (got.sum(1) == totals).all() and not got[:, weights == 0].any()
        p, some = weights / weights.sum(), got[totals == 40]
        assert some.mean(0) == pytest.approx(40 * p, abs=0.15) and some.var(0) == pytest.approx(40 * p * (1 - p), rel=0.1)
    assert S._drawn(rng, np.zeros(3, int), np.zeros(4, int)).shape == (3, 4)
