"""Skeleton matches and assignments on whole images against all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.operators import matching as J
from tractspark.operators import rounds as R
from tractspark.plans import fixtures as X
from tractspark.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark):
    """Fibers (id, grader, box, pixels) by image, of two images."""
    boxes, out = X.boxes(spark, SF).filter("image in (1, 2)").collect(), {}
    pixels = {}
    for r in X.mask_pixels(spark, SF).filter("image in (1, 2)").collect():
        pixels.setdefault((r.image, r.fiber_id), []).append((r.y, r.x))
    for r in boxes:
        out.setdefault(r.image, []).append((r.fiber_id, r.grader, tuple(r.bbox), np.array(pixels[r.image, r.fiber_id])))
    return out


@pytest.fixture
def two_images(monkeypatch):
    boxes, pixels = X.boxes, X.mask_pixels
    monkeypatch.setattr(X, "boxes", lambda *a: boxes(*a).filter("image in (1, 2)"))
    monkeypatch.setattr(X, "mask_pixels", lambda *a: pixels(*a).filter("image in (1, 2)"))


def similarity(p, q):
    near = ((p[:, None, :] - q[None, :, :]) ** 2).sum(2) <= 25
    return min(near.any(1).mean(), near.any(0).mean())


def all_pairs(few, everyone=False):
    return {(i, a[0], b[0]): similarity(a[3], b[3]) for i, fibers in few.items() for a in fibers for b in fibers if (a[0] < b[0] if everyone else (a[1], b[1]) == ("F", "O"))}


def hungarian(value):
    """Column for each row (rows <= columns) with the greatest sum, by shortest augmenting paths over the whole table."""
    n, m = value.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            gap = -value[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (gap < low[1:])
            low[1:][better], way[1:][better] = gap[better], j0
            j1 = int(np.where(used[1:], np.inf, low[1:]).argmin()) + 1
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.full(n, -1)
    out[owner[1:][owner[1:] > 0] - 1] = np.flatnonzero(owner[1:] > 0)
    return out


def iou(p, q):
    w, h = (max(0, min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k])) for k in (0, 1))
    return w * h / (p[2] * p[3] + q[2] * q[3] - w * h)


def test_skeleton_match_is_of_all_pairs(spark, few, two_images):
    want = {k: round(v, 6) for k, v in all_pairs(few).items() if v > 0.5}
    assert {(r.image, r.a, r.b): pytest.approx(r.similarity, abs=1e-6) for r in Q.skeleton_match(spark, SF).collect()} == want
    boxes = {(i, f[0]): f[2] for i, fibers in few.items() for f in fibers}
    assert any(iou(boxes[i, a], boxes[i, b]) <= 0.25 for i, a, b in want)


def test_agreement_links_skeletons_of_all_fibers(spark, few, two_images):
    group = {(i, f[0]): (i, f[0]) for i, fibers in few.items() for f in fibers}
    for (i, a, b), v in all_pairs(few, everyone=True).items():
        if v > 0.5:
            old, new = group[i, a], group[i, b]
            group = {k: new if g == old else g for k, g in group.items()}
    graders = {}
    for i, fibers in few.items():
        for f in fibers:
            graders.setdefault(group[i, f[0]], set()).add(f[1])
    got = Q.annotator_agreement(spark, SF).first()
    assert (got.total, got.found_by_all) == (len(graders), sum(len(g) == 2 for g in graders.values()))


def test_optimal_match_weighs_all_pairs(spark, few, two_images):
    want = 0
    for i, fibers in few.items():
        left, right = ([f for f in fibers if f[1] == g] for g in "FO")
        table = np.array([[similarity(a[3], b[3]) for b in right] for a in left])
        table = table if len(left) <= len(right) else table.T
        chosen = table[np.arange(len(table)), hungarian(table)]
        want += chosen[chosen >= 0.5].sum()
    got = Q.optimal_match(spark, SF).collect()
    every = all_pairs(few)
    assert sum(every[r.image, r.a, r.b] for r in got) == pytest.approx(want) and all(r.similarity >= 0.5 for r in got)


def test_greedy_and_detection_from_a_tenth(spark, few, two_images):
    want = set()
    for i, fibers in few.items():
        pairs = [(-iou(a[2], b[2]), a[0], b[0]) for a in fibers for b in fibers if (a[1], b[1]) == ("F", "O")]
        used = set()
        for v, a, b in sorted(p for p in pairs if -p[0] >= 0.1):
            if not {("a", a), ("b", b)} & used:
                used |= {("a", a), ("b", b)}
                want.add((i, a, b))
    assert {(r.image, r.a, r.b) for r in Q.greedy_match(spark, SF).collect()} == want
    tp = {r.image: r.tp for r in Q.detection(spark, SF).collect()}
    assert tp == {i: sum(k[0] == i for k in want) for i in few}


def test_best_total_equals_all_matchings():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, m = rng.integers(1, 5, 2)
        table = np.round(rng.random((n, m)), 1 if trial % 2 else 3) * (rng.random((n, m)) < 0.7)
        a, b = np.nonzero(table)
        got = J.best_total(a.tolist(), b.tolist(), table[a, b].tolist())
        assert len(set(a[got])) == len(got) == len(set(b[got]))
        wide = table if n <= m else table.T
        want = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert table[a[got], b[got]].sum() == pytest.approx(want)
    for n, m, share in ((60, 80, 0.1), (120, 90, 0.05), (40, 40, 1.0)):
        table = rng.random((n, m)) * (rng.random((n, m)) < share)
        a, b = np.nonzero(table)
        got = J.best_total(a.tolist(), b.tolist(), table[a, b].tolist())
        wide = table if n <= m else table.T
        assert table[a[got], b[got]].sum() == pytest.approx(wide[np.arange(len(wide)), hungarian(wide)].sum())


def test_a_long_chain_and_a_wide_component(spark):
    # A chain of 40,001 fibers, each pair better than the one before it, and a component whose table would have 10^8 cells.
    n = 20_000
    chain = [(1, k, k, 0.5 + k * 1e-6) for k in range(n)] + [(1, k + 1, k, 0.5 + k * 1e-6 + 4e-7) for k in range(n)]
    star = [(2, k, k, 0.6) for k in range(10_000)] + [(2, k, 0, 0.1) for k in range(1, 10_000)]
    pairs = spark.createDataFrame(chain + star, "image long, a long, b long, iou double")
    best = J.optimal_match(pairs, 0.5).groupBy("image").agg(F.count("*").alias("n"), F.sum("iou").alias("total")).collect()
    assert {r.image: (r.n, round(r.total, 6)) for r in best} == {1: (n, round(sum(max(0.5 + k * 1e-6 + 4e-7, 0) for k in range(n)), 6)), 2: (10_000, 6000.0)}
    used, want = set(), set()
    for i, a, b, v in sorted(chain + star, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if not {(i, "a", a), (i, "b", b)} & used:
            used |= {(i, "a", a), (i, "b", b)}
            want.add((i, a, b))
    assert {(r.image, r.a, r.b) for r in J.greedy_match(pairs).collect()} == want


@pytest.mark.parametrize("limit", [40, 4])
def test_large_images_by_components_and_rounds(spark, monkeypatch, limit):
    rng = np.random.default_rng(9)
    rows = [(i, int(a), int(b), float(rng.integers(1, 9)) / 10 + 1e-6 * k) for i, n in ((1, 60), (2, 8), (3, 30)) for k, (a, b) in enumerate({(int(a), int(b)) for a, b in rng.integers(0, 25, (n, 2))})]
    pairs = spark.createDataFrame(rows, "image long, a long, b long, iou double")
    whole = [sorted(map(tuple, f(pairs).collect())) for f in (J.greedy_match, J.first_come_match)]
    total = J.optimal_match(pairs, 0.0).agg(F.sum("iou")).first()[0]
    own = pairs.filter("a < b")
    nodes = spark.createDataFrame([(i, k) for i in (1, 2, 3) for k in range(25)], "image long, fiber_id long")
    stay = sorted(map(tuple, R.first_come_set(nodes, own).collect()))
    monkeypatch.setattr(R, "LIMIT", limit)
    assert [sorted(map(tuple, f(pairs).collect())) for f in (J.greedy_match, J.first_come_match)] == whole
    assert J.optimal_match(pairs, 0.0).agg(F.sum("iou")).first()[0] == pytest.approx(total)
    assert sorted(map(tuple, R.first_come_set(nodes, own).collect())) == stay


@pytest.mark.parametrize("side, units, size", [(22, 20, 10_000), (5, 10, 45)])
def test_auction_has_the_greatest_total(spark, side, units, size):
    # One component beyond a task's size, ties, repeated pairs, an image of its own with pairs of no use, and ids that both images share.
    rng = np.random.default_rng(21)
    kept = sorted({(int(a), int(b)) for a, b in rng.integers(0, side, (side * 2, 2))} | {(k, k) for k in range(side)} | {(k, (k + 1) % side) for k in range(side)})
    rows = [(1, a, b, int(rng.integers(0, 11)) / 10) for a, b in kept]
    rows += [(1, *rows[0][1:3], 0.1), (1, *rows[1][1:3], 1.0), (2, 0, 0, 0.0), (2, 1, 1, 0.7), (2, 1, 2, 0.7), (2, 3, 2, 0.1)]
    pairs = spark.createDataFrame(rows, "image long, a long, b long, iou double").repartition(3)
    got = R.best_in_rounds(pairs, units, size).collect()
    assert got and set(map(tuple, got)) <= set(rows)
    assert len({(r.image, r.a) for r in got}) == len(got) == len({(r.image, r.b) for r in got})
    for image, n in ((1, side), (2, 4)):
        table = np.zeros((n, n))
        for _, a, b, v in (r for r in rows if r[0] == image):
            table[a, b] = max(table[a, b], v)
        assert sum(r.iou for r in got if r.image == image) == pytest.approx(table[np.arange(n), hungarian(table)].sum())
    assert R.best_in_rounds(pairs.limit(0)).count() == 0


def test_boxes_of_mixed_sizes_meet_across_levels(spark):
    rng = np.random.default_rng(12)
    shape = lambda k: (int(rng.integers(-300, 3000)), int(rng.integers(-300, 3000)), int(2 ** rng.uniform(0, k)), int(2 ** rng.uniform(0, k)))
    boxes = [(i, g, k + 1000 * (g == "O"), shape(size)) for i, size in ((1, 7), (2, 12), (3, 5)) for g in "FO" for k in range(60)]
    boxes += [(2, "F", 900, (0, 0, 100_000, 100_000)), (2, "O", 1900, (-5, -5, 100_003, 99_000)), (2, "O", 1901, (64, 64, 64, 64)), (2, "F", 901, (64, 64, 64, 64)), (4, "F", 1, (0, 0, 5, 5)), (2, "F", 902, (10, 10, 0, 4))]
    df = spark.createDataFrame(boxes, "image long, grader string, fiber_id long, bbox struct<x:int,y:int,width:int,height:int>")
    left, right = (df.filter(F.col("grader") == g) for g in "FO")
    pairs = [(p, q) for p in boxes for q in boxes if p[0] == q[0] and (p[1], q[1]) == ("F", "O")]
    want = {(p[0], p[2], q[2]): iou(p[3], q[3]) for p, q in pairs}
    got = [(r.image, r.a, r.b, r.iou) for r in J.box_pairs(left, right, 1e-12).collect()]
    assert {g[:3] for g in got} == {k for k, v in want.items() if v > 1e-12} and len(got) == len({g[:3] for g in got})
    assert all(v == pytest.approx(want[k]) for *k, v in got for k in [tuple(k)])
    touch = lambda p, q, k: p[k] - 5 < q[k] + q[k + 2] and q[k] < p[k] + p[k + 2] + 5
    near = [(r.image, r.a, r.b) for r in J.near_pairs(left, right).collect()]
    assert sorted(near) == sorted((p[0], p[2], q[2]) for p, q in pairs if touch(p[3], q[3], 0) and touch(p[3], q[3], 1))
    levels = left.select("image", F.col("bbox").alias("p")).withColumn("own", J._level("p", 64))
    shown = J._cells(levels, "p", F.filter(F.array(*map(F.lit, range(12))), lambda k: k >= F.col("own")), 64).groupBy("image", "p", "level").count()
    assert shown.agg(F.max("count")).first()[0] <= 4
