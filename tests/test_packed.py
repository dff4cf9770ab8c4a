"""Pixel tables with a row for each fiber give what a row for each pixel gives, and pixels leave their blocks as sums only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.operators import matching as J
from tractspark.operators import pixels as P
from tractspark.operators import rounds as R
from tractspark.plans import fixtures as X
from tractspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exact(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[(16, 40, 10**6), (16, 40, 0), (512, 2048, 200_000)], ids=["some alone", "narrow", "as set"])
def both(spark, monkeypatch, request):
    """Walks in images of one and of several blocks, by pixels and by fibers; fibers cross, and some share pixels whole."""
    for name, value in zip(("BLOCK", "WIDE", "CROWD"), request.param):
        monkeypatch.setattr(P, name, value)
    rng, rows = np.random.default_rng(6), []
    for image, size in (("a", 30), ("b", 90), ("c", 200)):
        for f in range(size // 3):
            y, x = rng.integers(0, size, 2)
            for label in rng.integers(0, 3, rng.integers(1, 25)):
                rows.append((image, "FO"[f % 2], f, int(y), int(x), int(label)))
                y, x = max(y + rng.integers(-1, 2), 0), max(x + 1, 0)
    rows += [(i, "O", f + 1001 - f % 2, y, x, k) for i, _, f, y, x, k in rows if f in (2, 4)]
    flat = spark.createDataFrame(rows, "image string, grader string, fiber_id long, y int, x int, label int")
    return flat, P.packed(flat, "grader", "fiber_id", values=("label",), whole=True)


def test_packed_rows_give_the_same(both):
    def results(df):
        side = lambda g, *c: df.filter(F.col("grader") == g).select("image", "y", "x", *c)
        pairs = df.sparkSession.createDataFrame([(i, a, a + d) for i in "abc" for a in range(0, 60, 2) for d in (1, 3, 1001)], "image string, a long, b long")
        shares = J.near_skeletons(df), J.near_skeletons(df, apart="grader")
        labelled = (side(g, F.col("fiber_id").alias("label")) for g in "FO")
        scores = P.colour_scores(side("F", "fiber_id", "label"), side("O", "fiber_id", "label"), pairs)
        return [exact(out) for out in (P.neighbour_ring(df), P.label_components(df), P.boxes_of_components(df), P.trace(df), P.overlap_matrix(*labelled), scores, *shares)]

    flat, packed = both
    want, got = results(flat), results(packed)
    assert all(want) and got == want


def test_boxes_of_components_as_labelled(both):
    flat, packed = both
    want = exact(P.component_boxes(P.label_components(flat).withColumnRenamed("component", "label")))
    assert exact(P.boxes_of_components(packed)) == want and len({r[0] for r in want}) == 3


def test_near_skeletons_and_scores_as_by_hand(both):
    flat, packed = both
    own, shown, pixels = {}, {"F": {}, "O": {}}, flat.collect()
    for r in pixels:
        own.setdefault((r.image, r.fiber_id, r.grader), []).append((r.y, r.x))
    near = lambda p, q: sum(any((y - v) ** 2 + (x - u) ** 2 <= 25 for v, u in q) for y, x in p) / len(p)
    want = {(i, a, b): min(near(p, q), near(q, p)) for (i, a, g), p in own.items() for (j, b, h), q in own.items() if i == j and (g, h) == ("F", "O")}
    assert {(r.image, r.a, r.b): r.similarity for r in J.near_skeletons(packed, apart="grader").collect()} == pytest.approx({k: v for k, v in want.items() if v})
    for r in sorted(pixels, key=lambda r: r.fiber_id):
        shown[r.grader][r.image, r.y, r.x] = r.label
    pairs = flat.sparkSession.createDataFrame([k for k in want if (k[1] + k[2]) % 3 < 2], "image string, a long, b long")
    counts = {}
    for i, a, b in pairs.collect():
        at = [(shown["F"].get((i, *p)), shown["O"][i, *p]) for p in {*own[i, a, "F"], *own[i, b, "O"]} if shown["O"].get((i, *p), 0) > 0]
        if at:
            counts[i, a, b] = [over for k in (1, 2) for over in ((sum(p == t == k for p, t in at), sum(t == k for _, t in at)), (sum(p == t == k for p, t in at), sum(p == k for p, _ in at)))]
    left, right = (packed.filter(F.col("grader") == g) for g in "FO")
    got = {(r.image, r.a, r.b): [r.red_recall, r.red_precision, r.green_recall, r.green_precision] for r in P.colour_scores(left, right, pairs).collect()}
    assert got == {k: pytest.approx([h / n if n else 0 for h, n in v]) for k, v in counts.items()}


def test_fibers_have_the_masks_pixels(spark):
    at = F.explode(F.arrays_zip("y", "x", "label"))
    fibers = X.mask_fibers(spark, SF).select("image", "grader", "fiber_id", at.alias("p")).select("image", "grader", "fiber_id", "p.*")
    assert exact(fibers) == exact(X.mask_pixels(spark, SF))


@pytest.mark.parametrize("name, exchanges", [("ordered_traces", 1), ("skeleton_junctions", 1), ("skeleton_match", 2)])  # the last one adds up pairs' counts
def test_fibers_are_dealt_once(spark, name, exchanges):
    """Also where joins aren't broadcast; no row for each pixel goes through a sort or an exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plan(plans.QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count("Exchange ") == exchanges and "explode(sequence(0" not in got


@pytest.mark.parametrize("name", ["mask_components", "overlap_matrix", "colour_scores", "mean_colour_scores", "optimal_match"])
def test_queries_take_fibers(spark, monkeypatch, name):
    def no(*_):
        raise AssertionError("a row for each pixel")

    monkeypatch.setattr(X, "mask_pixels", no)
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_one_step_as_in_rounds(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in np.c_[rng.integers(0, 3, 300), rng.integers(0, 220, (300, 2))]], "image long, a long, b long")
    edges = edges.withColumns({c: F.col(c).cast(kind) for c in "ab"})
    one = R.components(edges)
    assert "FlatMapGroupsInArrow" in plan(one)
    monkeypatch.setattr(R, "LIMIT", 0)
    assert exact(one) == exact(R.components(edges))


def test_sides_in_one_table(both):
    """Both sides' fibers are read once, also where fibers of both sides share their ids."""
    for df in both:
        df = df.withColumn("of", (F.col("grader") == "O").cast("int")).withColumn("fiber_id", F.floor(F.col("fiber_id") / 2))
        apart = [df.filter(F.col("of") == k).drop("of", "grader") for k in (0, 1)]
        pairs = df.sparkSession.createDataFrame([(i, a, a + d) for i in "abc" for a in range(30) for d in (0, 1, 500)], "image string, a long, b long")
        want = exact(P.colour_scores(*apart, pairs))
        assert want and exact(P.colour_scores(df.drop("grader"), None, pairs)) == want
        label = lambda k: k.drop("label").withColumnRenamed("fiber_id", "label")
        assert exact(P.overlap_matrix(label(df))) == exact(P.overlap_matrix(*map(label, apart)))
