"""Boxes are dealt by image once, before pixels follow from them; boxes and skeletons meet within groups."""

import random

import pytest

from tractspark.operators import matching as J
from tractspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["painted_mask", "blended_tiles", "tile_share", "ensemble_vote", "merged_scales", "mean_intensity", "skeleton_ends", "skeleton_junctions"])
def test_no_shuffle_of_pixels(spark, name):
    got = plan(plans.QUERIES[name](spark, SF))
    assert "hashpartitioning(image" in got
    assert not any("hashpartitioning" in row and any(k in row for k in (" y#", " x#", " by#", " gy#", " ty#")) for row in got.splitlines())


def test_boxes_meet_in_one_shuffle(spark):
    left, right = (plans.X.boxes(spark, SF).filter(f"grader = '{g}'") for g in "FO")
    assert plan(J.box_pairs(left, right, 0.1)).count("Exchange hashpartitioning") == 2  # each side's own


@pytest.mark.parametrize("crowd", [20_000, 5])
def test_box_pairs_as_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(J, "CROWD", crowd)
    rng = random.Random(3)
    boxes = [(rng.choice("ab"), k, (rng.randrange(-200, 900), rng.randrange(-200, 900), rng.choice([1, 30, 200, 3000]), rng.choice([1, 40, 700]))) for k in range(120)]
    frame = spark.createDataFrame(boxes, "image string, fiber_id long, bbox struct<x: int, y: int, width: int, height: int>")
    left, right = frame.filter("fiber_id % 2 = 0"), frame.filter("fiber_id % 2 = 1")

    def area(p, q):
        side = lambda i: max(0, min(p[i] + p[i + 2], q[i] + q[i + 2]) - max(p[i], q[i]))
        return side(0) * side(1)

    want = {(i, a, b) for i, a, p in boxes for k, b, q in boxes if i == k and a % 2 == 0 and b % 2 and area(p, q) > 0}
    got = [(r.image, r.a, r.b) for r in J.box_pairs(left, right, 1e-12).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_skeletons_as_all_pixel_pairs(spark):
    rng = random.Random(4)
    pixels = []
    for f in range(12):  # around the corner of four blocks
        y, x = rng.randrange(495, 520), rng.randrange(495, 520)
        pixels += [("i", f"f{f}", y + k, x + k % 7) for k in range(rng.randrange(3, 25))]
    frame = spark.createDataFrame(pixels, "image string, fiber_id string, y int, x int")
    own = {f: [(y, x) for _, g, y, x in pixels if g == f] for f in {p[1] for p in pixels}}
    share = lambda a, b: sum(any((y - v) ** 2 + (x - u) ** 2 <= 25 for v, u in own[b]) for y, x in own[a]) / len(own[a])
    wanted = [("i", a, b) for a in own for b in own if a != b and (a > b) == (int(a[1:]) % 2 == 0)]
    got = {(r.a, r.b): r.similarity for r in J.skeleton_similarity(frame, spark.createDataFrame(wanted, "image string, a string, b string")).collect()}
    assert got == pytest.approx({(a, b): min(share(a, b), share(b, a)) for _, a, b in wanted})
    found = J.skeleton_similarity(frame, spark.createDataFrame(wanted, "image string, a string, b string"))
    assert "cy#" not in plan(found)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_beyond_two_rounds(spark, monkeypatch, by):
    """Tables of later rounds descend from those they are joined with."""
    from tractspark.operators import quantiles as Qu

    monkeypatch.setattr(Qu, "SMALL", 20)
    frame = spark.range(3001).selectExpr("if(id = 0, null, 'k') AS k", "cast((id * 7919) % 3001 as double) AS v").filter("k is not null")
    assert Qu.quantiles(frame, "v", [0.5], by).first()["q"] == [1500.5]
