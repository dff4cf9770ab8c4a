"""Matching, components, published agreement figures, renaming and files against plain versions."""

import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tractspark.functions import names as N
from tractspark.functions import special
from tractspark.operators import cohort as C
from tractspark.operators import matching as J
from tractspark.operators import pixels as P
from tractspark.operators import rounds as R
from tractspark.operators import statistics as S
from tractspark.plans import fixtures as X
from tractspark.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(X.boxes(spark, SF).filter("image in (1, 2, 3)").collect(), X.boxes(spark, SF).schema)


def test_first_come_match_and_ordered_union(spark, boxes):
    side = lambda g: boxes.filter(F.col("grader") == g)
    pairs = J.box_pairs(side("F"), side("O"), 0.1)
    used, want = set(), set()
    for i, a, b in sorted((r.image, r.a, r.b) for r in pairs.collect()):
        if not {(i, "a", a), (i, "b", b)} & used:
            used |= {(i, "a", a), (i, "b", b)}
            want.add((i, a, b))
    assert {(r.image, r.a, r.b) for r in J.first_come_match(pairs).collect()} == want
    own = J.box_pairs(boxes, boxes, 0.2).filter("a < b")
    near = {}
    for r in own.collect():
        near.setdefault((r.image, r.a), set()).add(r.b)
        near.setdefault((r.image, r.b), set()).add(r.a)
    for graders in (["F", "O"], ["O", "F"]):
        kept = set()
        for r in sorted(boxes.collect(), key=lambda r: (r.image, graders.index(r.grader), r.fiber_id)):
            if not any((r.image, x) in kept for x in near.get((r.image, r.fiber_id), ())):
                kept.add((r.image, r.fiber_id))
        assert {(r.image, r.fiber_id) for r in J.ordered_union(boxes, own, graders).collect()} == kept
    assert J.ordered_union(boxes, own.limit(0)).count() == boxes.count() and J.first_come_match(pairs.limit(0)).count() == 0


def test_clusters_with_and_without_links_of_one_grader(spark, boxes):
    pairs = J.box_pairs(boxes, boxes, 0.3).filter("a < b")
    grader = {(r.image, r.fiber_id): r.grader for r in boxes.collect()}
    for same in (True, False):
        group = {k: k for k in grader}
        for r in pairs.collect():
            if same or grader[r.image, r.a] != grader[r.image, r.b]:
                old, new = (group[r.image, x] for x in (r.a, r.b))
                group = {k: new if g == old else g for k, g in group.items()}
        want = {}
        for k, g in group.items():
            want.setdefault(g, set()).add(k)
        got = {}
        for r in J.clusters(boxes, pairs, same).collect():
            got.setdefault((r.image, r.cluster), set()).add((r.image, r.fiber_id))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(min(v)[1] == k[1] for k, v in got.items())


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(200)] + [(2, 5, 4), (2, 4, 9), (2, 7, 7)], "image long, a long, b long")
    got = {(r.image, r.node): r.root for r in R.components(edges).collect()}
    assert got == {(1, k): 0 for k in range(1, 201)} | {(2, 5): 4, (2, 9): 4}


def test_pixels_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rng = np.random.default_rng(3)
    own = {(i, int(y), int(x)) for i in (0, 1) for y, x in rng.integers(0, 19, (110, 2))} | {(0, k, k) for k in range(19)}
    df = spark.createDataFrame(sorted(own) + sorted(own)[:5], "image long, y int, x int")
    rings = {(r.image, r.y, r.x): r.ring for r in P.neighbour_ring(df).collect()}
    assert rings == {(i, y, x): sum(1 << k for k, (dy, dx) in enumerate(P.RING) if (i, y + dy, x + dx) in own) for i, y, x in own}
    want, left = {}, set(own)
    for p in sorted(own):
        if p in left:
            n, todo = len({v for q, v in want.items() if q[0] == p[0]}) + 1, [p]
            left.discard(p)
            while todo:
                i, y, x = todo.pop()
                want[i, y, x] = n
                for dy, dx in P.RING:
                    if (q := (i, y + dy, x + dx)) in left:
                        left.discard(q)
                        todo.append(q)
    assert {(r.image, r.y, r.x): r.component for r in P.label_components(df).collect()} == want
    labelled = lambda s: spark.createDataFrame([(i, y, x, (y * 3 + x * s) % 4) for i, y, x in sorted(own) if (y + s * x) % 3] + [(0, 1, 1, 9), (0, 1, 1, 8)], "image long, y int, x int, label long")
    a, b = labelled(1), labelled(2)
    pairs = {}
    for r in a.collect():
        for q in b.collect():
            if r[:3] == q[:3]:
                pairs[r.image, r.label, q.label] = pairs.get((r.image, r.label, q.label), 0) + 1
    got = P.overlap_matrix(a, b).collect()
    area = lambda df: {(r.image, r.label): r["count"] for r in df.groupBy("image", "label").count().collect()}
    na, nb = area(a), area(b)
    assert {(r.image, r.a, r.b): r.shared for r in got} == pairs
    assert all(r.iou == pytest.approx(r.shared / (na[r.image, r.a] + nb[r.image, r.b] - r.shared)) for r in got)


# A published table of cluster summaries on the log scale (type, grader, n, mean, sd) and what was reported for it.
CLUSTERS = [
    ("siNT", "AI", 975, -0.015178977081205925, 0.5297207774031548), ("siNT", "Human", 200, 0.006409591462519784, 0.30127373458164464),
    ("siTONSL", "AI", 1126, 0.08364563439909149, 0.5955292121701314), ("siTONSL", "Human", 149, 0.10562863936969549, 0.3723261479949323),
    ("si53BP1", "AI", 1428, -0.10939278802867636, 0.5025902940338693), ("si53BP1", "Human", 150, -0.12189608500411263, 0.38182455514412933),
    ("siTONSL+si53BP1", "AI", 848, 0.08274654587250291, 0.4488173068425353), ("siTONSL+si53BP1", "Human", 150, 0.024735130514224993, 0.3484216992326421),
]


def test_published_agreement(spark):
    mean = {(t, g): m for t, g, _, m, _ in CLUSTERS}
    means = spark.createDataFrame([(t, mean[t, "AI"], mean[t, "Human"]) for t in sorted({c[0] for c in CLUSTERS})], "type string, A double, B double")
    p = S.agreement_p(means).first()
    assert (round(p.pearson, 3), round(p.pearson_p, 3), p.spearman, p.spearman_p, p.kendall, round(p.kendall_p, 4)) == (0.918, 0.082, 1, 0, 1, 0.0833)
    r = S.regression_intervals(means).first()
    assert (round(r.slope, 3), round(r.slope_low, 3), round(r.slope_high, 3)) == (0.936, -0.294, 2.166)
    assert (round(r.intercept, 6), round(r.intercept_low, 4), round(r.intercept_high, 5)) == (-0.006066, -0.1053, 0.09317)
    d = S.deming(means, 0.0596).first()
    assert (round(d.slope, 3), round(d.intercept, 6)) == (1.101, pytest.approx(-0.007792, abs=2e-6))
    cells = spark.createDataFrame([(t, g, n, m, s * s) for t, g, n, m, s in CLUSTERS], "type string, grader string, n long, m double, v double")
    assert round(S.interaction_of_cells(cells).first().p, 3) == 0.519
    ends = r.asDict()
    assert not spark.range(1).select(S.within(F.lit(ends["slope_low"]), F.lit(ends["slope_high"]), (0.9, 1.1))).first()[0]


def test_distributions():
    assert special.t_quantile(0.99999, 1) == pytest.approx(31830.98, rel=1e-5) and special.t_quantile(0.025, 10) == pytest.approx(-2.228139, abs=1e-6)
    # Mann-Whitney of (1, 2, 3) and (4, 5, 6, 7): U 0, exact p 2 / 35; the same without forcing.
    assert special.rank_sum_p(0, 3, 4, 0, True) == special.rank_sum_p(0, 3, 4, 0) == pytest.approx(2 / 35)
    assert special.rank_sum_p(60, 12, 12, 0, True) == pytest.approx(special.rank_sum_p(60, 12, 12, 0), abs=0.02)
    assert special.rank_sum_p(20000, 150, 150, 0, True) == special.rank_sum_p(20000, 150, 150, 0)  # too many pairs
    import itertools

    for n in (4, 6):
        scores = [sum(np.sign(q[j] - q[i]) for i in range(n) for j in range(i)) for q in itertools.permutations(range(n))]
        for s in set(scores):
            assert special.kendall_p(float(s), n, ((0, 0, 0), (0, 0, 0))) == pytest.approx(min(1, np.mean([abs(x) >= abs(s) for x in scores])))


def test_tests_of_graders(spark):
    rows = [("t", "A", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("t", "B", x) for x in (2.0, 4.0, 6.0, 9.0, 11.0)]
    r = S.welch_and_anova_p(spark.createDataFrame(rows, "type string, grader string, ratio double"), "A", "B").first()
    assert (round(r.t, 4), round(r.df, 3)) == (-2.2234, 5.182) and r.p_welch == pytest.approx(2 * special.t_sf(-r.t, r.df)) and r.p_anova == pytest.approx(2 * special.t_sf(abs(np.sqrt(r.f)), 7))
    ends = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True), ("b", "y", True), ("c", "x", True), ("c", "y", None)], "type string, grader string, excludes_zero boolean")
    assert {r.type: r.disagreement for r in S.interval_disagreement(ends).collect()} == {"a": "x_only", "b": None, "c": None}


def test_renaming_grammars(spark):
    def named(rename, names):
        df = spark.createDataFrame([(n,) for n in names], "n string")
        return [r[0] for r in df.select(rename(F.col("n"))).collect()]

    both = {"U-": "U2OS_", "H-": "Hela_"}
    one = lambda n: N.rule_rename(n, both, [("siNT", "siNT"), ("siM#", "siMMS22L#"), ("siT#", "siTONSL#"), ("T#", "siTONSL#")], whole=("siNT",))
    assert named(one, ["U-siM#1", "H-siT#4", "H-T#AB3", "U-siNT", "U-siNTx", "Q-siNT"]) == ["U2OS_siMMS22L#1", "Hela_siTONSL#4", "Hela_siTONSL#AB3", "U2OS_siNT", None, None]
    two = lambda n: N.rule_rename(n, both, [("siNT", "siNT"), ("siM", "siMMS22L"), ("siT", "siTONSL")], suffixes={"#1AB3": "#AB3"})
    assert named(two, ["H-siNT", "H-siM#1", "U-siT#2", "U-siT#1AB3"]) == ["Hela_siNT", "Hela_siMMS22L#1", "U2OS_siTONSL#2", "U2OS_siTONSL#AB3"]
    three = lambda n: N.rule_rename(n, {"PEO1-": "PEO1-", "PEO4-": "PEO4_", "PE04-": "PEO4_"}, [("siNT", "siNT"), ("siT", "siTONSL#"), ("siM", "siMMS22L#")], whole=("siNT",))
    assert named(three, ["PEO1-siNT", "PEO1-siT2", "PE04-siNT", "PEO4-siT2"]) == ["PEO1-siNT", "PEO1-siTONSL#2", "PEO4_siNT", "PEO4_siTONSL#2"]
    four = lambda n: N.decimal_rename(n, "sitonsl", "siTONSL", {"sint": "siNT", "sitonsl2-2_25": "siTONSL 2.5", "sitonsl2-15": "siTONSL 15"})
    assert named(four, ["sitonsl4_2_25", "sitonsl2-1_125", "sitonsl4_15", "siNT", "sitonsl2-2_25", "other"]) == ["siTONSL4 2.25", "siTONSL2 1.125", "siTONSL4 15", "siNT", "siTONSL 2.5", None]
    five = lambda n: N.joined_rename(n, {"siTONSL": "si5", "si53BP1": "si53"})
    assert named(five, ["siTONSL+si53BP1", "siTONSL", "siNT"]) == ["si5+si53", "siTONSL", "siNT"]
    six = lambda n: N.marked_rename(n, [("MKO#", "U2OS_MMS22LKO#"), ("MKO", "U2OS_MMS22LKO#")], {"U2OS": "U2OS"}, "+S1", "_+S1", "_-S1", " _", [("MK0", "MKO")])
    assert named(six, ["U2OS+S1", "u2os", "MKO#1 +S1", "MKO #4 ", "U2OS_+s1", "mko#6", "mk04 +s1", "MK06", "zzz"]) == ["U2OS_+S1", "U2OS_-S1", "U2OS_MMS22LKO#1_+S1", "U2OS_MMS22LKO#4_-S1", "U2OS_+S1", "U2OS_MMS22LKO#6_-S1", "U2OS_MMS22LKO#4_+S1", "U2OS_MMS22LKO#6_-S1", None]
    with pytest.raises(Exception, match="unknown condition"):
        named(lambda n: N.marked_rename(n, [], {}, "+S1", "a", "b", strict=True), ["zzz"])
    letters = {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}
    df = spark.createDataFrame([(k,) for k in letters], "k long")
    assert {r.k: r.s for r in df.select("k", N.letters(F.col("k")).alias("s")).collect()} == letters


def test_fibers_and_measurements_on_disk(spark, tmp_path):
    point = lambda y, x, k: (y, x, k)
    rows = [
        ("i", "AI", 1, (0, 0, 5, 3), [point(1, k, 1) for k in range(5)], [point(1, 0, 1), point(1, 1, 1), point(1, 2, 2), point(1, 3, 2)], 0.1, (0.5, None)),
        ("i", "AI", 2, (0, 0, 3, 3), [point(1, 1, 1)], [point(1, 1, 1), point(1, 5, 2)], None, None), ("i", "AI", 3, (-1, 0, 3, 3), [point(1, 1, 1)], [], None, None), ("i", "AI", 4, (0, 0, 3, 3), [], [], None, None),
    ]
    files.write_fibers(spark.createDataFrame(rows, files.FIBERS).withColumn("fiber_type", F.lit("stale")), str(tmp_path / "fibers"))
    got = {r.fiber_id: r for r in files.read_fibers(spark, str(tmp_path / "fibers")).collect()}
    assert set(got) == {1, 2} and (got[1].red, got[1].green, got[1].fiber_type, got[1].ratio) == (1.5, 2.0, "two segments", 2 / 1.5)
    assert got[2].fiber_type == "one segment" and got[1].correction.green is None
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "type string, fiber_id long, ratio double")
    for kind in ("parquet", "csv"):
        files.write_measurements(df, str(tmp_path / kind), kind)
        assert sorted(map(str, files.read_measurements(spark, str(tmp_path / kind), df.schema, kind).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_headers_in_any_order_and_spelling(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Fiber ID,First analog (µm),Second analog (µm),Ratio,Fiber type,Valid,Error probability,Image Name\n1,0.0,2.0,,double,true,0.1,c-1\n")
    (tmp_path / "b.csv").write_text("image_name,Ratio,Fiber ID,Second analog (µm),First analog (µm),Fiber type\nc-2,0.5,7,1.0,2.0,origin\n")
    rows = {r.image_name: r for r in files.read_predictions(spark, str(tmp_path)).collect()}
    assert (rows["c-1"].length_um, rows["c-1"].ratio, rows["c-1"].fiber_type, rows["c-1"].valid) == (2.0, None, "two segments", True)
    assert (rows["c-2"].fiber_id, rows["c-2"].length_um, rows["c-2"].ratio, rows["c-2"].error_probability) == (7, 3.0, 0.5, None)
    (tmp_path / "Z.TIF").write_text("x")
    (tmp_path / "a.tif").write_text("x")
    listed = [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), [".tif"]).collect()]
    assert listed == ["Z.TIF", "a.tif"]


def test_wide_quoted_and_broken_prediction_files(spark, tmp_path):
    own = {"Fiber ID": "7", "First analog (µm)": "1.5", "Second analog (µm)": "3", "Ratio": "2", "Fiber type": "single", "Valid": "true", "Error probability": "x", "Image Name": 'a, ""b""'}
    more = [f"extra {k}" for k in range(60)]
    quoted = lambda cells: ",".join(f'"{c}"' for c in cells)
    head, row = [*more[:40], *own, *more[40:]], ["1"] * 40 + list(own.values()) + ["line\nend"] * 20
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "wide.csv").write_text("made by hand\n" + quoted(head) + "\r\n" + quoted(row) + "\r\n\r\n" + quoted(row[:45]) + "\r\n")
    (tmp_path / "broken.csv").write_bytes(b"\xff\x00nothing,here\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    got = files.read_predictions(spark, str(tmp_path)).collect()
    assert len(got) == 2 and {r.image_name for r in got} == {'a, "b"', None}
    r = next(r for r in got if r.image_name)
    assert (r.fiber_id, r.first_um, r.second_um, r.length_um, r.ratio, r.fiber_type, r.valid, r.error_probability) == (7, 1.5, 3.0, 4.5, 2.0, "one segment", True, None)
    short = next(r for r in got if not r.image_name)
    assert (short.fiber_id, short.first_um, short.fiber_type, short.valid) == (7, 1.5, "one segment", None)


def test_paired_samples_that_cannot_be_tested(spark):
    rows = lambda r: spark.createDataFrame(r, "key long, x double, y double")
    for bad in ([(1, 1.0, 2.0), (2, 1.5, None)], [(1, 1.0, 2.0), (2, 2.0, 3.0), (3, 1.0, 1.0)], []):
        with pytest.raises(Exception, match="partially overlapping samples need"):
            S.partially_overlapping_t(rows(bad), "key").collect()
    assert S.partially_overlapping_t(rows([(1, 1.0, 2.0), (2, 2.0, 3.5), (3, 1.0, None), (4, None, 2.0)]), "key").count() == 1


def test_rank_tests_of_many_types_share_the_reference(spark):
    rng = np.random.default_rng(1)
    groups = {(g, t): np.round(rng.normal(k / 9, 1, 15 + 5 * k), 1).tolist() for g in ("A", "B", None) for k, t in enumerate(["ref", "t1", "t2", "t3", None])}
    del groups["B", "ref"]
    df = spark.createDataFrame([(g, t, v) for (g, t), vs in groups.items() for v in vs] + [("A", "none", None)], "grader string, type string, ratio double")
    got = {(r.grader, r.type): r for r in S.rank_test(df, "ref").collect()}
    assert set(got) == {k for k in groups if k[1] != "ref"}
    for (g, t), r in got.items():
        x, ref = np.array(groups[g, t]), np.array(groups.get((g, "ref"), []))
        assert (r.n1, r.n2) == (len(ref), len(x))
        _, n = np.unique(np.concatenate([x, ref]), return_counts=True)
        assert r.ties == (n.astype(float) ** 3 - n).sum()
        if len(ref):
            u = ((x[None] < ref[:, None]) + (x[None] == ref[:, None]) / 2).sum()
            assert r.u == pytest.approx(u) and r.delta == pytest.approx(2 * u / (len(x) * len(ref)) - 1)
        else:
            assert r.u is None


def test_left_over_files_and_lookup(spark):
    a = spark.createDataFrame([("e", "a1"), ("e", "a2")], "entry string, path string")
    assert C.pair_by_position(a, a).count() == 2 and C.pair_by_position(a, a.limit(1), strict=False).filter("second is null").count() == 1
    with pytest.raises(Exception, match="without a partner"):
        C.pair_by_position(a, a.limit(1)).collect()
    fibers = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0)], "fiber_id long, ratio double, length_um double")
    assert C.lookup(fibers, 2).count() == 1 and C.complete(fibers).count() == 1
    assert C.exclude_types(spark.createDataFrame([("a",), (None,), ("b",)], "type string"), ["a"], "type").count() == 2


def test_found_by_all_without_others(spark, boxes):
    assert J.found_by_all(boxes, "F", []).count() > 0
    assert J.found_by_all(boxes, "F", ["O", "missing"]).count() == 0


def test_running_summary_of_a_stream(spark, tmp_path):
    from tractspark.streaming import arrivals

    df = spark.range(10).selectExpr("id", "cast(id % 2 as string) as type", "cast(id as double) as ratio")
    df.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = arrivals.running_summary(rows, ["type"], "ratio").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.type, r.n, r["mean"]) for r in spark.table("sums").collect()} == {("0", 5, 4.0), ("1", 5, 5.0)}


def test_split_depends_on_the_key_alone(spark):
    keys = [*range(-50, 2000), 2**62, None]
    rows = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)] + [(5, 1), (None, 2)], "fiber_id long, other long")
    part = lambda df, **seed: {(r.fiber_id, r.part) for r in C.split(df, "fiber_id", 90, **seed).collect()}

    def want(k, seed=42):
        # A null leaves the hash as it is.
        h = 42 if k is None else xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), h)
        return "train" if (h - (h >> 63 << 64)) % 100 < 90 else "test"

    got = part(rows)
    assert got == {(k, want(k)) for k in keys} == part(rows.repartition(5).withColumn("other", F.lit(0)))
    assert part(rows, seed=7) == {(k, want(k, 7)) for k in keys} != got
    assert 0.87 < sum(p == "train" for _, p in got) / len(got) < 0.93
