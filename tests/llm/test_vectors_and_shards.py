"""Whitening, hard negatives and shards against plain versions, over nulls, repeated and empty rows, ties, hot groups and clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractspark.llm import negatives, queries, sharding, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["plain", "falling", "few", "pairs", "equal", "none", "near"])
def test_components_equal_a_dense_solver(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        values = {"plain": rng.random(n) * 100, "falling": 2.0 ** -np.arange(n), "few": np.where(np.arange(n) < 5, rng.random(n), 0), "pairs": np.repeat(rng.random(n), 2)[:n], "equal": np.ones(n), "none": np.zeros(n), "near": 1 + 1e-9 * np.arange(n)}[kind]
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        got, axes = whitening.components_of(v, 8)
        want = np.linalg.eigvalsh(v)[::-1][:8]
        scale = max(np.abs(v).max(), 1e-300)
        assert len(got) == min(n, 8) and np.abs(got - want).max() <= 1e-13 * scale * n
        assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-13 and np.abs(v @ axes - axes * got).max() <= 1e-13 * scale * n
        assert (np.diff(got) <= 0).all()


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, v string, i int"


def plain_whitening(vectors, most=8):
    """By id and component: n, deviation, whitened (of either sign), explained."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    y = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    w = y @ axes / np.sqrt(values)
    return {(vectors[r][0], k + 1): (n, sum((n * a - b) ** 2 for a, b in zip(x[r], s)), w[r, k], values[k] / np.trace(cov)) for r in range(n) for k in range(len(values))}


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) * np.arange(1, 13) * 0.2 + 3]) for i in range(300)] + [(-4, [1000.5] * 11 + [-0.25])]
    odd = [(400, None), (401, []), (402, [None] * 12), (403, [1.0] * 11 + [float("nan")]), (404, [float("inf")] * 12)]
    short = [(500, [1.0, 2.0]), (501, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 9, 9, "x", 1) for i, v in good + odd + short], VECTORS).repartition(5)
    rows = whitening.whiten(df).collect()
    want = plain_whitening(good)
    got = {(r.vec_id, r.component): r for r in rows if r.vec_id < 400}
    assert set(got) == set(want)
    signs = {k: math.copysign(1, got[-4, k].whitened * want[-4, k][2]) for k in range(1, 9)}
    for key, (n, deviation, w, share) in want.items():
        r = got[key]
        assert (r.n, int(r.deviation)) == (n, deviation) and abs(r.whitened * signs[key[1]] - w) < 1e-8 and abs(r.explained - share) < 1e-9 * share
        assert r.identity_error < 1e-9
    # Equal vectors have no variance, but rows.
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in rows if r.vec_id >= 400) == [(i, k, 2, 0, None, None, None) for i in (500, 501) for k in (1, 2)]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_of_repeated_rows_null_ids_and_large_entries(spark):
    rows = [(None, [float(i), 1.0, -float(i * i)], 0, 0, 0, "", 0) for i in range(6)] * 2 + [(1, [3e38, 0.0, 1.0], 0, 0, 0, "", 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 39 and {r.n for r in got} == {13}
    x = np.array([[min(math.floor(1024 * c), 2**42) + 100000 for c in r[1]] for r in rows], dtype=object)
    want = sorted(int(v) for v in ((13 * x - x.sum(0)) ** 2).sum(1) for _ in range(3))
    assert sorted(int(r.deviation) for r in got) == want and want[-1] > 2**63
    query = spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(query).withColumn("deviation", F.col("deviation").try_cast("long")).filter("deviation is null").count() == sum(w >= 2**63 for w in want)


def plain_negatives(rows, is_anchor, positives=5, most=10, window=(30, 90)):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        whole = [math.floor(256 * float(np.float32(c))) for c in v]
        if i not in kept or (label, whole) < kept[i]:
            kept[i] = (label, whole)
    out = []
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [(s, i) for s, i, other in scores if other != label and window[0] * p <= 100 * s <= window[1] * p][:most]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def some_vectors(n=700, dim=9, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(dim) * 0.4 * (1 + i % 3)
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(4))))
    rows += [(1000 + i, rows[20][1], i % 4) for i in range(150)]  # one vector, many rows
    rows += [(2000 + i, [0.0] * dim, i % 4) for i in range(20)] + [(2100 + i, [round(x * 2) / 2 for x in rows[i][1]], i % 4) for i in range(60)]
    rows += [(3000, None, 1), (3010, [None] * dim, 1), (3020, [float("nan")] * dim, 1), (3030, rows[0][1], None), (None, rows[0][1], 1), (40, rows[1][1], 9), (40, rows[2][1], 0)]
    return rows + [(4000 + 10 * i, [1.0 * i, 2.0], i % 2) for i in range(8)] + [(5000 + 10 * i, [], i % 2) for i in range(6)]


def test_hard_negatives(spark, monkeypatch):
    rows = some_vectors()
    df = spark.createDataFrame([(i, v, label, 0, 0, "", 0) for i, v, label in rows], VECTORS).repartition(7)
    anchors = F.col("vec_id") % 10 == 0
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 1000
    assert sorted(map(tuple, negatives.mine(df, anchors, F.col("label")).collect())) == want
    # Small tiles: many slices and blocks, windows that rise between rounds, bounds that leave tiles out.
    for name, value in (("SAMPLE", 64), ("SLICE", 40), ("BLOCK", 16), ("TILE", (8, 16)), ("FIRST", 3), ("DIRECTIONS", 6)):
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.mine(df, anchors, F.col("label"), 3, 4, (50, 95)).collect())) == plain_negatives(rows, lambda i: i % 10 == 0, 3, 4, (50, 95))
    assert negatives.mine(df.limit(0), anchors, F.col("label")).count() == 0
    assert negatives.mine(df, F.lit(False), F.col("label")).count() == 0


def test_bounds_of_scores_are_safe():
    rng = np.random.default_rng(8)
    a = np.floor(rng.standard_normal((60, 5)) * 300)
    b = np.concatenate([a[:30], -a[10:30], a[:20] * 3, np.floor(rng.standard_normal((40, 5)) * 900), np.zeros((2, 5))])
    directions = negatives.directions_of(b)
    norms = [np.linalg.norm(x, axis=1) for x in (a, b)]
    angles = [negatives.angles_to(x, n, directions) for x, n in zip((a, b), norms)]
    lower, upper = negatives.score_bounds(angles[0], norms[0], angles[1], norms[1])
    assert ((lower <= a @ b.T) & (a @ b.T <= upper)).all()
    assert (upper - lower).mean() < 2 * np.outer(*norms).mean()  # they tell more than the lengths do
    low, high = negatives.range_bounds(angles[0], norms[0], angles[1].min(0), angles[1].max(0), norms[1].min(), norms[1].max())
    assert ((low[:, None] <= a @ b.T) & (a @ b.T <= high[:, None])).all()


DOCS = "doc_id long, text string, shard string, SLOT long, first string, bytes int, `own.x` int"


def plain_shards(rows, shards):
    """Rows of (id, text) in order, with size, crc, shard and slot."""
    data = [(i, (t or "").encode(), len((t or "").encode()) + 1) for i, t in rows]
    total = sum(s for *_, s in data)
    groups = {}
    for i, raw, s in data:
        g = groups.setdefault(raw, [0, 0, []])
        g[0], g[1] = g[0] + 1, g[1] + s
        g[2].append(i)
    last = lambda x: (x is None, x or 0)
    first = {raw: min(g[2], key=last) for raw, g in groups.items()}
    digest = {raw: hashlib.sha256(raw).digest() for raw in groups}
    data.sort(key=lambda r: (last(first[r[1]] if groups[r[1]][0] > 1 else r[0]), digest[r[1]], last(r[0])))
    out, at, starts, slots = [], 0, {}, [0] * shards
    for i, raw, s in data:
        n, whole, _ = groups[raw]
        starts.setdefault(raw, at)
        middle = 2 * starts[raw] + whole if n > 1 and whole <= int(total / shards * sharding.WHOLE) else 2 * at + s
        shard = min(shards - 1, middle * shards // (2 * total))
        out.append((i, s, zlib.crc32(raw), shard, slots[shard]))
        slots[shard] += 1
        at += s
    return out


@pytest.mark.parametrize("shards", [1, 8, 30])
def test_shards(spark, shards):
    rng = np.random.default_rng(4)
    texts = ["é" * int(k) for k in rng.integers(1, 300, 400)]
    rows = [(int(i), f"{i} {t}") for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[5][1]) for i in range(8)] + [(2000 + i, "hot " * 40) for i in range(200)] + [(7, "hot " * 40)]
    rows += [(None, None), (None, ""), (3, ""), (None, "x"), (8, "twice"), (8, "twice"), (8, "other"), (5000, "y" * 100_000)] + [(9, "same row " * 9)] * 60
    df = spark.createDataFrame([(i, t, "s", 5, "f", 6, 7) for i, t in rows], DOCS).repartition(6)
    got = sharding.digests(df, shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect()), key=key) == sorted(plain_shards(rows, shards), key=key)
    kept = sharding.shard_documents(df, shards)
    assert kept.columns == ["doc_id", "text", "first", "bytes", "own.x", "shard", "slot"]
    assert sharding.digests(df.limit(0), shards).count() == 0
    with pytest.raises(ValueError):
        sharding.digests(df, 0)


def test_shards_are_balanced_and_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op13_sharding(spark, SF).collect()
    sizes, largest = [0] * 8, max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) <= 2 * (largest + sum(sizes) / 8 * sharding.WHOLE)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sharding.write_shards(docs, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.select("doc_id", "shard", "slot").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert sorted(r.text or "" for r in back.select("text").collect()) == sorted(r.text or "" for r in docs.select("text").collect())


def test_sizes_without_a_group_and_without_bytes(spark):
    df = spark.createDataFrame([(i, 10) for i in range(80)], "id long, size int")
    got = sharding.assign(df, F.col("size"), F.col("id"), shards=8).collect()
    assert sorted((r.id, r.shard, r.slot) for r in got) == [(i, i // 10, i % 10) for i in range(80)]
    nothing = sharding.assign(df, F.lit(None).cast("long"), F.col("id"), shards=8).collect()
    assert {r.shard for r in nothing} == {0} and sorted(r.slot for r in nothing) == list(range(80))
