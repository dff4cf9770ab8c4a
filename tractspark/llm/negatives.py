"""Hard negatives by angular triangle filtering: rows of another label whose score with an anchor lies in a window below that of a positive.

A component x becomes floor(SCALE * x); a score is the inner product of whole-number vectors. Every row stores its length and its angles to some
reference directions. By the triangle inequality on the sphere two rows' angle lies between the largest difference of their angles to
one direction and the least of their sums (or of what these leave of a full turn); the cosines of both ends, times both lengths and widened for
rounding, bound the score. Rows are range-sorted by label, nearest direction and angle to it and cut into slices, anchors in the same way
into blocks; a block meets a slice only if what bounds both as a whole overlaps a window that is still open, and of a slice only rows
whose own bounds overlap a window of an anchor are scored. A bounded sample gives the first k-th scores, which raise the windows' lower ends
before anything is joined; slices are visited in two rounds, and the first raises them for the second. Directions and sample change speed alone.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; of rows that repeat an id the one
with the smallest label, then vector, counts; only vectors of one length are compared (those of no components score 0 with their like). Ties go to
the smaller id. Anchors without another row of their label give no rows, nor do positives without a row in their window; as the window
runs from low to high percent of the positive's score, a negative score leaves it empty. An empty table gives no rows; further columns are
ignored. Components must stay within +-LARGEST; scores are whole as long as they fit 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, materialise
from .topk import usable

SCALE, LARGEST = 256, 2.0**40
#: Directions; rows that they are chosen from and that give the first k-th scores; rows of a slice, anchors of a block; of a tile, each.
DIRECTIONS, SAMPLE, SLICE, BLOCK, TILE = 16, 4096, 4096, 4096, (256, 1024)
#: One slice in so many is visited first.
FIRST = 8
#: Added to each end of an interval of angles; arccos near 1 is good to about 5e-8.
ANGLE_SLACK = 2e-7
TILE_FIELDS = [("id", pa.int64()), ("n", pa.int64()), ("label_lo", pa.int64()), ("label_hi", pa.int64()), ("norm_lo", pa.float64()), ("norm_hi", pa.float64())] + [
    (name, pa.list_(kind)) for name, kind in (("angle_lo", pa.float64()), ("angle_hi", pa.float64()), ("ids", pa.int64()), ("labels", pa.int64()), ("flat", pa.float64()), ("norms", pa.float64()), ("angles", pa.float64()))
]
TILE_SCHEMA = pa.schema(TILE_FIELDS)
TILE_DDL = "id long, n long, label_lo long, label_hi long, norm_lo double, norm_hi double, angle_lo array<double>, angle_hi array<double>, ids array<long>, labels array<long>, flat array<double>, norms array<double>, angles array<double>"
BOUNDS = ("id", "label_lo", "label_hi", "norm_lo", "norm_hi", "angle_lo", "angle_hi")


def directions_of(sample: np.ndarray) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sample's farthest from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(sample.shape[1])[: min(1, sample.shape[1])]
    chosen, nearest = [unit[0]], unit @ unit[0]
    while len(chosen) < min(DIRECTIONS, len(unit)) and nearest.min() < 1 - 1e-9:
        chosen.append(unit[int(nearest.argmin())])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    return np.array(chosen)


def angles_to(v: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to the directions; a vector of length 0 gets right angles (its scores are 0 by its length)."""
    cosines = (v @ directions.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def ends(least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores, of intervals of angles and of the products of lengths; safe for rounding."""
    upper, lower = np.cos(np.maximum(least - ANGLE_SLACK, 0)), np.cos(np.minimum(most + ANGLE_SLACK, np.pi))
    slack = 1e-9 * long + 1e-6
    return np.where(lower < 0, lower * long, lower * short) - slack, np.where(upper > 0, upper * long, upper * short) + slack


def score_bounds(a, a_norms, b, b_norms) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all rows of a with all rows of b, of angles and lengths."""
    least, most = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for x, y in zip(a.T, b.T):
        np.maximum(least, np.abs(x[:, None] - y[None]), out=least)
        together = x[:, None] + y[None]
        np.minimum(most, np.minimum(together, 2 * np.pi - together), out=most)
    product = np.outer(a_norms, b_norms)
    return ends(least, most, product, product)


def range_bounds(a, a_norms, lo, hi, norm_lo, norm_hi) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each row of a with any row whose angles lie between lo and hi and whose length between norm_lo and norm_hi."""
    least = np.maximum(np.maximum(lo - a, a - hi), 0).max(1, initial=0.0)
    together = np.minimum(np.where(a + hi <= np.pi, a + hi, np.pi), np.where(a + lo >= np.pi, 2 * np.pi - a - lo, np.pi))
    return ends(least, together.min(1, initial=np.pi), a_norms * norm_lo, a_norms * norm_hi)


def best_of(owner, score, ids, k: int):
    """Order of the k best of each owner: falling scores, then rising ids; and the rank of each."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
    return order[rank < k], rank[rank < k]


def meet(anchors: dict, rows: dict, entries: dict, k: int, same_label: bool):
    """The k best rows of each entry: arrays entry, id, score. An entry is an anchor (`row`) with a window from `low` to `high`; rows are those of
    the anchor's own label without itself, or those of all others. Rows are a slice, in its order."""
    out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    low, row, high = entries["low"].copy(), entries["row"], entries["high"]
    order = np.argsort(row, kind="stable")
    for at in range(0, len(anchors["ids"]), TILE[0]):
        mine = order[slice(*np.searchsorted(row[order], (at, at + TILE[0])))]
        if not len(mine):
            continue
        block = {c: anchors[c][at : at + TILE[0]] for c in ("ids", "labels", "v", "norms", "angles")}
        local = row[mine] - at
        for start in range(0, len(rows["ids"]), TILE[1]):
            tile = {c: rows[c][start : start + TILE[1]] for c in ("ids", "labels", "v", "norms", "angles")}
            least, most = np.full(len(block["ids"]), np.inf), np.full(len(block["ids"]), -np.inf)
            np.minimum.at(least, local, low[mine])
            np.maximum.at(most, local, high[mine])
            # The tile as a whole, then row by row: only windows that overlap go on.
            lower, upper = range_bounds(block["angles"], block["norms"], tile["angles"].min(0), tile["angles"].max(0), tile["norms"].min(), tile["norms"].max())
            live = np.flatnonzero((upper >= least) & (lower <= most) & (least <= most))
            if not len(live):
                continue
            lower, upper = score_bounds(block["angles"][live], block["norms"][live], tile["angles"], tile["norms"])
            open_ = (upper >= least[live, None]) & (lower <= most[live, None])
            equal = block["labels"][live, None] == tile["labels"][None]
            open_ &= equal & (block["ids"][live, None] != tile["ids"][None]) if same_label else ~equal
            columns = np.flatnonzero(open_.any(0))
            if not len(columns):
                continue
            scores = np.where(open_[:, columns], block["v"][live] @ tile["v"][columns].T, np.nan)
            place = np.full(len(block["ids"]), -1)
            place[live] = np.arange(len(live))
            some = mine[place[local] >= 0]
            of = scores[place[row[some] - at]]
            e, j = np.nonzero((of >= low[some, None]) & (of <= high[some, None]))
            if not len(e):
                continue
            found = (np.concatenate([out[0], some[e]]), np.concatenate([out[1], tile["ids"][columns[j]]]), np.concatenate([out[2], of[e, j]]))
            best, rank = best_of(found[0], found[2], found[1], k)
            out = tuple(x[best] for x in found)
            full = rank == k - 1
            low[out[0][full]] = np.maximum(low[out[0][full]], out[2][full])
    return out


def _tile(r: dict, dim: int) -> dict:
    n = len(r["ids"])
    return {"ids": r["ids"], "labels": r["labels"], "norms": r["norms"], "v": r["flat"].reshape(n, dim), "angles": r["angles"].reshape(n, -1)}


def _arrays(batch, names):
    """Rows of a batch as dicts of numpy arrays and numbers."""
    columns = [batch.column(c) for c in names]
    for values in zip(*columns):
        yield {c: x.values.to_numpy() if isinstance(x, pa.ListScalar) and x.is_valid else x.as_py() for c, x in zip(names, values)}


def mine(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives for each anchor and each of its best positives."""
    spark = vectors.sparkSession
    clip = lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(F.col(vector_col).cast("array<double>"), clip).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("label").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("is_anchor").alias("is_anchor")).select("vec_id", "r.label", "r.v", "is_anchor")
    with Scratch(spark, "negatives") as scratch:
        rows = scratch.write(rows.withColumn("dim", F.size("v")))
        sizes = sorted((r.dim, r.n, r.a) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).collect())
        out = [_mine_dim(scratch, rows.filter(F.col("dim") == dim), dim, n, n_anchors, positives, negatives, window) for dim, n, n_anchors in sizes if n_anchors and n > 1]
        if not out:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        found = out[0]
        for more in out[1:]:
            found = found.unionAll(more)
        best = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
        return materialise(found.withColumn("rank", best).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def _mine_dim(scratch: Scratch, rows: DataFrame, dim: int, n: int, n_anchors: int, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, negative_score: the best negatives of each slice at least."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "v").toPandas()
    sample_v = np.array(sample["v"].to_list(), dtype=np.float64).reshape(len(sample), dim)
    directions = directions_of(sample_v)
    norms = np.linalg.norm(sample_v, axis=1)
    known = {"ids": sample["vec_id"].to_numpy(), "labels": sample["label"].to_numpy(), "v": sample_v, "norms": norms, "angles": angles_to(sample_v, norms, directions)}
    shared = spark.sparkContext.broadcast((directions, known))
    m = len(directions)

    def measured(batches):
        for batch in batches:
            v = batch.column(2).flatten().to_numpy().reshape(len(batch), dim)
            norm = np.linalg.norm(v, axis=1)
            angles = angles_to(v, norm, shared.value[0])
            home = angles.argmin(1) if m else np.zeros(len(v), np.int64)
            near = angles[np.arange(len(v)), home] if m else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), pa.array(list(angles), pa.list_(pa.float64())), pa.array(home.astype(np.int32)), pa.array(near)], names=["vec_id", "label", "v", "is_anchor", "norm", "angles", "home", "near"])

    rows = scratch.write(rows.select("vec_id", "label", "v", "is_anchor").mapInArrow(measured, "vec_id long, label long, v array<double>, is_anchor boolean, norm double, angles array<double>, home int, near double"))

    def tiles(size):
        def cut(batches):
            part, held, at = TaskContext.get().partitionId(), [], 0

            def one(table):
                nonlocal at
                label, norm = table["label"].to_numpy(), table["norm"].to_numpy()
                flat, angles = (table[c].combine_chunks().flatten().to_numpy() for c in ("v", "angles"))
                each = angles.reshape(len(table), m)
                values = [(part << 32) + at, len(table), label.min(), label.max(), norm.min(), norm.max(), each.min(0), each.max(0), table["vec_id"].to_numpy(), label, flat, norm, angles]
                at += 1
                return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, TILE_SCHEMA)], schema=TILE_SCHEMA)

            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                while sum(map(len, held)) >= size:
                    table = pa.concat_tables(held)
                    yield one(table.slice(0, size).combine_chunks())
                    held = [table.slice(size)]
            if sum(map(len, held)):
                yield one(pa.concat_tables(held).combine_chunks())

        return cut

    def packed(part: DataFrame, count: int, size: int) -> DataFrame:
        keys = ("label", "home", "near", "vec_id")
        ordered = part.repartitionByRange(-(-count // (4 * size)), *keys).sortWithinPartitions(*keys).select("vec_id", "label", "v", "norm", "angles")
        return scratch.write(ordered.mapInArrow(tiles(size), TILE_DDL))

    slices, blocks = packed(rows, n, SLICE), packed(rows.filter("is_anchor"), n_anchors, BLOCK)
    own = ("ids", "labels", "flat", "norms", "angles")

    # Positives: a window without an end for each anchor, whose start is the k-th score of the sample.
    start_schema = pa.schema([("id", pa.int64()), ("need_low", pa.float64()), ("low", pa.list_(pa.float64()))])

    def positive_starts(batches):
        for batch in batches:
            for r in _arrays(batch, ("id", *own)):
                anchors = _tile(r, dim)
                entries = {"row": np.arange(len(r["ids"])), "low": np.full(len(r["ids"]), -np.inf), "high": np.full(len(r["ids"]), np.inf)}
                e, _, score = meet(anchors, shared.value[1], entries, positives, True)
                low = _kth(e, score, positives, entries["low"])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((r["id"], low.min(), low), start_schema)], schema=start_schema)

    def positive_scores(batches):
        for batch in batches:
            for r in _arrays(batch, ("id", *own, "low", *(f"s_{c}" for c in own))):
                entries = {"row": np.arange(len(r["ids"])), "low": r["low"], "high": np.full(len(r["ids"]), np.inf)}
                e, ids, score = meet(_tile(r, dim), _tile({c: r[f"s_{c}"] for c in own}, dim), entries, positives, True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), r["id"])), pa.array(e.astype(np.int64)), pa.array(ids), pa.array(_whole(score))], names=["id", "row", "positive_id", "score"])

    with arrow_rows(spark, 4):
        starts = scratch.write(blocks.select("id", *own).mapInArrow(positive_starts, "id long, need_low double, low array<double>"))
        needs = blocks.select(*BOUNDS).join(starts.select("id", "need_low"), "id").withColumn("need_high", F.lit(float("inf")))
        pairs = _joined(needs, slices, own, blocks.select("id", *own).join(starts.select("id", "low"), "id"), same_label=True)
        scored = scratch.write(pairs.mapInArrow(positive_scores, "id long, row long, positive_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("id", "row").orderBy(F.desc("score"), "positive_id"))
    chosen = scored.withColumn("rank", rank).filter(F.col("rank") <= positives).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", "rank", "positive_id", "score"))).alias("p"))
    chosen = chosen.select("id", *(F.col(f"p.{c}").alias(c) for c in ("row", "positive_id", "score")))

    # Negatives: a window for each anchor and positive, whose start is raised to the k-th score of the sample, then to that of the first round.
    window_schema = pa.schema([("id", pa.int64()), ("need_low", pa.float64()), ("need_high", pa.float64()), ("row", pa.list_(pa.int64())), ("positive_id", pa.list_(pa.int64())), ("score", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    window_ddl = "id long, need_low double, need_high double, row array<long>, positive_id array<long>, score array<long>, low array<double>, high array<double>"

    def window_row(r, low, high):
        live = low <= high
        needs = (low[live].min(), high[live].max()) if live.any() else (np.inf, -np.inf)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((r["id"], *needs, r["row"], r["positive_id"], r["score"], low, high), window_schema)], schema=window_schema)

    def negative_starts(batches):
        for batch in batches:
            for r in _arrays(batch, ("id", *own, "row", "positive_id", "score")):
                low, high = -(-window[0] * r["score"] // 100).astype(float), (window[1] * r["score"] // 100).astype(float)
                e, _, score = meet(_tile(r, dim), shared.value[1], {"row": r["row"], "low": low, "high": high}, negatives, False)
                yield window_row(r, _kth(e, score, negatives, low), high)

    def raised(batches):
        for batch in batches:
            for r in _arrays(batch, ("id", "row", "positive_id", "score", "low", "high", "entry", "kth")):
                low = r["low"].copy()
                if r["entry"] is not None:
                    low[r["entry"]] = np.maximum(low[r["entry"]], r["kth"])
                yield window_row(r, low, r["high"])

    def negative_scores(batches):
        for batch in batches:
            for r in _arrays(batch, ("id", *own, "row", "positive_id", "score", "low", "high", *(f"s_{c}" for c in own))):
                e, ids, score = meet(_tile(r, dim), _tile({c: r[f"s_{c}"] for c in own}, dim), {c: r[c] for c in ("row", "low", "high")}, negatives, False)
                values = (np.full(len(e), r["id"]), e, r["ids"][r["row"][e]], r["positive_id"][e], r["score"][e], ids, _whole(score))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in values], names=["id", "entry", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    with arrow_rows(spark, 4):
        windows = scratch.write(blocks.select("id", *own).join(chosen, "id").mapInArrow(negative_starts, window_ddl))
        first = F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0
        found = None
        for visited in (first, ~first):
            if found is not None:
                rank = F.row_number().over(Window.partitionBy("id", "entry").orderBy(F.desc("negative_score"), "negative_id"))
                kth = found.withColumn("rank", rank).filter(F.col("rank") == negatives).groupBy("id").agg(F.collect_list(F.struct("entry", F.col("negative_score").cast("double").alias("kth"))).alias("k"))
                windows = scratch.write(windows.join(kth.select("id", F.col("k.entry").alias("entry"), F.col("k.kth").alias("kth")), "id", "left").mapInArrow(raised, window_ddl))
            needs = blocks.select(*BOUNDS).join(windows.select("id", "need_low", "need_high"), "id")
            pairs = _joined(needs, slices.filter(visited), own, blocks.select("id", *own).join(windows.drop("need_low", "need_high"), "id"), same_label=False)
            new = scratch.write(pairs.mapInArrow(negative_scores, "id long, entry long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"))
            found = new if found is None else found.unionAll(new)
    return found.drop("id", "entry")


def _kth(entry: np.ndarray, score: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
    """The windows' starts, raised to the k-th score where there are k."""
    low, least = low.copy(), np.full(len(low), np.inf)
    np.minimum.at(least, entry, score)
    full = np.bincount(entry, minlength=len(low)) >= k
    low[full] = np.maximum(low[full], least[full])
    return low


def _whole(score: np.ndarray) -> np.ndarray:
    """Scores as longs small enough to be taken a hundred times."""
    return np.clip(score, -(2.0**55), 2.0**55).astype(np.int64)


def _joined(needs: DataFrame, slices: DataFrame, own: tuple, blocks: DataFrame, same_label: bool) -> DataFrame:
    """Blocks with the slices that may hold what they need. Numbers and bounds are compared first; arrays follow for pairs that stay."""
    s = slices.select(*(F.col(c).alias(f"s_{c}") for c in BOUNDS))
    gap = F.zip_with(F.zip_with("angle_lo", "s_angle_hi", lambda a, b: a - b), F.zip_with("s_angle_lo", "angle_hi", lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    cosine = F.cos(F.greatest(F.coalesce(F.array_max(gap), F.lit(0.0)) - ANGLE_SLACK, F.lit(0.0)))
    far = F.array_min(F.zip_with(
        F.zip_with("angle_hi", "s_angle_hi", lambda a, b: F.when(a + b <= np.pi, a + b).otherwise(np.pi)),
        F.zip_with("angle_lo", "s_angle_lo", lambda a, b: F.when(a + b >= np.pi, 2 * np.pi - a - b).otherwise(np.pi)), lambda x, y: F.least(x, y),
    ))
    least_cosine = F.cos(F.least(F.coalesce(far, F.lit(np.pi)) + ANGLE_SLACK, F.lit(np.pi)))
    short, long = F.col("norm_lo") * F.col("s_norm_lo"), F.col("norm_hi") * F.col("s_norm_hi")
    slack = long * 1e-9 + 1e-6
    upper = F.when(cosine > 0, cosine * long).otherwise(cosine * short) + slack
    lower = F.when(least_cosine < 0, least_cosine * long).otherwise(least_cosine * short) - slack
    if same_label:
        labels = (F.col("label_lo") <= F.col("s_label_hi")) & (F.col("s_label_lo") <= F.col("label_hi"))
    else:
        labels = ~((F.col("label_lo") == F.col("label_hi")) & (F.col("s_label_lo") == F.col("s_label_hi")) & (F.col("label_lo") == F.col("s_label_lo")))
    met = needs.join(s, labels & (upper >= F.col("need_low")) & (lower <= F.col("need_high"))).select("id", "s_id")
    return met.join(slices.select(F.col("id").alias("s_id"), *(F.col(c).alias(f"s_{c}") for c in own)), "s_id").join(blocks, "id")
