"""Exact top-k search by inner product over whole-number vectors.

A component x becomes floor(SCALE * x). Vectors are range-sorted by descending length (norm) and cut into slices; an orthogonal rotation, fitted by
singular value decomposition on a bounded sample, puts most of the inner product into the first rotated dimensions. Blocks of queries go
down the ranges of slices by descending length, in rounds of more ranges each: a range is left out, with all behind it, once |q| * |v| can't reach
the k-th score of any query of the block, before anything is joined; inside a slice the same holds for its tiles, and partial sums over the
first HEAD rotated dimensions plus the Cauchy-Schwarz bound on the rest pick the pairs whose whole-number product is then computed exactly.
Queries start from the k-th score among the longest vectors; each round raises the k-th scores for the next. The rotation affects speed alone.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; of rows that repeat
an id the one with the smallest vector counts; only vectors of one dimension are compared (a vector of none scores 0 with its like);
ties go to the smaller id; an empty table gives no rows; further columns are ignored. Scores must fit a double's 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, materialise

SCALE = 256
#: Vectors that the rotation is fitted on, and that give the first bounds; vectors of a slice, of a tile; queries of a block.
SAMPLE, SLICE, TILE, BLOCK, HEAD = 4096, 8192, 512, 1024, 16
#: Slices of a range, about, and ranges, at most (the driver knows of each its greatest length and its slices); the next round takes GROWTH
#: times the ranges of the last.
SLICES, RANGES, GROWTH = 4, 20_000, 8


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: the sample's right singular vectors by falling singular value."""
    return np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(sample.shape[1])


def search_slice(ids, v, query_ids, q, bounds, turn, k: int):
    """Top k of a slice (ids and v by descending length) for each query that beats its bound: arrays query index, id, score."""
    far = np.iinfo(np.int64).max
    top = np.full((len(q), k), -np.inf)
    top_ids = np.full((len(q), k), far)
    head = min(HEAD, v.shape[1])
    qr, vr = q @ turn[:, :head], v @ turn[:, :head]
    q_norm, v_norm = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    rest = lambda n, r: np.sqrt(np.maximum(0, n**2 - (r**2).sum(1)))
    q_rest, v_rest = rest(q_norm, qr), rest(v_norm, vr)
    for at in range(0, len(v), TILE):
        least = np.maximum(bounds, top[:, -1])
        slack = 1e-9 * q_norm * v_norm[at] + 1e-6
        live = np.flatnonzero(q_norm * v_norm[at] + slack >= least)
        if not len(live):
            break
        s = slice(at, at + TILE)
        most = qr[live] @ vr[s].T + np.outer(q_rest[live], v_rest[s]) + slack[live, None]
        open_ = (most >= least[live, None]) & (query_ids[live, None] != ids[None, s])
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            continue
        scores = np.where(open_, q[live] @ v[s].T, -np.inf)
        both = np.concatenate([top[live], scores], axis=1)
        both_ids = np.concatenate([top_ids[live], np.where(open_, ids[None, s], far)], axis=1)
        order = np.lexsort((both_ids, -both), axis=1)[:, :k]
        top[live], top_ids[live] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
    i, j = np.nonzero((top > -np.inf) & (top >= bounds[:, None]))
    return i, top_ids[i, j], top[i, j]


def search(vectors: DataFrame, query_filter: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that query_filter takes."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query_filter, F.lit(False)).alias("is_query"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    floor = lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    rows = rows.select("vec_id", "is_query", F.transform("v", floor).alias("v"))
    with Scratch(spark, "topk") as scratch:
        rows = scratch.write(rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))}))
        sizes = {r.dim: (r.n, r.q) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
        out = None
        for dim, (n, n_queries) in sorted(sizes.items()):
            if n_queries and n > 1:
                one = _search_dim(scratch, rows.filter(F.col("dim") == dim), dim, n, n_queries, k)
                out = one if out is None else out.unionAll(one)
        if out is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return materialise(out.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")


def _search_dim(scratch: Scratch, rows: DataFrame, dim: int, n: int, n_queries: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query at least."""
    spark = rows.sparkSession
    as_matrix = lambda values: np.array(values, dtype=np.float64).reshape(len(values), dim)
    sample = as_matrix([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toLocalIterator()])
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(SAMPLE).select("vec_id", "v").toPandas()
    shared = spark.sparkContext.broadcast((rotation(sample) if dim else None, longest["vec_id"].to_numpy(), as_matrix(longest["v"].to_list())))
    packed = pa.schema([("range", pa.int64()), ("slice", pa.int64()), ("top", pa.float64()), ("s_ids", pa.list_(pa.int64())), ("s_flat", pa.list_(pa.float64()))])

    def cut_slices(batches):
        """Slices of a range, whose vectors come by descending length."""
        number, ids, flat, tops, at = TaskContext.get().partitionId(), [], [], [], 0

        def one(m):
            nonlocal ids, flat, tops, at
            all_ids, all_flat, all_tops = (np.concatenate(x) for x in (ids, flat, tops))
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([number], [at], [all_tops[0]], [all_ids[:m]], [all_flat[: m * dim]]), packed)], schema=packed)
            ids, flat, tops, at = [all_ids[m:]], [all_flat[m * dim :]], [all_tops[m:]], at + 1
            return out

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            flat.append(batch.column(1).flatten().to_numpy())
            tops.append(batch.column(2).to_numpy())
            while sum(map(len, ids)) >= SLICE:
                yield one(SLICE)
        if sum(map(len, ids)):
            yield one(SLICE)

    n_ranges = min(RANGES, -(-n // (SLICE * SLICES)))
    ordered = rows.repartitionByRange(n_ranges, F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "v", "norm")
    slices = scratch.write(ordered.mapInArrow(cut_slices, "range long, slice long, top double, s_ids array<long>, s_flat array<double>"))
    known = sorted((r.range, r.top, r.n) for r in slices.groupBy("range").agg(F.max("top").alias("top"), F.count("*").alias("n")).collect())
    blocks = -(-n_queries // BLOCK)
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    block_schema = pa.schema([("block", pa.int64()), ("q_ids", pa.list_(pa.int64())), ("q_flat", pa.list_(pa.float64())), ("bounds", pa.list_(pa.float64()))])

    def pack_block(key, table):
        turn, ids, v = shared.value
        table = table.sort_by("vec_id")
        q_ids, q = table["vec_id"].to_numpy(), np.array(table["v"].to_pylist(), dtype=np.float64).reshape(len(table), dim)
        i, _, score = search_slice(ids, v, q_ids, q, np.full(len(q), -np.inf), turn, k) if dim else _alike(ids, q_ids, k)
        bounds = np.full(len(q), -np.inf)
        full = np.bincount(i, minlength=len(q)) == k
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, i, score)
        bounds[full] = lowest[full]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([q_ids], block_schema[1].type), pa.array([q.ravel()], block_schema[2].type), pa.array([bounds], block_schema[3].type)], schema=block_schema)

    queries = rows.filter("is_query").select(block_of("vec_id").alias("block"), "vec_id", "v").groupBy("block").applyInArrow(pack_block, "block long, q_ids array<long>, q_flat array<double>, bounds array<double>")
    queries = scratch.write(queries)

    def reaching(batches):
        """The blocks with the least length that a vector must have to reach a k-th score of theirs."""
        for batch in batches:
            reach = []
            for q, bounds in zip(batch.column(2), batch.column(3)):
                q, bounds = q.values.to_numpy().reshape(len(bounds), dim), bounds.values.to_numpy()
                norm = np.linalg.norm(q, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(norm > 0, bounds / norm, np.where(bounds > 0, np.inf, -np.inf))
                reach.append(float(need.min() * (1 - 1e-9) - 1e-6) if dim else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.float64())], names=[*batch.schema.names, "reach"])

    def compare(batches):
        turn = shared.value[0]
        for batch in batches:
            for q_ids, q, bounds, s_ids, v in zip(*batch.columns):
                q_ids, q, bounds, s_ids, v = (x.values.to_numpy() for x in (q_ids, q, bounds, s_ids, v))
                i, ids, scores = search_slice(s_ids, v.reshape(len(s_ids), dim), q_ids, q.reshape(len(q_ids), dim), bounds, turn, k) if dim else _alike(s_ids, q_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    def raised(batches):
        """Blocks with their bounds raised to the k-th scores found so far."""
        for batch in batches:
            out = []
            for q_ids, bounds, ids, scores in zip(batch.column(1), batch.column(3), batch.column(4), batch.column(5)):
                new = bounds.values.to_numpy().copy()
                if ids.is_valid:
                    at = np.searchsorted(q_ids.values.to_numpy(), ids.values.to_numpy())
                    new[at] = np.maximum(new[at], scores.values.to_numpy())
                out.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, block_schema[3].type)], schema=block_schema)

    found, at, step = None, 0, 1
    while at < len(known):
        part = known[at : at + step]
        numbered = spark.createDataFrame(part, "range long, top double, n long")
        with arrow_rows(spark, 4):
            if at:
                rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
                kth = found.withColumn("rank", rank).filter(F.col("rank") == k).groupBy(block_of("query_id").alias("block")).agg(F.collect_list(F.struct("query_id", F.col("score").cast("double").alias("score"))).alias("known"))
                kth = kth.select("block", F.col("known.query_id").alias("ids"), F.col("known.score").alias("scores"))
                queries = scratch.write(queries.join(kth, "block", "left").select("block", "q_ids", "q_flat", "bounds", "ids", "scores").mapInArrow(raised, "block long, q_ids array<long>, q_flat array<double>, bounds array<double>"))
            reach = scratch.write(queries.mapInArrow(reaching, "block long, q_ids array<long>, q_flat array<double>, bounds array<double>, reach double").select("block", "reach"))
            # Block and range numbers first; arrays only for those that are compared.
            dealt = reach.join(F.broadcast(numbered), F.col("reach") <= F.col("top")).select("block", "range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"))
            pairs = dealt.join(slices.drop("top"), ["range", "slice"]).join(queries, "block").select("q_ids", "q_flat", "bounds", "s_ids", "s_flat")
            new = scratch.write(pairs.mapInArrow(compare, "query_id long, vec_id long, score long"))
        if at and new.isEmpty() and reach.filter(F.col("reach") <= part[0][1]).isEmpty():
            break  # no vector of this length or a lesser one can reach any query
        found = new if found is None else found.unionAll(new)
        at, step = at + step, step * GROWTH
    return found


def _alike(ids: np.ndarray, query_ids: np.ndarray, k: int):
    """Vectors without components: every score is 0."""
    best = np.sort(ids)[: k + 1]
    pairs = [(i, x) for i, q in enumerate(query_ids) for x in [x for x in best if x != q][:k]]
    i, x = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
    return i, x, np.zeros(len(i))
