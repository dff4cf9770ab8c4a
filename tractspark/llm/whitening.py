"""Embedding whitening: covariance of whole-number vectors, components by spectral divide and conquer, projection with broadcast components.

An entry c becomes x = floor(SCALE * c) + OFFSET. A first pass gives the count n and the exact sums S of every dimension, a second one the
covariance of x - S/n (centred before multiplying; a task gives one triangle of partial sums, and Spark adds those up). The components are found
on the driver, whose part depends on the dimension alone: the polar factor U of V - sigma*I, by dynamically weighted Halley iterations (QDWH),
gives the projector (U + I) / 2 onto the invariant subspace above sigma; V splits into one block for each of both subspaces, and the blocks are
split in turn until as many components are found as are wanted. Tasks then project the rows with the broadcast components.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped; entries beyond +-LARGEST count as +-LARGEST. Rows with a
null id, repeated ids and repeated rows all stay and all count. Vectors of each length are a fit list of their own; those of no entries have no
components. A component without variance (one vector, equal vectors, fewer rows than dimensions) has no whitened value (null) and no part in
identity_error, which is null if there is no other; `explained` is null where there is no variance at all. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow
from .topk import usable

SCALE, OFFSET, LARGEST = 1024, 100_000, 2**42
#: Halley iterations, at most; six are enough for any condition number of double precision.
ITERATIONS = 30
#: Where a block is cut: at its mean eigenvalue, or so many times its spread beside it when that is too close to one of them.
CUTS = (0.0, 0.21, -0.21, 0.37, -0.37, 0.05, -0.05, 0.55, -0.55, 0.73, -0.73)
EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: iterations by QR while the weights are large, by Cholesky after that."""
    eye = np.eye(len(a))
    x, low = a / np.linalg.norm(a), 1e-16
    for _ in range(ITERATIONS):
        square = min(low * low, 1.0)
        d = np.cbrt(4 * (1 - square) / square**2)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[: len(a)] @ q[len(a) :].T
        else:
            half = np.linalg.solve(np.linalg.cholesky(eye + wc * x.T @ x), x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(np.linalg.cholesky(eye + wc * x.T @ x).T, half).T
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < 1e-6 and low > 1 - 1e-6:
            break
    return x


def split(a: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of the larger eigenvalues first; None if all eigenvalues are as good as equal."""
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= least:
        return None
    best = None
    random = np.random.default_rng(n).standard_normal((n, n))
    for cut in CUTS:
        projector = (polar_factor(a - (middle + cut * spread) * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        # Twice, as a random start may be ill-conditioned; the last decomposition makes both sides orthogonal to each other.
        upper = np.linalg.qr(projector @ np.linalg.qr(projector @ random[:, :k])[0])[0]
        lower = np.linalg.qr(random[:, k:] - projector @ random[:, k:])[0]
        whole = np.linalg.qr(np.concatenate([upper, lower - projector @ lower], axis=1))[0]
        left = np.linalg.norm(whole[:, k:].T @ a @ whole[:, :k])
        if best is None or left < best[0]:
            best = (left, whole[:, :k], whole[:, k:])
        if left <= 4 * least:
            break
    return None if best is None else best[1:]


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    least = len(v) * EPS * max(np.linalg.norm(v), np.finfo(float).tiny)
    found, left = [], [(v, np.eye(len(v)))]
    while left and len(found) < most:
        a, basis = left.pop()
        sides = split(a, least) if len(a) > 1 else None
        if sides is None:
            found += list(basis.T)
            continue
        for side in sides[::-1]:
            block = side.T @ a @ side
            left.append(((block + block.T) / 2, basis @ side))
    vectors = np.array(found).reshape(len(found), len(v))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.einsum("ij,jk,ik->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[order].T


def _by_length(column):
    """Of a batch's vectors: length, row numbers and matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)


def _summed(rows: DataFrame, pieces, schema: str) -> DataFrame:
    """dim, i, j, v: sums over all tasks of the arrays that `pieces` gives for them."""
    return rows.mapInArrow(pieces, schema).select("dim", "i", F.posexplode("v").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))


def whiten(vectors: DataFrame, components: int = 8, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation (decimal: sum of (n*x - S)^2), whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    bound_arrow(spark, 4000)
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    whole = lambda m: (np.clip(np.floor(m * scale), -LARGEST, LARGEST) + offset).astype(np.int64)

    def sums(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for dim, at, m in _by_length(batch.column(1)):
                n, s = own.get(dim, (0, 0))
                own[dim] = (n + len(at), s + whole(m).sum(0).astype(object))
        flat = [[dim, 0, [Decimal(n), *map(Decimal, s)]] for dim, (n, s) in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else ([], [], []), (pa.int32(), pa.int32(), pa.list_(pa.decimal128(38, 0))))], names=["dim", "i", "v"])

    total: dict[int, dict[int, int]] = {}
    for r in _summed(rows, sums, "dim int, i int, v array<decimal(38,0)>").collect():
        total.setdefault(r.dim, {})[r.j] = int(r.v)
    # Of each length: n, and S as n * base + rest, so that no centred value loses digits.
    fit = {dim: (s[0], np.array([s[j + 1] // s[0] for j in range(dim)], np.int64), np.array([s[j + 1] % s[0] for j in range(dim)], np.int64)) for dim, s in total.items()}
    names = [*rows.columns[:1], "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col.replace('`', '``')}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not fit:
        return spark.createDataFrame([], schema)
    fitted = spark.sparkContext.broadcast(fit)
    centred = lambda m, n, base, rest: (whole(m) - base) - rest / n

    def triangles(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, m in _by_length(batch.column(1)):
                y = centred(m, *fitted.value[dim])
                own[dim] = own.get(dim, 0) + y.T @ y
        for dim, m in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([m[i, i:] for i in range(dim)], pa.list_(pa.float64()))], names=["dim", "i", "v"])

    spectra = {}
    entries = _summed(rows, triangles, "dim int, i int, v array<double>").toPandas()
    for dim, of in entries.groupby("dim"):
        v = np.zeros((dim, dim))
        i, j = of["i"].to_numpy(), of["i"].to_numpy() + of["j"].to_numpy()
        v[i, j] = v[j, i] = of["v"].to_numpy() / fit[dim][0]
        values, axes = components_of(v, components)
        trace = float(np.trace(v))
        live = values > 4 * dim * EPS * trace
        spectra[int(dim)] = (values, np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), np.nan), trace)
    shared = spark.sparkContext.broadcast(spectra)

    def squares(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, m in _by_length(batch.column(1)):
                w = centred(m, *fitted.value[dim]) @ shared.value[dim][1]
                own[dim] = own.get(dim, 0) + w.T @ w
        for dim, m in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "v"])

    error: dict[int, float] = {}
    for r in _summed(rows, squares, "dim int, i int, v array<double>").collect():
        if not np.isnan(r.v):
            error[r.dim] = max(error.get(r.dim, 0.0), abs(r.v / fit[r.dim][0] - (r.i == r.j)))

    def project(batches):
        for batch in batches:
            for dim, at, m in _by_length(batch.column(1)):
                (n, base, rest), (values, axes, trace) = fitted.value[dim], shared.value[dim]
                k, x = len(values), whole(m) - base
                w = (x - rest / n) @ axes
                # Within 63 bits the sums are whole numbers of the machine; beyond them, of Python.
                off = x * n - rest if float(np.abs(x).max()) * n < 2**62 else x.astype(object) * n - rest.astype(object)
                if off.dtype == object or float(np.abs(off).max()) ** 2 * dim >= 2**62:
                    deviation = pa.array([Decimal(int(s)) if s < 10**38 else None for s in (off.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
                else:
                    deviation = pa.array((off**2).sum(1)).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, n)), deviation.take(each),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(np.maximum(values, 0) / trace, len(at)) if trace > 0 else [None] * len(each), pa.float64()), pa.array([error.get(dim)] * len(each), pa.float64()),
                ], names=names)

    return rows.mapInArrow(project, schema)
