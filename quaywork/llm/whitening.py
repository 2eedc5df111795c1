"""Whitening of embeddings by their leading principal components.

Counts and sums, the centred covariance and the check of the result are sums over tasks; only they come to the driver
(a square of the dimension, never a row of data). The covariance is brought to tridiagonal form by Householder
reflections, its leading eigenvalues are found by bisection on Sturm counts, their vectors by inverse iteration, in
which vectors of close eigenvalues are kept orthogonal. The components are broadcast and every row is projected in
place, without a shuffle.

Rows whose vector is null or holds null or non-finite entries are dropped, as are vectors of another length than most
have (ties: the longer; an empty vector has no entries to whiten). Equal rows count as often as they occur. An empty
table gives no rows. A component has to hold variance: where the vectors span fewer than ``k`` dimensions there are as
many components, and none at all for one vector or for equal ones. Other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become whole numbers: floor(SCALE * c) + OFFSET, of EDGE at most on either side, so that differences are longs.
SCALE, OFFSET, EDGE = 1024.0, 100_000, float(1 << 61)
LANES = 32


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that remain, their lengths, their entries as whole numbers in one row after another)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    size = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)[rows]
    flat = column.drop_null().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN here
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(size)
    good = (bad[ends] == bad[ends - size]) & (size > 0)
    flat = flat[np.repeat(good, size)]
    whole = np.clip(np.floor(np.clip(flat, -EDGE, EDGE) * SCALE), -EDGE, EDGE).astype(np.int64) + OFFSET
    return rows[good], size[good], whole


def _of_length(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    rows, size, whole = _whole(column)
    fits = size == d
    return rows[fits], whole[np.repeat(fits, size)].reshape(-1, d)


class Centre:
    """The number of vectors and their exact sums; the mean of a dimension is ``base`` + ``rest`` / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: the whole part is taken off exactly."""
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n*x - S)^2 of each row, null where it has more than 38 digits."""
        y = x - self.base
        sure = ((self.n * y.astype(np.float64) - self.rest) ** 2).sum(1) < 9e18
        t = self.n * y[sure] - self.rest
        out = np.empty(len(x), object)
        out[sure] = (t * t).sum(1)
        if sure.all():
            return pa.array(out.astype(np.int64)).cast(pa.decimal128(38, 0))
        for k in np.flatnonzero(~sure):
            v = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(y[k], self.rest, strict=True))
            out[k] = v if v < 10**38 else None
        from decimal import Decimal

        return pa.array([None if v is None else Decimal(int(v)) for v in out], pa.decimal128(38, 0))


def _sum_rows(batches):
    """By length of vector and place: vectors and sums, the sums in two halves so that none overflows."""
    found: dict[int, list] = {}
    for batch in batches:
        _, size, whole = _whole(batch.column(0))
        for d in np.unique(size).tolist():
            x = whole[np.repeat(size == d, size)].reshape(-1, d)
            own = found.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            own[0] += len(x)
            own[1] += (x >> 32).sum(0)
            own[2] += (x & 0xFFFFFFFF).sum(0)
    for d, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)], names=["d", "j", "n", "high", "low"])


def centre(vectors: DataFrame, vec_col: str = "embedding") -> Centre | None:
    """Number and sums of the vectors of the most frequent length; a row for each place comes to the driver."""
    parts = vectors.select(vec_col).mapInArrow(_sum_rows, "d int, j int, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    by_place = parts.groupBy("d", "j").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect()
    if not by_place:
        return None
    d = max((r["n"], r["d"]) for r in by_place)[1]
    own = sorted((r for r in by_place if r["d"] == d), key=lambda r: r["j"])
    return Centre(own[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in own])


def _scatter_rows(c):
    def run(batches):
        total, lane = np.zeros((len(c.value.base),) * 2), None
        for batch in batches:
            _, x = _of_length(batch.column(0), len(total))
            y = c.value.centred(x)
            total += y.T @ y
            lane = 1
        if lane is None:
            return
        from pyspark import TaskContext

        d = len(total)
        lane = (TaskContext.get().partitionId() if TaskContext.get() else 0) % LANES
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype=np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, lane, np.int32)), pa.array(np.arange(d, dtype=np.int32)), rows], names=["lane", "i", "values"])

    return run


def _add_lists(*keys: str):
    def run(table: pa.Table) -> pa.Table:
        lists = table.column("values").combine_chunks()
        total = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).sum(0)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return run


def covariance(vectors: DataFrame, c: Centre, vec_col: str = "embedding") -> np.ndarray:
    """The covariance (divisor n) about the exact mean: each task's products are added up row by row, first within
    lanes of tasks, then over them."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)
    parts = vectors.select(vec_col).mapInArrow(_scatter_rows(shared), "lane int, i int, values array<double>")
    lanes = parts.groupBy("lane", "i").applyInArrow(_add_lists("i"), "i int, values array<double>")
    rows = lanes.groupBy("i").applyInArrow(_add_lists("i"), "i int, values array<double>").collect()  # a row for each dimension
    v = np.array([r["values"] for r in sorted(rows, key=lambda r: r["i"])]) / c.n
    return (v + v.T) / 2


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix (Householder)."""
    a, n, mirrors = v.copy(), len(v), []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        if not np.abs(u[1:]).max() > 0:
            mirrors.append(np.zeros(len(u)))
            continue
        u /= np.abs(u).max()
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        u /= np.sqrt(u @ u)
        own = a[k + 1 :, k]
        own -= 2 * u * (u @ own)
        a[k, k + 1 :] = own
        p = 2 * (a[k + 1 :, k + 1 :] @ u)
        w = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        mirrors.append(u)
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def _sturm(diagonal: np.ndarray, square: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``."""
    q = diagonal[0] - x
    n = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = diagonal[k] - x - square[k - 1] / np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval holds no number within."""
    n, square = len(diagonal), off * off
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = 1e-12 * max(1e-300, np.abs([lo[0], hi[0]]).max())
    lo, hi, tiny = lo - pad, hi + pad, 1e-290
    below = n - 1 - np.arange(k)  # so many lie below the largest, the next, ...
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        under = _sturm(diagonal, square, mid, tiny) <= below
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo + (hi - lo) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, x: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - x) y = b by elimination with row exchanges; a pivot of nothing counts as ``tiny``."""
    n = len(diagonal)
    main, upper, over, y = diagonal - x, np.append(off, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        low = off[k]
        if abs(main[k]) >= abs(low):
            if abs(main[k]) < tiny:
                main[k] = tiny
            f = low / main[k]
            main[k + 1] -= f * upper[k]
            y[k + 1] -= f * y[k]
        else:
            f = main[k] / low
            main[k], upper[k], main[k + 1] = low, main[k + 1], upper[k] - f * main[k + 1]
            if k < n - 2:
                over[k], upper[k + 1] = upper[k + 1], -f * upper[k + 1]
            y[k], y[k + 1] = y[k + 1], y[k] - f * y[k + 1]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for k in range(n - 1, -1, -1):
        y[k] = (y[k] - (upper[k] * y[k + 1] if k < n - 1 else 0) - (over[k] * y[k + 2] if k < n - 2 else 0)) / main[k]
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """A column for each of ``values`` (falling), by inverse iteration; in every step a vector is kept orthogonal to those
    before it whose values are linked to its own by gaps of a thousandth of the norm at most."""
    n = len(diagonal)
    norm = max(1e-300, np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0))
    rng, out, first = np.random.default_rng(1), np.zeros((n, len(values))), 0
    for k, x in enumerate(values):
        if k and values[k - 1] - x > 1e-3 * norm:
            first = k
        y = rng.standard_normal(n)
        for _ in range(steps):
            y = _solve(diagonal, off, x, y / np.sqrt(y @ y), np.finfo(float).eps * norm)
            y /= np.abs(y).max()
            for j in (*range(first, k), *range(first, k)):
                y = y - (out[:, j] @ y) * out[:, j]
        out[:, k] = y / np.sqrt(y @ y)
    return out


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, with unit vectors as columns, each with its greatest
    entry positive. Those without variance are left out."""
    scale = np.abs(v).max() if v.size else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    d, off, mirrors = tridiagonal(v / scale)
    values = largest_eigenvalues(d, off, min(k, len(v)))
    values = values[values > 8 * len(v) * np.finfo(float).eps * d.sum()]  # what is less is rounding
    u = eigenvectors(d, off, values)
    for j in range(len(mirrors) - 1, -1, -1):
        m = mirrors[j]
        u[j + 1 :] -= 2 * np.outer(m, m @ u[j + 1 :])
    u /= np.sqrt((u * u).sum(0))
    values = (u * (v @ u)).sum(0)  # the quotient of each vector: as exact as the vector's square
    order = np.argsort(-values, kind="stable")
    values, u = values[order], u[:, order]
    return values, u * np.where(u[np.abs(u).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)


def _check_rows(c, project):
    def run(batches):
        n, k = 0, project.value.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = _of_length(batch.column(0), len(c.value.base))
            w = c.value.centred(x) @ project.value
            n, first, second = n + len(w), first + w.sum(0), second + w.T @ w
        if n:
            values = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    return run


def identity_error(vectors: DataFrame, c: Centre, project: np.ndarray, vec_col: str = "embedding") -> float:
    """The largest entry by which the covariance of all whitened rows differs from the identity."""
    sc, k = vectors.sparkSession.sparkContext, project.shape[1]
    parts = vectors.select(vec_col).mapInArrow(_check_rows(sc.broadcast(c), sc.broadcast(project)), "place int, value double")
    total = np.zeros(k + k * k)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # k + k * k rows
        total[r["place"]] = r["value"]
    mean = total[:k] / c.n
    return float(np.abs(total[k:].reshape(k, k) / c.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each remaining vector on each of the ``k``
    leading components, numbered from 1 by falling eigenvalue.

    ``deviation`` is the exact sum over dimensions of (n*x - S)^2 (null beyond 38 digits), ``whitened`` the centred vector's
    projection over the eigenvalue's root, ``explained`` the eigenvalue's share of the variance, and ``identity_error`` one
    value, measured on all rows.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    c = centre(vectors, vec_col)
    v = covariance(vectors, c, vec_col) if c else np.zeros((0, 0))
    values, components = leading(v, k)
    if not len(values):
        return spark.createDataFrame([], schema)
    project = components / np.sqrt(values)
    error = identity_error(vectors, c, project, vec_col)
    shared, all_of, explained = spark.sparkContext.broadcast(project), spark.sparkContext.broadcast(c), values / np.trace(v)

    def run(batches):
        for batch in batches:
            rows, x = _of_length(batch.column(1), len(all_of.value.base))
            m = shared.value.shape[1]
            each = pa.array(np.repeat(np.arange(len(rows)), m))
            ids = batch.column(0).take(pa.array(rows))
            w = all_of.value.centred(x) @ shared.value
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), all_of.value.n, np.int64)), all_of.value.deviation(x).take(each),
                pa.array(w.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error)),
            ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_col, vec_col).mapInArrow(run, schema)


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns; ``deviation`` as a long is null where it does not fit, ``deviation_exact`` has it in full."""
    w = whiten(vectors)
    return w.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
