"""Embedding whitening: TSQR of centred rows, then one-sided Jacobi rotations of its triangle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.vectors import lists, matrix, release, stored, whole_numbers
from quorumlab.session import cut

#: A component c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows that a task folds into its triangle at once, and triangles that one task stacks.
BLOCK_ROWS, FAN = 4096, 16
#: Standard deviations below this share of the greatest are rounding, not directions.
NEGLIGIBLE = 1e-12


@dataclass
class Whitening:
    """n and sums of the fit list; unit components (columns) by falling variance; their standard deviations and shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums as exact integers, and that over n."""
        whole = self.n * x - self.sums
        return whole, whole / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / self.deviations


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(s, v): singular values of r, falling, and its right singular vectors as columns.

    Plane rotations make the columns of r orthogonal, pair by pair; v accumulates the rotations, the columns'
    lengths are the singular values, small ones included to high relative accuracy. A round rotates pairs
    that share no column, all at once; a sweep is as many rounds as meet every pair.
    """
    d = r.shape[1]
    u = np.zeros((max(r.shape[0], 1), d + d % 2))  # an odd number of columns gets a zero one, which never turns
    u[: r.shape[0], :d] = r
    v = np.eye(d + d % 2)
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(ring) - 1, 1)):
            i, j = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            a, b, c = (u[:, i] ** 2).sum(0), (u[:, j] ** 2).sum(0), (u[:, i] * u[:, j]).sum(0)
            skew = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if skew.any():
                turned, i, j = True, i[skew], j[skew]
                with np.errstate(over="ignore"):  # a turn of next to nothing
                    zeta = (b[skew] - a[skew]) / (2 * c[skew])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                for m in (u, v):
                    m[:, i], m[:, j] = cos * m[:, i] - sin * m[:, j], sin * m[:, i] + cos * m[:, j]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    s = np.sqrt((u**2).sum(0))[:d]
    order = np.argsort(-s, kind="stable")
    return s[order], v[:d, :d][:, order]


def _stack(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def integer_vectors(rows: DataFrame, column: str) -> DataFrame:
    """x array<long> of each usable vector."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = whole_numbers(batch.column(0), SCALE)
            yield pa.RecordBatch.from_arrays([lists(x + OFFSET)], ["x"])

    return rows.select(column).mapInArrow(convert, "x array<long>")


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors, and the sum of each dimension: a partial sum for each task, added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([lists(np.array([[n, *total]], np.int64))], ["s"])

    parts = fit.mapInArrow(add, "s array<long>").select(F.posexplode("s").alias("at", "s"))
    found = dict(map(tuple, parts.groupBy("at").agg(F.sum("s")).collect()))  # a row for each dimension
    return found.get(0, 0), np.array([found[i] for i in range(1, len(found))], np.int64)


def _triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows: each task's blocks, then the tasks' triangles, FAN at a time until one is left."""
    d = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column(0).slice(at, BLOCK_ROWS))
                r = _stack(r, (n * x - sums) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), lists(r.reshape(1, -1))], ["part", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for one in table.column("r").to_pylist():
            r = _stack(r, np.array(one).reshape(-1, d))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "r": lists(r.reshape(1, -1))})

    found = cut(fit.mapInArrow(fold, "part int, r array<double>"))
    while found.agg(F.max("part").alias("m")).first()["m"] > 0:
        found = cut(found.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, "part int, r array<double>"))
    return np.array(found.first()["r"]).reshape(-1, d)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; sums are of centred values, so they lose nothing."""
    k = model.components.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                w = model.project(model.centred(matrix(batch.column(0).slice(at, BLOCK_ROWS)))[1])
                total += np.concatenate([w.sum(0), (w.T @ w).reshape(-1)])
        yield pa.RecordBatch.from_arrays([lists(total[None])], ["s"])

    parts = fit.mapInArrow(add, "s array<double>").select(F.posexplode("s").alias("at", "s"))
    found = dict(map(tuple, parts.groupBy("at").agg(F.sum("s")).collect()))  # k + k * k rows
    flat = np.array([found[i] for i in range(k + k * k)]) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, column: str = "embedding", most: int = 16) -> Whitening | None:
    """The principal components of the distinct integer vectors, up to `most` of them; None without a usable vector.

    Each distinct vector counts once, so copies don't weigh. The list is written once to the shared folder, as
    three passes read it, and removed again. Only a triangle, sums and k * k numbers reach the driver: their size is the
    dimension's. Directions without variance are left out. Null and empty vectors and those with null or
    non-finite components take no part; vectors of several lengths are an error.
    """
    fit, path = stored(integer_vectors(rows, column).distinct(), "whitening")
    try:
        n, sums = _sums(fit)
        if not n:
            return None
        s, v = one_sided_jacobi(_triangle(fit, n, sums))
        kept = np.flatnonzero(s > NEGLIGIBLE * max(s[0], 1e-300) if len(s) else [])[:most]
        share = s**2 / (s**2).sum() if len(kept) else s
        model = Whitening(n, sums, v[:, kept], s[kept] / np.sqrt(n), share[kept])
        model.identity_error = _identity_error(fit, model) if len(kept) else 0.0
        return model
    finally:
        release(rows, path)


def _exact_norms(whole: np.ndarray) -> pa.Array:
    """Sums of squares of each row as long; null where they don't fit one."""
    most = int(np.abs(whole).max()) if whole.size else 0
    if most * most * max(whole.shape[1], 1) < 1 << 63:
        return pa.array((whole**2).sum(1))
    exact = [sum(int(y) ** 2 for y in row) for row in whole]
    return pa.array([y if y < 1 << 63 else None for y in exact], pa.int64())


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None, row_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    deviation is the exact sum over dimensions of (n * x - sums) squared, null where it doesn't fit a long. Rows repeat as
    they come, also with null ids; other columns are ignored; unusable vectors give no row, nor does an empty table or a model
    without components.
    """
    kind = dict(rows.dtypes)[row_id]
    if model is None or not model.components.size:
        return rows.sparkSession.createDataFrame([], f"`{row_id}` {kind}, {WHITENED}")
    k = model.components.shape[1]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x, kept = whole_numbers(some.column(1), SCALE)
                whole, centred = model.centred(x + OFFSET)
                each = pa.array(np.repeat(np.arange(len(kept)), k))
                cols = [
                    some.column(0).take(pa.array(kept)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))), pa.array(np.full(len(each), model.n, np.int64)),
                    _exact_norms(whole).take(each), pa.array(model.project(centred).reshape(-1)), pa.array(np.tile(model.explained, len(kept))), pa.array(np.full(len(each), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, [row_id, *[c.split()[0] for c in WHITENED.split(", ")]])

    return rows.select(row_id, column).mapInArrow(convert, f"`{row_id}` {kind}, {WHITENED}")
