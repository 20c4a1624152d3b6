"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers, x = floor(1024 c) + 100000, so sums and deviations are
exact. Three passes over the vectors are partial sums per task that Spark adds
up: counts and sums, the centred scatter, and the covariance of what was
whitened; a fourth gives the rows. Only the scatter, d x d numbers for vectors of length d, comes
to the driver (``MOST_DIMENSIONS``). There a pivoted Cholesky factor G of it (G G' = scatter)
is turned by Jacobi rotations of its columns until they are orthogonal: squared
column norms are eigenvalues, normalised columns the components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Longest vectors: the scatter of these is 128 MB.
MOST_DIMENSIONS = 4096
#: A pivot below this share of the largest one ends the factor: what is left is rounding.
RANK_SHARE = 1e-13


def integers(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x rows) for each vector length in a batch, or for one length; vectors that are null, empty, or hold a null, a non-finite entry or one beyond a long's range are left out."""
    column = batch.column("vector")
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE) + SHIFT
        bad = ~(np.abs(scaled) < 2.0**62)
    before = np.concatenate([[0], np.cumsum(bad)])
    sizes = np.diff(offsets)
    good = (before[offsets[1:]] == before[offsets[:-1]]) & (sizes > 0)
    if column.null_count:
        good &= np.asarray(column.is_valid())
    for d in np.unique(sizes[good]) if length is None else [length]:
        rows = np.flatnonzero(good & (sizes == d))
        if len(rows):
            at = offsets[rows][:, None] + np.arange(d)
            yield rows, np.floor(values[at] * SCALE).astype(np.int64) + SHIFT


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, exact sums per dimension) of the vectors of the commonest length, the longer one on a tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: Counter[int] = Counter()
        high: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in integers(batch):
                d = x.shape[1]
                many[d] += len(rows)
                high[d] = high.get(d, 0) + (x >> 32).sum(0)
                low[d] = low.get(d, 0) + (x & 0xFFFFFFFF).sum(0)
        for d, n in many.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), pa.array(np.r_[0, high[d]]), pa.array(np.r_[n, low[d]])], names=["d", "i", "high", "low"])

    parts = vectors.select("vector").mapInArrow(run, "d long, i long, high long, low long")
    totals = parts.groupBy("d", "i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    best = totals.where("i = -1").orderBy(F.desc("low"), F.desc("d")).limit(1).collect()
    if not best:
        return 0, []
    d = best[0].d
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries: the scatter of more than {MOST_DIMENSIONS} does not fit the driver")
    cells = {r.i: (r.high << 32) + r.low for r in totals.where(F.col("d") == int(d)).collect()}  # d + 1 rows
    return cells[-1], [cells[i] for i in range(d)]


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: machine integers where they can hold it, else Python's."""
    if n * (float(np.abs(x).max()) + 1) < 2.0**61 and max(map(abs, total)) < 2**61:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def scatter(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Sum of the outer products of centred vectors."""
    d = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d))
        for batch in batches:
            for _, x in integers(batch, d):
                c = (deviations(x, n, total) / n).astype(np.float64)
                out += c.T @ c
        if out.any():
            flat = pa.ListArray.from_arrays(pa.array(np.arange(d + 1) * d, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), flat], names=["i", "cells"])

    parts = vectors.select("vector").mapInArrow(run, "i long, cells array<double>")
    cells = parts.select("i", F.posexplode("cells").alias("j", "v")).where("j <= i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in cells.collect():  # d (d + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G (d x rank) with G G' = ``a``: lower triangular but for the order of rows, the largest remaining pivot first."""
    d = len(a)
    rest, g = np.diag(a).copy(), np.zeros((d, d))
    first = rest.max(initial=0.0)
    for k in range(d):
        p = int(rest.argmax())
        if not rest[p] > RANK_SHARE * first:
            return g[:, :k]
        column = a[:, p] - g[:, :k] @ g[p, :k]
        if not column[p] > 0:
            return g[:, :k]
        g[:, k] = column / np.sqrt(column[p])
        rest = np.where(rest == -np.inf, -np.inf, rest - g[:, k] ** 2)
        rest[p] = -np.inf
        g[np.isneginf(rest) & (np.arange(d) != p), k] = 0.0  # rows of earlier pivots are eliminated
    return g


def one_sided_jacobi(g: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit components as columns) of G G', falling: columns are rotated in pairs, each round half of all columns with the other half, until all are orthogonal."""
    g = g.copy()
    r = g.shape[1]
    seats = np.arange(r + r % 2)  # with an odd number one column sits out
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            play = (p < r) & (q < r)
            p, q = p[play], q[play]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-17
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, p], g[:, q] = cos * g[:, p] - sin * g[:, q], sin * g[:, p] + cos * g[:, q]
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
        if worst < 1e-15:
            break
    norms = np.sqrt((g**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def whiten(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) for each fit vector and component.

    The fit list is every vector without a null or non-finite entry. Vectors
    whose length is not the commonest one (the longer one on a tie), and those
    with an entry that has no x in a long's range, are left out like null ones.
    Repeated rows count as often as they stand there, a null vec_id stays null.
    Components without spread (eigenvalue zero) are left out, so a single
    vector, equal vectors and an empty table give no rows. Other columns are
    ignored, whatever their names. ``identity_error`` is measured over all
    whitened values, not derived from the factor. A deviation of more than 38
    digits is an error.
    """
    spark = table.sparkSession
    kind = table.schema[vec_id].dataType.simpleString()
    form = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    vectors = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    n, total = sums(vectors)
    values, basis = one_sided_jacobi(pivoted_cholesky(s := scatter(vectors, n, total))) if n else (np.zeros(0), np.zeros((0, 0)))
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], form + ", identity_error double")
    d, explained = len(total), values[:k] / np.trace(s)
    project = basis[:, :k] / np.sqrt(values[:k] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch, d):
                dev = deviations(x, n, total)
                exact = dev.dtype != object and float(np.abs(dev).max()) ** 2 * d < 2.0**62
                squares = (dev * dev).sum(1) if exact else [sum(v * v for v in r) for r in dev.tolist()]
                white = (dev / n).astype(np.float64) @ project
                ids = batch.column("vec_id").take(pa.array(rows))
                apart = pa.array([int(v) for v in squares], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                made = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(len(rows) * k, n)), apart.take(each), pa.array(white.ravel()), pa.array(np.tile(explained, len(rows)))]
                yield pa.RecordBatch.from_arrays(made, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, form).withColumn("identity_error", F.lit(identity_error(vectors, n, total, project)))


def identity_error(vectors: DataFrame, n: int, total: list[int], project: np.ndarray) -> float:
    """Largest absolute entry of the projected fit vectors' covariance minus the identity; means are taken off, though they are zero but for rounding."""
    d, k = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in integers(batch, d):
                w = (deviations(x, n, total) / n).astype(np.float64) @ project
                out += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["cell", "v"])

    parts = vectors.select("vector").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros((k + 1) * k)
    for r in parts.collect():  # (k + 1) k rows
        out[r.cell] = r.v
    out = out.reshape(k + 1, k) / n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())
