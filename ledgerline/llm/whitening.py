"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, x = floor(SCALE * c) + SHIFT, so that counts, sums and deviations are exact. The
covariance V is never formed: a pass over the rows gives V Q for a block Q of a few columns, each row centred before it is
multiplied, summed over the partitions: by Spark, and those of few tasks by the driver. Driver and tasks hold matrices
of (dimensions x block columns) only, however many rows there are.

1. A few steps of block-wise Lanczos passes bound the spectrum from below and above.
2. A Chebyshev recurrence over the passes damps everything in the unwanted interval, from the lower bound to the block's
   smallest Ritz value, and lets what lies above it grow.
3. QR, then Rayleigh-Ritz in the block; V Q of that step is the first product of the next filter.
4. The residuals |V u - e u| certify the components: the loop ends when those of all wanted ones are within a few units
   of double precision of the largest eigenvalue, or no longer fall at a level where rounding in a pass is all that is left.

The passes read a table that is written once, so a lost executor costs a pass's tasks, not the earlier ones.

A row is dropped if its vector is null, has a null or non-finite entry, or an entry beyond 2 ** 53 / SCALE, whose whole
number would not be exact. Vectors of another length than the commonest (of ties, the longest) are dropped as well,
and so are empty ones, which have no components. Repeated ids and null ids are rows as any other. With r dimensions of
positive variance only r components can be whitened; with no variance, or no rows, the result is empty. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the block, besides those wanted: the more, the wider the gap to what is damped.
GUARD = 16
#: Degree of the filter, passes that bound the spectrum, filters at most.
DEGREE, BOUND_STEPS, MOST_FILTERS = 12, 6, 40
#: Residuals, relative to the largest eigenvalue: certified below the first; below the second they may end by no longer falling.
CERTAIN, SETTLED = 4e-15, 1e-12
#: Tasks up to which the driver adds up a pass's matrices itself; those of more tasks are added up by Spark first.
FEW_TASKS = 64
#: An eigenvalue below this share of the largest is no variance but rounding.
FLOOR = 1e-12


def whole_numbers(vector: Column) -> Column:
    """A vector's entries as whole numbers; null where it can't be one."""
    limit = float(2**53 // SCALE)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > limit))
    x = F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return F.when(vector.isNotNull() & ~bad & (F.size(vector) > 0), x)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


class Fit:
    """The rows that are fitted, with their exact count and sums, and passes over them."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        self.n, self.sums, self.least, self.most = self._totals()
        self.mean = np.array([s / self.n for s in self.sums])  # of Python's whole numbers: rounded once
        self.passes = 0

    def _totals(self) -> tuple[int, list[int], list[int], list[int]]:
        d = self.d

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("x"), d)
                if not len(x):
                    continue
                small = int(np.abs(x).max()) * len(x) < 2**62
                sums = x.sum(0).tolist() if small else [sum(c.tolist()) for c in x.T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(d), pa.int32()), pa.array([str(s) for s in sums]), pa.array([len(x)] * d, pa.int64()), pa.array(x.min(0)), pa.array(x.max(0))],
                    names=["i", "s", "n", "least", "most"],
                )

        parts = self.rows.select("x").mapInArrow(totals, "i int, s string, n long, least long, most long")
        found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("parts")).collect()
        found = sorted(found, key=lambda r: r["i"])
        self.parts = found[0]["parts"]
        return int(found[0]["n"]), [int(r["s"]) for r in found], [r["least"] for r in found], [r["most"] for r in found]

    def _summed(self, made, width: int, height: int) -> np.ndarray:
        """The sum over all rows of made(centred rows), a matrix of height x width; one task gives one matrix, Spark adds them up."""
        d, mean = self.d, self.mean

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for b in batches:
                if b.num_rows:
                    total += made(_matrix(b.column("x"), d) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *[pa.array(c) for c in total.T]], names=["i", *[f"y{j}" for j in range(width)]])

        parts = self.rows.select("x").mapInArrow(part, "i int, " + ", ".join(f"y{j} double" for j in range(width)))
        if self.parts > FEW_TASKS:
            parts = parts.groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)])
        found, self.passes = np.array([tuple(r) for r in parts.collect()]), self.passes + 1
        total = np.zeros((height, width))
        np.add.at(total, found[:, 0].astype(int), found[:, 1:])
        return total

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, without V."""
        return self._summed(lambda x: x.T @ (x @ q), q.shape[1], self.d) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda x: (x * x).sum(0, keepdims=True).T, 1, self.d).sum() / self.n)

    def covariance(self, basis: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections on the columns of basis, centred once more by their own mean."""
        k = basis.shape[1]
        mean = self._summed(lambda x: (x @ basis).sum(0, keepdims=True), k, 1) / self.n
        return self._summed(lambda x: (y := x @ basis - mean).T @ y, k, k) / self.n


def spectrum_bounds(fit: Fit, q: np.ndarray, steps: int = BOUND_STEPS) -> tuple[float, float]:
    """Safe bounds below and above the eigenvalues: Lanczos from every column of q at once, each by itself.

    A Ritz value plus or minus its last coefficient bounds the end of the spectrum that its column sees.
    """
    d, m = q.shape
    steps = min(steps, d)
    v, before, beta = q / np.linalg.norm(q, axis=0), np.zeros_like(q), np.zeros(m)
    alphas, betas = [], []
    for _ in range(steps):
        w = fit.times(v) - beta * before
        alpha = (v * w).sum(0)
        w -= alpha * v
        beta = np.linalg.norm(w, axis=0)
        alphas.append(alpha)
        betas.append(beta.copy())
        before, v = v, w / np.where(beta > 0, beta, 1)
    low, high = np.inf, 0.0
    for j in range(m):
        t = np.diag([a[j] for a in alphas]) + np.diag([b[j] for b in betas[:-1]], 1) + np.diag([b[j] for b in betas[:-1]], -1)
        e, s = np.linalg.eigh(t)
        low, high = min(low, e[0] - betas[-1][j] * abs(s[-1, 0])), max(high, e[-1] + betas[-1][j] * abs(s[-1, -1]))
    return max(0.0, float(low)), float(high)


def chebyshev_filter(fit: Fit, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, high: float) -> np.ndarray:
    """Columns of q, the parts between low and cut damped: the scaled three-term recurrence, one pass a degree but the first."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (high - middle)
    old, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - sigma)
        old, now = now, (fit.times(now) - middle * now) * (2 * nxt / half) - (sigma * nxt) * old
        sigma = nxt
    return now


def _ritz(fit: Fit, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and V times the vectors."""
    q, _ = np.linalg.qr(q)
    q, _ = np.linalg.qr(q)
    vq = fit.times(q)
    h = q.T @ vq
    e, s = np.linalg.eigh((h + h.T) / 2)
    s = s[:, ::-1]
    return e[::-1], q @ s, vq @ s


def leading_components(fit: Fit, k: int = COMPONENTS, guard: int = GUARD, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals) of the k largest, fewer where the variance has fewer dimensions."""
    d = fit.d
    m = min(d, k + guard)
    q = np.random.default_rng(seed).standard_normal((d, m))
    low, high = spectrum_bounds(fit, q) if m < d else (0.0, 0.0)
    e, u, vu = _ritz(fit, q)
    last = np.inf
    for _ in range(MOST_FILTERS):
        high = max(high, e[0])
        want = min(k, int((e > FLOOR * max(e[0], 0)).sum()))
        worst = np.linalg.norm(vu - u * e, axis=0)[:want].max(initial=0.0)
        if m == d or worst <= CERTAIN * high or (worst <= SETTLED * high and worst > last / 2):
            break
        last = worst
        cut = max(e[-1], low + 1e-6 * (high - low))
        if cut >= high:
            break
        e, u, vu = _ritz(fit, chebyshev_filter(fit, u, vu, DEGREE, low, cut, high))
    if worst > SETTLED * max(high, 1e-300) and m < d:
        raise ValueError(f"components are not certified: residual {worst:g} of {high:g} after {fit.passes} passes")
    want = min(k, int((e > FLOOR * max(e[0], 0)).sum()))
    return e[:want], u[:, :want], np.linalg.norm(vu - u * e, axis=0)[:want]


def _deviation(x: np.ndarray, n: int, sums: list[int], spread: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for every row, exact; null beyond 64 bits."""
    if spread**2 * len(sums) < 2**63:
        y = x * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [f if f < 2**63 else None for f in found]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, residual) for every row and component."""
    kind = dict(vectors.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows = written(vectors.select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x")).filter("x is not null"), "whole-numbers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if lengths is None:
        return empty
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    fit = Fit(rows, d)
    e, u, residuals = leading_components(fit, k)
    if not len(e):
        return empty
    basis = u / np.sqrt(e)
    error = float(np.abs(fit.covariance(basis) - np.eye(len(e))).max())
    share, n, sums, mean = e / fit.trace(), fit.n, fit.sums, fit.mean
    spread = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(fit.least, fit.most, sums)) if max(map(abs, fit.least + fit.most)) * n < 2**62 else 2**64
    wanted, c = range(1, len(e) + 1), len(e)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d)
            w = (x - mean) @ basis
            take = pa.array(np.repeat(np.arange(len(x)), c))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(take), pa.array(np.tile(np.array(wanted, dtype=np.int32), len(x))), pa.array(np.full(len(x) * c, n)), pa.array(_deviation(x, n, sums, spread), pa.int64()).take(take),
                    pa.array(w.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * c, error)), pa.array(np.tile(residuals / e[0], len(x))),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)
