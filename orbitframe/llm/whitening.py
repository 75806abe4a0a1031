"""Whitening of embeddings by an eigendecomposition that grows row by row.

A task keeps the eigenvalues and vectors of the scatter of its rows. Rows come in blocks; a block is centred on its own mean and turned
by a QR into at most as many rows as there are dimensions, of the same scatter, and each of these, and the step between the means, is
a rank-one update: the roots of the secular equation are the new values, and close values or small components deflate. Spectra of tasks
are combined in a tree, again by rank-one updates, one per eigenpair. The result is a basis near the wanted one; a Rayleigh-Ritz step
over all rows makes it exact: the centred rows are projected on the basis, their products are summed in the cluster, and the small
matrix, almost diagonal, is solved on the driver.

Entries become long, floor(256 * entry); beyond the range of long they stop at its ends. Rows whose vector is null or holds a null, a
NaN or an infinity are dropped. Shorter vectors count as filled up with zeros. Copies count once in the fit. A component whose value
is 0 within rounding (fewer distinct rows than components, or constant ones) has null in `whitened`; without any variance `explained`
and `identity_error` are null as well. A `deviation` beyond the range of long is null. Null ids stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Rows of a block, per dimension, that are turned into one row per dimension.
BLOCK_PER_DIM = 16
#: Spectra that one task combines.
FAN_IN = 8
EPS = np.finfo(float).eps
LONG = 1 << 63


class Spectrum:
    """Number of rows, mean, and the rising eigenvalues and unit vectors (columns) of the scatter about the mean."""

    def __init__(self, dims: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, row: np.ndarray, weight: float) -> None:
        """values, vectors of the matrix plus weight * row row^T."""
        z = self.vectors.T @ row
        size = float(z @ z)
        rho = weight * size
        if rho <= 0:
            return
        z /= np.sqrt(size)
        slack = 8 * EPS * max(self.values[-1], rho)
        live = self.deflated(z, rho, slack)
        if len(live):
            roots, turn = secular(self.values[live], z[live], rho)
            self.vectors[:, live] = self.vectors[:, live] @ turn
            self.values[live] = roots
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = np.maximum(self.values[order], 0), self.vectors[:, order]

    def deflated(self, z: np.ndarray, rho: float, slack: float) -> np.ndarray:
        """The places that take part in the update. Of two close values one is turned out of the row by a rotation of their vectors."""
        live = np.flatnonzero(rho * np.abs(z) > slack)
        d = self.values
        gap, one, two = np.diff(d[live]), z[live[:-1]], z[live[1:]]
        if not (gap * np.abs(one * two) <= slack * (one**2 + two**2)).any():
            return live
        out, before = [], -1
        for j in live.tolist():
            if before >= 0:
                tau = np.hypot(z[before], z[j])
                c, s = z[j] / tau, -z[before] / tau
                if abs((d[j] - d[before]) * c * s) <= slack:
                    z[j], z[before] = tau, 0.0
                    a, b = self.vectors[:, before].copy(), self.vectors[:, j].copy()
                    self.vectors[:, before], self.vectors[:, j] = c * a + s * b, c * b - s * a
                    d[before], d[j] = d[before] * c * c + d[j] * s * s, d[before] * s * s + d[j] * c * c
                    out.pop()
            out.append(j)
            before = j
        return np.array(out)

    def move(self, n: int, mean: np.ndarray) -> None:
        """Take n more rows with this mean into the count and the mean; their scatter about it is added besides."""
        if self.n:
            self.add(mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add_rows(self, rows: np.ndarray) -> None:
        """A block of rows: centred, turned into at most one row per dimension of the same scatter, added one by one."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        for row in np.linalg.qr(centred, mode="r") if len(rows) > 1 else centred:
            self.add(row, 1.0)
        self.move(len(rows), mean)

    def add_spectrum(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(vector, value)
        self.move(other.n, other.mean)


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors (columns) of diag(d) + rho z z^T for rising distinct d, z without zeros and of norm 1.

    Root i of 1 + rho * sum z_j^2 / (d_j - x) lies between d_i and d_i+1. It is sought as a distance from the nearer of the two, so
    that differences keep their digits: the terms of the poles on each side are replaced by one pole each, matched in value and
    slope, and the quadratic in between is solved; a step out of the bracket is replaced by halving. The vectors come from the row
    that has the found roots exactly, which keeps them orthogonal."""
    k = len(d)
    if k == 1:
        return d + rho * z**2, np.ones((1, 1))
    w, i = rho * z**2, np.arange(k)
    width = np.append(np.diff(d), w.sum())
    below = i[None, :] <= i[:, None]  # poles on the left of root i, by row
    middle = d + width / 2
    right = (1 + (w / (d[None, :] - middle[:, None])).sum(axis=1) < 0) & (i < k - 1)
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    poles = d[None, :] - origin[:, None]
    lo, hi = np.where(right, -width / 2, 0.0), np.where(right, 0.0, np.where(i < k - 1, width / 2, width))
    left_pole, right_pole = np.where(right, -width, 0.0), np.where(right, 0.0, width)
    x = (lo + hi) / 2
    for _ in range(60):
        gap = poles - x[:, None]
        term = w / gap
        slope = term / gap
        psi, phi = np.where(below, term, 0).sum(axis=1), np.where(below, 0, term).sum(axis=1)
        f = 1 + psi + phi
        done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(psi) + np.abs(phi))
        lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
        if done.all() or ((hi - lo) <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))).all():
            break
        dpsi, dphi = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
        one, two = left_pole - x, right_pole - x
        q, s = dpsi * one**2, np.where(i < k - 1, dphi * two**2, 0)
        a = 1 + psi - dpsi * one + np.where(i < k - 1, phi - dphi * two, 0)
        # a + q / (one - t) + s / (two - t) = 0 for the step t
        with np.errstate(all="ignore"):
            b, c = a * (one + two) + q + s, a * one * two + q * two + s * one
            root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
            t = np.where(b > 0, 2 * c / (b + root), (b - root) / (2 * a))
            t = np.where(i < k - 1, t, one + q / a)
            new = x + t
            other = x + np.where(b > 0, (b + root) / (2 * a), 2 * c / (b - root))
        new = np.where((new > lo) & (new < hi), new, np.where((other > lo) & (other < hi) & (i < k - 1), other, (lo + hi) / 2))
        x = np.where(done, x, new)
    gap = poles - x[:, None]  # d_j - root_i
    # the row whose roots these are: z_j^2 = prod_i (root_i - d_j) / prod_(i != j) (d_i - d_j), each root set against a neighbour
    diff = d[None, :] - d[:, None]  # [i, j]: d_j - d_i
    np.fill_diagonal(diff, 1.0)
    ratio = gap / diff
    np.fill_diagonal(ratio, np.diagonal(gap))
    z = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z)
    vectors = z[:, None] / gap.T
    return origin + x, vectors / np.linalg.norm(vectors, axis=0)


def quantised(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x of the rows with a vector of finite entries, and the number of dimensions."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    entries = F.transform("embedding", lambda v: v.cast("double"))
    rows = rows.select("vec_id", entries.alias("e")).filter(F.col("e").isNotNull() & ~F.exists("e", bad))
    dims = rows.agg(F.max(F.size("e"))).first()[0] or 0
    x = F.transform("e", lambda v: F.floor(v * SCALE))
    x = F.when(F.size("e") == dims, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("e"))))
    return rows.select("vec_id", x.alias("x")), dims


def matrices(batches: Iterator[pa.RecordBatch], dims: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, b.column(column).flatten().to_numpy().reshape(-1, dims)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: halves of 32 bits are summed by task, then as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in matrices(batches, dims):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    found = fit.mapInArrow(run, "dim long, n long, high long, low long").groupBy("dim").agg(F.sum("n"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")])
    rows = sorted(found.collect())
    return (rows[0][1] if rows else 0), [(int(r[2]) << 32) + int(r[3]) for r in rows]


SPECTRUM = "place long, n long, mean array<double>, eigenvalues array<double>, vectors array<double>"


def _packed(place: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in (s.mean, s.values, s.vectors)]
    return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([s.n]), *lists], ["place", "n", "mean", "eigenvalues", "vectors"])


def _unpacked(n: int, mean: list, values: list, vectors: list) -> Spectrum:
    out = Spectrum(len(mean))
    out.n, out.mean, out.values, out.vectors = n, np.array(mean), np.array(values), np.array(vectors).reshape(len(mean), -1)
    return out


def spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all rows: one per task, combined FAN_IN at a time until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, most = Spectrum(dims), BLOCK_PER_DIM * dims
        for _, x in matrices(batches, dims):
            for lo in range(0, len(x), most):
                own.add_rows(x[lo : lo + most].astype(float))
        if own.n:
            yield _packed(TaskContext.get().partitionId(), own)

    def combined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        for _, *parts in rows:
            if own is None:
                own = _unpacked(*parts)
            else:
                own.add_spectrum(_unpacked(*parts))
        yield _packed(key[0].as_py(), own)

    found = stored(fit.mapInArrow(run, SPECTRUM))
    last = found.agg(F.max("place")).first()[0]
    while last:
        found = found.withColumn("place", F.floor(F.col("place") / FAN_IN)).groupBy("place").applyInArrow(combined, SPECTRUM)
        last //= FAN_IN
    return _unpacked(*found.first()[1:])


def products(fit: DataFrame, dims: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over all rows of y y^T, y being the row, centred, in the given basis."""
    wide = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((wide, wide))
        for _, x in matrices(batches, dims):
            y = (x - mean) @ basis
            own += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * wide)), pa.array(own.ravel())], ["place", "part"])

    out = np.zeros(wide * wide)
    for place, total in fit.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part")).collect():
        out[place] = total
    return out.reshape(wide, wide)


class Fit:
    """n, the sums, the mean, the falling eigenvalues of the covariance, and unit eigenvectors (columns), the largest entry of each
    above zero; `fit` is the table of distinct x."""

    def __init__(self, x: DataFrame, dims: int):
        self.dims, self.fit = dims, stored(x.select("x").distinct())
        self.n, self.sums = totals(self.fit, dims)
        if not self.n:
            return
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        basis, _ = np.linalg.qr(spectrum(self.fit, dims).vectors)
        values, turn = np.linalg.eigh(products(self.fit, dims, self.mean, basis) / self.n)
        self.values, vectors = np.maximum(values[::-1], 0), basis @ turn[:, ::-1]
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1, 1)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x, dims = quantised(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit(x, dims) if dims else None
    if fit is None or not fit.n:
        return rows.sparkSession.createDataFrame([], schema)
    k, n, sums, mean = min(components, dims), fit.n, fit.sums, fit.mean
    values, trace = fit.values[:k], float(fit.values.sum())
    there = values > dims * EPS * 64 * trace
    axes = np.where(there, fit.vectors[:, :k] / np.sqrt(np.where(there, values, 1)), 0)
    off = np.abs(products(fit.fit, dims, mean, axes[:, there]) / n - np.eye(there.sum())).max(initial=0) if there.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
        if most * most * dims < LONG:
            return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < LONG else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches, dims, 1):
            m, y = len(x), (x - mean) @ axes
            rows = np.repeat(np.arange(m), k)
            tiled = lambda v, t: pa.array(list(v) * m, t)
            columns = [b.column(0).take(pa.array(rows)), tiled(range(1, k + 1), pa.int32()), pa.array(np.full(m * k, n)), pa.array(deviations(x), pa.int64()).take(pa.array(rows)), pa.array(y.ravel(), mask=np.tile(~there, m)), tiled(explained, pa.float64()), pa.array([off] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
