"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Components c become integers x = floor(64 c) + 1000000. Over the distinct x-vectors
of one length, the fit list, tasks add up exact integer sums, then the products of
x less its rounded mean: integers again, so that the scatter about the mean is
exact and doesn't depend on how rows are dealt. Its pivoted Cholesky factor L
(scatter = P L L' P') stays on the driver, as do the rotations that make L's columns
orthogonal: their squared lengths are the scatter's eigenvalues, the columns made
unit its components. The driver holds width x width numbers, whatever the rows.
Tasks project all rows, and the fit list once more for the covariance of what came out.

Rows whose vector is null, empty, or holds a null or a non-finite entry are left
out. A null or repeated id is an id like others. Each length of vector is a fit of
its own; more than ``MOST_WIDTHS`` lengths are an error. Repeated vectors count once in the
fit and give each their rows. Components of eigenvalue 0 (up to rounding) have no
whitened value and no rows: none at all where all vectors are equal. Equal
eigenvalues' components are any orthogonal set of their space. An empty table gives
no rows; other columns aren't read. An entry of 2**56 or more, or a deviation that is
no long, is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import written

SCALE, OFFSET = 64.0, 1_000_000
#: Lengths of vectors that are fitted in one call.
MOST_WIDTHS = 64
#: Columns are orthogonal when the cosine of no two is larger.
COSINE = 1e-15
MOST_SWEEPS = 60
EXACT = 2**53

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vector: str) -> Column:
    """floor(64 c) + 1000000 of each entry as a long; null where the vector takes no part."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < math.inf)) & (F.size(v) > 0)
    small = F.forall(v, lambda c: F.abs(c.cast("double")) < 2.0**56)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return F.when(fine, F.when(small, x).otherwise(F.raise_error(F.lit("a vector's entry is too large to be scaled")).cast("array<bigint>")))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as a matrix) of a batch's vectors, by length."""
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        places = np.flatnonzero(sizes == width)
        yield places, flat[starts[places][:, None] + np.arange(width)]


def _sums(batches: Iterator[pa.RecordBatch], total) -> Iterator[pa.RecordBatch]:
    """A task's exact sums: (width, place, value) rows of what ``total`` (width, matrix) gives for each batch, added up as Python integers."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            t = total(x.shape[1], x)
            found[x.shape[1]] = found[x.shape[1]] + t if x.shape[1] in found else t
    for width, values in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values), width, np.int32)), pa.array(np.arange(len(values), dtype=np.int64)), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["width", "place", "value"]
        )


def _added(rows: DataFrame, total) -> dict[int, list[int]]:
    """The sums of all tasks, by width."""
    out: dict[int, dict[int, int]] = {}
    sums = rows.select("x").mapInArrow(lambda b: _sums(b, total), "width int, place long, value decimal(38,0)").groupBy("width", "place").agg(F.sum("value").alias("value")).toArrow()
    for width, place, value in zip(*(sums[c].to_pylist() for c in ("width", "place", "value"))):
        out.setdefault(width, {})[place] = int(value)
    return {width: [at[i] for i in range(len(at))] for width, at in out.items()}


def _count_and_sums(width: int, x: np.ndarray) -> np.ndarray:
    exact = int(np.abs(x).max()) * len(x) < 2**63
    return np.concatenate([np.array([len(x)], object), (x if exact else x.astype(object)).sum(0).astype(object)])


def products(y: np.ndarray) -> np.ndarray:
    """The upper triangle of y'y, exact: by doubles while they hold all sums, else by Python's integers."""
    upper = np.triu_indices(y.shape[1])
    most = max(int(np.abs(y).max()), 1) ** 2
    if most >= EXACT:
        return (y.astype(object).T @ y.astype(object))[upper]
    total, step = np.zeros(len(upper[0]), object), max(1, (EXACT - 1) // most)
    for first in range(0, len(y), step):
        part = y[first : first + step].astype(float)
        total = total + (part.T @ part)[upper].astype(np.int64).astype(object)
    return total


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with a[order][:, order] = L L', L's columns as many as the rank."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    rest = np.diag(a).copy()
    least = d * np.finfo(float).eps * max(rest.max(), 0.0)
    for r in range(d):
        p = r + int(np.argmax(rest[r:]))
        if rest[p] <= least:
            return order, factor[:, :r]
        for m in (order, factor, rest):
            m[[r, p]] = m[[p, r]]
        factor[r, r] = math.sqrt(rest[r])
        factor[r + 1 :, r] = (a[order[r + 1 :], order[r]] - factor[r + 1 :, :r] @ factor[r, :r]) / factor[r, r]
        rest[r + 1 :] -= factor[r + 1 :, r] ** 2
    return order, factor


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, unit columns) of a matrix whose columns were rotated in pairs until all are orthogonal, longest first.

    A sweep meets all pairs in rounds of disjoint ones, as in a tournament, so that a round is one step on whole columns.
    """
    d, r = factor.shape
    u = np.zeros((d, r + r % 2))
    u[:, :r] = factor
    seats = np.arange(u.shape[1])
    for _ in range(MOST_SWEEPS):
        worst = 0.0
        for _ in range(max(u.shape[1] - 1, 0)):
            half = len(seats) // 2
            i, j = seats[:half], seats[::-1][:half]
            x, y = u[:, i], u[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(c) / np.maximum(np.sqrt(a * b), np.finfo(float).tiny)
            worst = max(worst, float(cosine.max()))
            turned = cosine > COSINE
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turned & np.isfinite(t), t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            u[:, i], u[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 8 * COSINE:
            break
    else:
        raise ArithmeticError("the rotations didn't make the columns orthogonal")
    squared = (u * u).sum(0)
    order = np.argsort(-squared, kind="stable")[:r]
    return squared[order], u[:, order] / np.sqrt(squared[order])


@dataclass
class Fit:
    """One length's whitening: exact count and sums, rounded means, components as columns and their eigenvalues."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray  #: mean less rounded mean
    components: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows of x."""
        return ((x - self.centre).astype(float) - self.rest) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)**2, exact."""
        off = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre)], object)
        y = x - self.centre
        bound = self.n * int(np.abs(y).max()) + max(map(abs, off))
        if bound * bound * x.shape[1] < 2**63:
            d = self.n * y - off.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * y.astype(object) - off
        return (d * d).sum(1).tolist()


def fit(rows: DataFrame, most: int = 16) -> dict[int, Fit]:
    """The whitening of each length of vector in the fit list ``rows`` (x), of at most so many components."""
    if rows.select(F.size("x").alias("w")).distinct().limit(MOST_WIDTHS + 1).count() > MOST_WIDTHS:
        raise ValueError(f"more than {MOST_WIDTHS} lengths of vectors")
    sums = _added(rows, _count_and_sums)
    centres = {w: np.array([(2 * s + at[0]) // (2 * at[0]) for s in at[1:]], np.int64) for w, at in sums.items()}
    squares = _added(rows, lambda w, x: products(x - centres[w]))
    out = {}
    for w, (n, *s) in sums.items():
        off = [a - n * int(c) for a, c in zip(s, centres[w])]
        scatter = np.zeros((w, w))
        for i, j, v in zip(*np.triu_indices(w), squares[w]):
            scatter[i, j] = scatter[j, i] = (n * v - off[i] * off[j]) / n
        order, factor = pivoted_cholesky(scatter)
        squared, unit = jacobi(factor)
        components = np.zeros_like(unit)
        components[order] = unit
        out[w] = Fit(n, s, centres[w], np.array([o / n for o in off]), components[:, :most], squared[:most] / n, float(np.trace(scatter)) / n)
    return out


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest absolute entry of the whitened fit list's covariance less the identity, by length."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                z = fits[x.shape[1]].project(x)
                found[x.shape[1]] = found.get(x.shape[1], 0.0) + np.concatenate([z.sum(0), (z.T @ z).ravel()])
        for width, values in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), width, np.int32)), pa.array(np.arange(len(values), dtype=np.int64)), pa.array(values)], ["width", "place", "value"])

    added = rows.select("x").mapInArrow(moments, "width int, place long, value double").groupBy("width", "place").agg(F.sum("value").alias("value")).orderBy("width", "place").toArrow()
    widths, values, out = added["width"].to_numpy(), added["value"].to_numpy(), {}
    for w, f in fits.items():
        k, v = len(f.values), values[widths == w] / f.n
        if k:
            # Whitened values are centred already; what rounding leaves of their mean is taken off.
            out[w] = float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows' whitened components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col).alias("x")).where(F.col("x").isNotNull())
    listed = written(rows.select("x").distinct())
    fits = fit(listed, most)
    errors = identity_errors(listed, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).take
            for places, x in matrices(batch.column(1)):
                f = fits[x.shape[1]]
                k = len(f.values)
                if not k:
                    continue
                rows_, whole = len(x) * k, np.int64
                deviations = np.array(f.deviations(x), object)
                if max(deviations) >= 2**63:
                    raise OverflowError("a deviation is no long")
                columns = [
                    ids(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows_, f.n, whole)), pa.array(np.repeat(deviations.astype(whole), k)),
                    pa.array(f.project(x).ravel()), pa.array(np.tile(f.values / f.trace, len(x))), pa.array(np.full(rows_, errors[x.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
