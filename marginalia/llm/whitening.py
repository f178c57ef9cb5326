"""Embedding whitening; covariances by polarisation from exact sums of squares."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

#: Bits of the pieces in which exact sums travel: Spark adds pieces as bigint, whatever the size of the sums.
PIECE = 30
#: Rows that are squared at once, and the largest value that 64-bit squares of pair sums over so many rows can hold.
ROWS, SMALL = 1024, 1 << 24


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pieces(totals: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, int, int]]:
    """Rows (dims, place, power, value): the sums, cut into pieces that keep the sum's sign."""
    for (dims, place), total in totals.items():
        sign, rest, power = (-1 if total < 0 else 1), abs(total), 0
        while rest:
            yield dims, place, power, sign * (rest & ((1 << PIECE) - 1))
            rest, power = rest >> PIECE, power + 1


def _exact_sums(fit: DataFrame, terms) -> dict[int, dict[int, int]]:
    """Exact sums over all rows of what ``terms(dims, integer vectors)`` returns, by dims and place; as many as there are terms.

    Each task adds its rows and returns one row per sum and piece, so what is shuffled and collected depends on the dimensions alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                x = _vectors(batch.column("x").filter(pa.array(sizes == dims)), int(dims))
                for at in range(0, len(x), ROWS):
                    for place, value in enumerate(terms(int(dims), x[at : at + ROWS])):
                        totals[int(dims), place] = totals.get((int(dims), place), 0) + int(value)
        rows = list(_pieces(totals))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["dims", "place", "power", "value"])

    parts = fit.mapInArrow(run, "dims bigint, place bigint, power bigint, value bigint")
    out: dict[int, dict[int, int]] = {}
    for dims, place, power, value in parts.groupBy("dims", "place", "power").agg(F.sum("value")).toLocalIterator():
        own = out.setdefault(dims, {})
        own[place] = own.get(place, 0) + (value << PIECE * power)
    return out


def _wide(x: np.ndarray) -> np.ndarray:
    """The same integers, as Python's where 64 bits could not hold the squares of their pair sums."""
    return x if not x.size or max(int(x.max()), -int(x.min())) <= SMALL // 8 else x.astype(object)


def _squares(y: np.ndarray) -> np.ndarray:
    return (y * y).sum(0) if y.dtype == object else np.einsum("ij,ij->j", y, y)


def integers(vector: Column) -> Column:
    """floor(256 * c) of every component as bigint; beyond its range the nearest bigint. Null for a vector that takes no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * 256, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("bigint"))
    return F.when(F.coalesce((F.size(vector) > 0) & finite, F.lit(False)), scaled)


class Model:
    """Means, components and eigenvalues of one vector length, fitted on ``n`` distinct integer vectors."""

    def __init__(self, dims: int, n: int, sums: list[int], squares: list[int], top: int):
        """``squares``: of centred values, of every dimension and then of the sums of every two, in the order of ``pairs``.

        Values are centred on the nearest integer m to S/n. With r = S - n*m the squares of n*x - S add up to n*n*q - n*r*r exactly, where q is the
        sum of the squares of x - m; for a sum of two dimensions r is the sum of theirs.
        """
        self.dims, self.n, self.sums = dims, n, sums
        self.mid = [_nearest(s, n) for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.mid)]
        own = [n * n * q - n * r * r for q, r in zip(squares, self.rest)]
        cov = np.zeros((dims, dims))
        whole = n**3
        for i in range(dims):
            cov[i, i] = own[i] / whole
        for (i, j), q in zip(pairs(dims), squares[dims:]):
            both = n * n * q - n * (self.rest[i] + self.rest[j]) ** 2
            cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * whole)  # var(a + b) - var(a) - var(b) = 2 cov(a, b)
        self.cov = cov
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][: min(top, dims)]
        self.values, self.vectors = values[order], vectors[:, order]
        self.vectors = self.vectors * np.where(np.take_along_axis(self.vectors, np.abs(self.vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
        trace = float(Fraction(sum(own), whole))
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        # Directions without spread cannot be scaled to one; rounding leaves them near zero beside the largest.
        self.spread = self.values > max(float(values[-1]), 0.0) * dims * 1e-14

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision, from the exact integer difference to the middle."""
        return (x - np.array(self.mid, x.dtype)).astype(float) - np.array([float(Fraction(r, self.n)) for r in self.rest])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.spread, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of every row, exact; None where it is beyond bigint."""
        z = _wide(x - np.array(self.mid, object) if x.dtype == object else x - np.array(self.mid, np.int64))
        rest = np.array(self.rest, object if max(map(abs, self.rest), default=0) > 1 << 31 else np.int64)
        twice, free = (z * z).sum(1), sum(r * r for r in self.rest)
        along = (z * rest).sum(1) if max(map(abs, self.rest), default=0) < 1 << 31 else (z.astype(object) * rest).sum(1)
        out = [self.n * self.n * int(a) - 2 * self.n * int(b) + free for a, b in zip(twice, along)]
        return [v if v < 1 << 63 else None for v in out]


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def pairs(dims: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dims) for j in range(i + 1, dims)]


def fit(vectors: DataFrame, top: int = 4) -> dict[int, Model]:
    """A model for every vector length in rows (dims, x), each distinct x counted once.

    Three passes over the written distinct vectors: sums, then squares of the centred values of every dimension and every sum of two. What
    reaches the driver are dims * (dims + 1) / 2 sums per length; the decomposition there is of one matrix of dims by dims.
    """
    sums = _exact_sums(vectors, lambda dims, x: [len(x), *(_wide(x) if x.dtype != object else x).sum(0)])
    known = {d: ([s.get(i + 1, 0) for i in range(d)], s[0]) for d, s in sums.items()}
    mids = {d: [_nearest(s, n) for s in own] for d, (own, n) in known.items()}

    def squared(dims: int, x: np.ndarray) -> Iterator[int]:
        mid = np.array(mids[dims], object)
        z = _wide((x.astype(object) - mid) if max(map(abs, mids[dims])) > SMALL or np.abs(x.astype(float)).max() > 2.0**53 else x - mid.astype(np.int64))
        yield from _squares(z)
        for i in range(dims - 1):
            yield from _squares(z[:, i : i + 1] + z[:, i + 1 :])

    squares = _exact_sums(vectors, squared)
    return {d: Model(d, n, own, [squares.get(d, {}).get(i, 0) for i in range(d * (d + 1) // 2)], top) for d, (own, n) in known.items()}


def _identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per vector length the largest absolute entry of the whitened fit list's covariance minus the identity, measured in two passes."""

    def run(batches: Iterator[pa.RecordBatch], means: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                m = models[int(dims)]
                w = m.whiten(_vectors(batch.column("x").filter(pa.array(sizes == dims)), int(dims)))[:, m.spread]
                if means is not None:
                    w = w - means[int(dims)]
                totals[int(dims)] = totals.get(int(dims), 0) + (w.sum(0) if means is None else w.T @ w).ravel()
        rows = [(d, i, float(v)) for d, t in totals.items() for i, v in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["dims", "place", "value"])

    def summed(means: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        parts = vectors.mapInArrow(lambda batches: run(batches, means), "dims bigint, place bigint, value double")
        got = {(r[0], r[1]): r[2] for r in parts.groupBy("dims", "place").agg(F.sum("value")).toLocalIterator()}
        return {d: np.array([got[d, i] / m.n for i in range(int(m.spread.sum()) ** (1 if means is None else 2))]) for d, m in models.items()}

    covs = summed(summed(None))
    return {d: float(np.abs(c.reshape(int(models[d].spread.sum()), -1) - np.eye(int(models[d].spread.sum()))).max()) if c.size else 0.0 for d, c in covs.items()}


def whiten(vectors: DataFrame, top: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component up to ``top``.

    A vector becomes the integers x = floor(256 * c). Means and covariances are those of the distinct x (divisor n), summed exactly: squares of
    centred values for every dimension and every sum of two, whose differences give the covariances. Components are unit eigenvectors by falling
    eigenvalue, the sign such that the entry farthest from zero is positive.

    Vectors that are null, empty or hold null or non-finite entries take no part. Null ids stay; repeated rows are returned each, copies
    count once in the fit. Each vector length has a fit of its own; fewer dimensions than ``top`` give fewer components. A direction without spread (always so
    for one distinct vector) has a null ``whitened`` and does not enter ``identity_error``; a ``deviation`` beyond bigint is null. Other columns
    are left out, an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), integers(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    distinct = written(rows.groupBy("x").agg(F.size("x").cast("bigint").alias("dims")), "fit")
    models = fit(distinct, top)
    errors = _identity_errors(distinct, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("x")).to_numpy()
            for dims in np.unique(sizes):
                mine, m = pa.array(sizes == dims), models[int(dims)]
                ids, x = batch.column("vec_id").filter(mine), _vectors(batch.column("x").filter(mine), int(dims))
                w, k = m.whiten(x), len(m.values)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), m.n), pa.int64()),
                    pa.array(m.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(each), errors[int(dims)])),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
