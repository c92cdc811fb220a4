"""Embedding whitening by polarisation (operator 12).

Covariances are never summed from products of two dimensions.  For every dimension and
every sum of two dimensions the squares of centred integers are added, exactly; from
these variances, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2.  The matrix, d x d
numbers, is assembled in exact integers on the driver for ``eigh``; tasks project their
vectors on the leading components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.vectors import matrices

GRID = 1024
SHIFT = 100_000
# Entries of this size or more have no place on the integer grid.
LIMIT = float(1 << 30)
MAX_DIMENSIONS = 4096
# Numbers of one matrix of pair sums.
CELLS = 1 << 20
_WHOLE = pa.decimal128(38, 0)


def _whole(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], _WHOLE)


def _grid(values: np.ndarray) -> np.ndarray:
    return np.floor(GRID * values).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Moments:
    """Rows, the sum of each dimension, and the whole number next to each mean."""

    n: int
    sums: list[int]

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """Sums of what is left when the centre is taken off."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]


def moments(vectors: DataFrame, column: str = "embedding") -> Moments | None:
    """Exact row count and sums over the vectors that take part; None if there are none.

    Vectors of one length take part: the length that most usable vectors have, the
    longer one of equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, values in matrices(batch.column(0), LIMIT):
                n, sums = held.get(values.shape[1], (0, 0))
                held[values.shape[1]] = n + len(values), sums + _grid(values).sum(0).astype(object)
        for length, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length), pa.array(range(length)), pa.array([n] * length), _whole(sums)],
                names=["length", "place", "n", "total"],
            )

    parts = vectors.select(column).mapInArrow(run, "length long, place long, n long, total decimal(38,0)")
    added = parts.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    first = added.filter("place = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not first:
        return None
    length = first[0].length
    if length > MAX_DIMENSIONS:
        raise ValueError(f"{length} dimensions; a matrix of at most {MAX_DIMENSIONS} fits on the driver")
    rows = added.filter(F.col("length") == length).orderBy("place").collect()
    return Moments(first[0].n, [int(r.total) for r in rows])


def _centred(batch: pa.RecordBatch, name: str, centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, values in matrices(batch.column(name), LIMIT):
        if values.shape[1] == len(centre):
            yield rows, _grid(values) - centre


def _squares(numbers: np.ndarray, most: int) -> np.ndarray:
    """Sum of the squares of each column; ``most`` bounds the numbers' size."""
    if most * most * max(1, len(numbers)) >= 1 << 62:
        numbers = numbers.astype(object)
    return (numbers * numbers).sum(0).astype(object)


def pair_squares(vectors: DataFrame, found: Moments, column: str = "embedding") -> DataFrame:
    """Sums of squares (a, b, squares): of dimension a where b is a, else of a + b."""
    centre = found.centre
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(d - a, object) for a in range(d)]
        any_rows = False
        for batch in batches:
            for _, whole in _centred(batch, column, centre):
                any_rows = True
                step = max(1, CELLS // d)
                for i in range(0, len(whole), step):
                    some = np.asfortranarray(whole[i : i + step])
                    most = int(np.abs(some).max())
                    for a in range(d):
                        held[a][:1] += _squares(some[:, a : a + 1], most)
                        held[a][1:] += _squares(some[:, a + 1 :] + some[:, a : a + 1], 2 * most)
        if any_rows:
            for a in range(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * (d - a)), pa.array(range(a, d)), _whole(held[a])], names=["a", "b", "squares"]
                )

    parts = vectors.select(column).mapInArrow(run, "a long, b long, squares decimal(38,0)")
    return parts.groupBy("a", "b").agg(F.sum("squares").alias("squares"))


def covariance(found: Moments, squares: DataFrame) -> np.ndarray:
    """The covariance matrix, each entry the nearest double of its exact value."""
    d, n, rest = len(found.sums), found.n, found.rest
    spread: dict[tuple[int, int], int] = {}
    for r in squares.toLocalIterator():
        of = rest[r.a] if r.a == r.b else rest[r.a] + rest[r.b]
        spread[r.a, r.b] = n * int(r.squares) - of * of
    out = np.empty((d, d))
    for (a, b), both in spread.items():
        twice = 2 * both if a == b else both - spread[a, a] - spread[b, b]
        out[a, b] = out[b, a] = twice / (2 * n * n)
    return out


@dataclass(frozen=True)
class Whitener:
    """Leading components as columns, scaled to unit variance, and their eigenvalues."""

    moments: Moments
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values of x minus the centre; NaN for components without variance."""
        mean = np.array([r / self.moments.n for r in self.moments.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (centred - mean) @ self.components * scale


def fit(vectors: DataFrame, column: str = "embedding", most: int = 8) -> Whitener | None:
    """Up to ``most`` components by falling eigenvalue; the sign makes the entry of the
    largest size positive.  An eigenvalue below rounding counts as 0."""
    found = moments(vectors, column)
    if found is None:
        return None
    matrix = covariance(found, pair_squares(vectors, found, column))
    values, columns = np.linalg.eigh(matrix)
    values, columns = values[::-1][:most], columns[:, ::-1][:, :most]
    trace = float(np.trace(matrix))
    values = np.where(values > 1e-14 * len(matrix) * max(trace, 0.0), values, 0.0)
    top = columns[np.abs(columns).argmax(0), np.arange(columns.shape[1])]
    columns = columns * np.where(top < 0, -1.0, 1.0)
    return Whitener(found, columns, values, values / trace if trace > 0 else np.zeros(len(values)))


def identity_error(vectors: DataFrame, model: Whitener, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, from
    the whitened values themselves, over the components that have variance."""
    centre, live = model.moments.centre, np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0
    m = len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            for _, whole in _centred(batch, column, centre):
                w = model.project(whole)[:, live]
                total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size)), pa.array(total.ravel())], names=["place", "total"]
        )

    parts = vectors.select(column).mapInArrow(run, "place long, total double")
    cells = parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    # The whitened values have mean 0 but for rounding, so this is a centred sum.
    total = np.array([r.total for r in cells]).reshape(m + 1, m) / model.moments.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(m)).max())


def whiten(
    vectors: DataFrame, model: Whitener | None = None, vec_id: str = "vec_id", column: str = "embedding", most: int = 8
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for
    each vector that takes part and each of its first ``most`` components.

    x = floor(1024 c) + 100000 for every entry c.  No part take null and empty vectors,
    those with a null or non-finite entry or one of 2^30 or more in size, and those of
    another length than most have.  Null and repeated ids and equal vectors each keep
    their rows; an empty table gives none.  ``whitened`` is null and ``explained`` 0 for
    a component without variance; ``deviation`` is null where it exceeds 64 bits.
    Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("embedding"))
    model = model or fit(rows, most=most)
    fields = rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long")
    for name in ("whitened", "explained", "identity_error"):
        fields = fields.add(name, "double")
    if model is None:
        return rows.sparkSession.createDataFrame([], fields)
    error = identity_error(rows, model)
    found, centre = model.moments, model.moments.centre
    k, n = len(model.values), found.n
    names = fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.array(found.rest, object)
        for batch in batches:
            for at, whole in _centred(batch, "embedding", centre):
                most = n * int(np.abs(whole).max()) + max(map(abs, found.rest))
                exact = most * most * len(centre) < 1 << 63
                off = n * whole - rest.astype(np.int64) if exact else n * whole.astype(object) - rest
                deviation = [int(x) if x < 1 << 63 else None for x in (off * off).sum(1)]
                many = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(many, n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(model.project(whole).ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(many, error)),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, fields)
