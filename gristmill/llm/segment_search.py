"""Exact top-k search by multi-resolution segment statistics (operator 13).

A vector is cut into 1, 4, 16, ... segments.  Mean m and deviation s of the segments of
two vectors bound their distance from below: |q - x|^2 >= sum over segments of
length * ((m_q - m_x)^2 + (s_q - s_x)^2), coarse to fine.  With the norms this is a bound
from above on the inner product, since 2 q.x = |q|^2 + |x|^2 - |q - x|^2.  A pair goes on
to the next resolution only while the bound reaches the query's k-th best score; the
last survivors get their exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.vectors import best_of, matrices
from gristmill.operators.staging import stage

GRID = 256
# Entries of this size or more have no place on the integer grid.
LIMIT = float(1 << 44)
# Entries of the queries that one pass takes along, and of a step's matrix of bounds.
BLOCK_ENTRIES = 1 << 21
CELLS = 1 << 20
PAIRS = 1 << 15
_MOST = (1 << 63) - 1
# Share of a bound that rounding may take.
_SLACK = 1e-9


def levels(length: int) -> list[int]:
    """Numbers of segments, coarse to fine; the exact product follows."""
    out = [1]
    while out[-1] * 8 <= length:
        out.append(out[-1] * 4)
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length,
    so that the product of two rows bounds the vectors' inner product."""
    edges = np.arange(segments) * x.shape[1] // segments
    sizes = np.diff([*edges, x.shape[1]])
    values = x.astype(np.float64)
    means = np.add.reduceat(values, edges, axis=1) / sizes
    off = values - np.repeat(means, sizes, axis=1)
    deviations = np.sqrt(np.add.reduceat(off * off, edges, axis=1) / sizes)
    return np.hstack([means, deviations]) * np.sqrt(np.tile(sizes, 2))


@dataclass
class Vectors:
    """Integer vectors of one length with their ids, norms and statistics."""

    ids: np.ndarray
    none: np.ndarray
    x: np.ndarray
    norms: np.ndarray = field(init=False)
    stats: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        self.stats = [statistics(self.x, s) for s in levels(self.x.shape[1])]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Vectors]]:
    names = batch.column(0)
    none = names.is_null().to_numpy(zero_copy_only=False)
    ids = names.fill_null(0).to_numpy()
    for rows, values in matrices(batch.column(1), LIMIT):
        x = np.floor(GRID * values).astype(np.int64)
        yield rows, Vectors(ids[rows], none[rows], x)


def _products(q: Vectors, x: Vectors, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Exact products of pairs; sums that exceed 64 bits become the nearest long."""
    out = np.empty(len(qi), np.int64)
    big = q.norms.max() * x.norms.max() >= 1 << 62
    for i in range(0, len(qi), PAIRS):
        a, b = q.x[qi[i : i + PAIRS]], x.x[xi[i : i + PAIRS]]
        # Sums wrap, so they are exact whenever they fit.
        some = np.einsum("ij,ij->i", a, b)
        if big:
            near = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))
            some = np.where(np.abs(near) < 9.2e18, some, np.where(near < 0, -_MOST, _MOST))
        out[i : i + PAIRS] = some
    return out


class Best:
    """The best ``k`` rows found so far for each query of one length."""

    def __init__(self, queries: Vectors, k: int, floors: np.ndarray) -> None:
        self.q, self.k, self.least = queries, k, floors.copy()
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def _add(self, qi: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        q, s, z, i = (np.concatenate([a, b]) for a, b in zip(self.rows, (qi, score, none, ids)))
        order = np.lexsort((i, z, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        few = order[place < self.k]
        self.rows = [q[place < self.k], s[few], z[few], i[few]]
        full = order[place == self.k - 1]
        at = q[place == self.k - 1]
        self.least[at] = np.maximum(self.least[at], s[full].astype(np.float64))

    def meet(self, x: Vectors) -> None:
        """Take the rows of ``x`` into account, in steps of bounded size."""
        step = 128
        begin = 0
        while begin < len(x.ids):
            some = slice(begin, begin + step)
            part = Vectors(x.ids[some], x.none[some], x.x[some])
            wide = max(1, CELLS // step)
            for i in range(0, len(self.q.ids), wide):
                self._step(i, min(len(self.q.ids), i + wide), part)
            begin += step
            # The first rows, scored without a bar, are few.
            step = min(4096, step * 4)

    def _step(self, low: int, high: int, x: Vectors) -> None:
        q = self.q
        reach = self.least[low:high] - _SLACK * np.abs(np.maximum(self.least[low:high], -1e300)) - 1
        slack = _SLACK * x.norms
        bound = q.stats[0][low:high] @ x.stats[0].T
        qi, xi = np.nonzero(bound + q.norms[low:high, None] * slack >= reach[:, None])
        for a, b in zip(q.stats[1:], x.stats[1:]):
            if len(qi) * 8 > bound.size:
                bounds = (a[low:high] @ b.T)[qi, xi]
            else:
                bounds = np.empty(len(qi))
                for i in range(0, len(qi), PAIRS):
                    j = slice(i, i + PAIRS)
                    bounds[j] = np.einsum("ij,ij->i", a[low:high][qi[j]], b[xi[j]])
            on = bounds + q.norms[low:high][qi] * slack[xi] >= reach[qi]
            qi, xi = qi[on], xi[on]
        qi = qi + low
        other = x.none[xi] | q.none[qi] | (x.ids[xi] != q.ids[qi])
        qi, xi = qi[other], xi[other]
        if not len(qi):
            return
        score = _products(q, x, qi, xi)
        good = score.astype(np.float64) >= self.least[qi]
        if good.any():
            self._add(qi[good], score[good], x.none[xi[good]], x.ids[xi[good]])


FOUND = "query long, query_id long, vec_id long, score long"


def _pass(vectors: DataFrame, block: dict[int, tuple[Vectors, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The best ``k`` of each query of the block: numbers, ids and floors by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(q, k, floors) for n, (q, _, floors) in block.items()}
        for batch in batches:
            for _, x in _vectors(batch):
                if x.x.shape[1] in best:
                    best[x.x.shape[1]].meet(x)
        for n, b in best.items():
            at, score, none, ids = b.rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[n][1][at]),
                    pa.array(b.q.ids[at], mask=b.q.none[at]),
                    pa.array(ids, mask=none),
                    pa.array(score),
                ],
                names=["query", "query_id", "vec_id", "score"],
            )

    found = vectors.mapInArrow(run, FOUND)
    return best_of(found, "query", [F.desc("score"), F.asc_nulls_last("vec_id")], k, ["vec_id", "score"])


def _blocks(queries: DataFrame) -> Iterator[dict[int, tuple[Vectors, np.ndarray, np.ndarray]]]:
    """Queries a bounded block at a time, by length, numbered through."""
    held: list[tuple[int | None, list[float]]] = []
    entries = number = 0

    def block():
        kind = pa.list_(pa.float64())
        batch = pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in held], pa.int64()), pa.array([v for _, v in held], kind)], names=["id", "v"]
        )
        return {
            q.x.shape[1]: (q, number + rows.astype(np.int64), np.full(len(rows), -np.inf))
            for rows, q in _vectors(batch)
        }

    for r in queries.toLocalIterator():
        if r[1] is None:
            continue
        if held and entries + len(r[1]) > BLOCK_ENTRIES:
            yield block()
            number, held, entries = number + len(held), [], 0
        held.append((r[0], r[1]))
        entries += len(r[1])
    if held:
        yield block()


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", column: str = "embedding",
    sample: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows of
    ``vectors`` with the highest inner products of floor(256 * entry), ties to the
    smaller id.

    Rows with the query's id are its own and no candidates; a null id is nobody's, and
    comes last among ties.  Repeated queries, with or without an id, are each answered,
    repeated candidates each counted.  No part take null and empty vectors, those with a
    null or non-finite entry or one of 2^44 or more in size, nor candidates of another
    length than the query's; a product beyond 64 bits counts as the nearest long.  Empty
    tables give no rows.  Other columns are not read.

    Queries are taken in blocks of BLOCK_ENTRIES entries, a pass over the vectors for
    each.  ``sample``, any rows of ``vectors``, only saves work: its k-th best score is
    the bar that rows must reach from the start.
    """
    if k < 1:
        raise ValueError(f"k must be positive, got {k}")
    names = [F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")]
    rows, some = vectors.select(*names), None if sample is None else sample.select(*names)
    done = None
    for block in _blocks(stage(queries.select(*names), "queries")):
        seeds = [] if some is None else _pass(some, block, k).filter(F.col("rank") == k).collect()
        bar = {r.query: r.score for r in seeds}
        for n, (q, numbers, _) in list(block.items()):
            block[n] = q, numbers, np.array([bar.get(i, -np.inf) for i in numbers.tolist()])
        # Written before the next block is read, so the driver holds one block.
        found = stage(_pass(rows, block, k).select("query_id", "rank", "vec_id", "score"), "nearest")
        done = found if done is None else done.unionByName(found)
    if done is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return done
