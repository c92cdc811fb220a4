"""Lloyd steps that skip distances by bounds.

Each vector carries an upper bound of the distance to its centre and a lower bound of
that to all others.  When centres move the bounds give way by as much, and a vector whose
upper bound stays below the lower one, or below half the way from its centre to the next,
keeps its cluster without a look at any centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.clustering import (
    PARTIAL_SUMS,
    TILE_DISTANCES,
    _add_by_cluster,
    _matrix,
    _sums_batch,
    check_centers,
    merged_means,
)
from gristmill.operators.staging import stage

STATE = "x array<double>, cluster int, upper double, lower double, looked long"
# Room for rounding in a distance.
SLACK = 1e-7


def _two_nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre (ties: lowest), its distance and that of the second, tile by tile."""
    rows = np.arange(len(x))
    own = np.zeros(len(x), np.int64)
    first, second = np.full(len(x), np.inf), np.full(len(x), np.inf)
    norms = (centers**2).sum(axis=1)
    tile = max(2, TILE_DISTANCES // max(len(x), 1))
    for begin in range(0, len(centers), tile):
        part = slice(begin, begin + tile)
        scores = norms[part] - 2.0 * (x @ centers[part].T)
        at = scores.argmin(axis=1)
        here = scores[rows, at]
        scores[rows, at] = np.inf
        second = np.minimum(np.maximum(first, here), np.minimum(second, scores.min(axis=1)))
        own = np.where(here < first, begin + at, own)
        first = np.minimum(first, here)
    square = (x**2).sum(axis=1)
    return own, np.sqrt(np.maximum(first + square, 0)), np.sqrt(np.maximum(second + square, 0))


def _half_gaps(centers: np.ndarray) -> np.ndarray:
    """Half the distance from each centre to the nearest other one."""
    norms = (centers**2).sum(axis=1)
    out = np.full(len(centers), np.inf)
    tile = max(1, TILE_DISTANCES // len(centers))
    for begin in range(0, len(centers), tile):
        part = centers[begin : begin + tile]
        squared = norms - 2.0 * (part @ centers.T) + norms[begin : begin + tile, None]
        squared[np.arange(len(part)), begin + np.arange(len(part))] = np.inf
        out[begin : begin + tile] = np.sqrt(np.maximum(squared.min(axis=1), 0.0)) / 2
    return out


def _state_batch(x, own, upper, lower, looked) -> pa.RecordBatch:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))
    arrays = [lists, pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(looked)]
    return pa.RecordBatch.from_arrays(arrays, ["x", "cluster", "upper", "lower", "looked"])


def _begin(points: DataFrame, centers: np.ndarray, vector: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                yield _state_batch(x, *_two_nearest(x, centers), np.full(len(x), len(centers), np.int64))

    return points.select(vector).mapInArrow(run, STATE)


def _move(state: DataFrame, before: np.ndarray, centers: np.ndarray) -> DataFrame:
    """The state under the new centres; ``looked`` counts the distances of this step."""
    moved = np.sqrt(((centers - before) ** 2).sum(axis=1))
    order = moved.argsort()
    # The farthest move of any centre but the own one.
    other = np.full(len(moved), moved[order[-1]])
    other[order[-1]] = moved[order[-2]] if len(moved) > 1 else 0.0
    gaps = _half_gaps(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.int64)
            upper = batch.column(2).to_numpy() + moved[own]
            lower = batch.column(3).to_numpy() - other[own]
            looked = np.zeros(len(x), np.int64)

            def unsure(rows: np.ndarray) -> np.ndarray:
                reach = np.maximum(lower[rows], gaps[own[rows]])
                return rows[~(upper[rows] * (1 + SLACK) + SLACK < reach)]

            rows = unsure(np.arange(len(x)))
            upper[rows] = np.sqrt(((x[rows] - centers[own[rows]]) ** 2).sum(axis=1))
            looked[rows] += 1
            rows = unsure(rows)
            if len(rows):
                own[rows], upper[rows], lower[rows] = _two_nearest(x[rows], centers)
                looked[rows] += len(centers)
            yield _state_batch(x, own, upper, lower, looked)

    return state.select("x", "cluster", "upper", "lower").mapInArrow(run, STATE)


def _means(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    k, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                _add_by_cluster(sums, counts, batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1)))
        yield _sums_batch(np.flatnonzero(counts), counts, sums)

    return merged_means(state.select("cluster", "x").mapInArrow(run, PARTIAL_SUMS), centers)


@dataclass(frozen=True)
class BoundedFit:
    """Centroids, and for each assignment the distances taken and those of a full search."""

    centers: np.ndarray
    looked: list[int]
    full: list[int]


def lloyd_bounded(points: DataFrame, centers: np.ndarray, steps: int, vector: str = "embedding") -> BoundedFit:
    """B2 from given starting centroids: the centroids of ``lloyd``, but for rounding.

    The vectors with their bounds are written once a step, so a step costs a write and
    two reads of them, and the distances that the bounds leave.  That pays where
    distances to all centres cost more; an empty cluster keeps its centre.
    """
    centers = check_centers(centers)
    state, looked, full = stage(_begin(points, centers, vector), "bounds0"), [], []
    for turn in range(steps):
        n, taken = state.agg(F.count(F.lit(1)), F.coalesce(F.sum("looked"), F.lit(0))).first()
        looked.append(taken)
        full.append(n * len(centers))
        before, centers = centers, _means(state, centers)
        if turn < steps - 1:
            state = stage(_move(state, before, centers), f"bounds{turn + 1}")
    return BoundedFit(centers, looked, full)
