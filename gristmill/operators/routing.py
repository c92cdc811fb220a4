"""Nearest of more centroids than can travel with every task.

Centroids live in a table, dealt to cells around coarse centres.  Only the coarse
centres and the cells' radii travel.  A vector is sent to the cells in the order of their
least possible distance, |x - coarse| - radius, and on to further ones only while such a
cell may hold a closer centroid, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.seeded import hex_prefix, seeded_hash
from gristmill.operators.clustering import _matrix, _nearest, assign, check_centers, first_vectors, lloyd
from gristmill.operators.joins import bounded, copies_for
from gristmill.operators.running import row_rank
from gristmill.operators.staging import stage

# Centroids of one cell, and vectors of one cell that meet in a task.
CELL_CENTERS = 4096
PART_ROWS = 1 << 16
# Cells that a vector is sent to in the first round, and the growth from round to round.
FIRST_VISITS = 1
GROWTH = 4
# Room for rounding in a distance.
SLACK = 1e-6


@dataclass(frozen=True)
class RoutedCenters:
    """``table`` (id, center, cell); coarse centre and radius of each cell."""

    table: DataFrame
    routes: np.ndarray
    radii: np.ndarray


def route_centers(centers: DataFrame, coarse: np.ndarray, cell_centers: int = CELL_CENTERS) -> RoutedCenters:
    """Deal centroids (id, center) to cells of at most about ``cell_centers`` each.

    A coarse centre that attracts more of them has several cells, divided by a hash.
    """
    near = stage(assign(centers, check_centers(coarse), "center", "coarse", "off"), "near")
    sizes = near.groupBy("coarse").count().orderBy("coarse").collect()  # a row for each coarse centre at most
    first, rows = 0, []
    for r in sizes:
        parts = -(-r["count"] // cell_centers)
        rows.append((r["coarse"], first, parts))
        first += parts
    if not rows:
        raise ValueError("there are no centroids")
    cells = centers.sparkSession.createDataFrame(rows, "coarse int, first int, parts int")
    number = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("cell")
    dealt = near.join(bounded(cells, len(rows)), "coarse").select("id", "center", number, "off")
    table = stage(dealt, "cells")
    radii = np.full(first, -1.0)
    for r in table.groupBy("cell").agg(F.max("off").alias("radius")).collect():
        radii[r.cell] = r.radius
    of = np.repeat([r[0] for r in rows], [r[2] for r in rows])
    held = np.flatnonzero(radii >= 0)
    # Cells that the hash left empty have no number.
    renumbered = centers.sparkSession.createDataFrame(
        [(int(c), i) for i, c in enumerate(held)], "cell int, __cell int"
    )
    if len(held) < first:
        table = table.join(bounded(renumbered, len(held)), "cell").drop("cell").withColumnRenamed("__cell", "cell")
    return RoutedCenters(table.drop("off"), np.asarray(coarse, np.float64)[of[held]], radii[held])


def _visits(routed: RoutedCenters, many: int):
    """The next cells of each vector, given how many it has seen and its best distance."""
    routes, radii = routed.routes, routed.radii
    norms = (routes**2).sum(axis=1)

    @F.arrow_udf("array<int>")
    def next_cells(vectors: pa.Array, seen: pa.Array, best: pa.Array) -> pa.Array:
        x, out = _matrix(vectors), []
        done, reach = seen.to_numpy(zero_copy_only=False), best.to_numpy(zero_copy_only=False)
        tile = max(1, (4 << 20) // len(routes))
        for i in range(0, len(x), tile):
            part = x[i : i + tile]
            squared = norms - 2.0 * (part @ routes.T) + (part**2).sum(axis=1)[:, None]
            least = np.sqrt(np.maximum(squared, 0.0)) - radii
            order = least.argsort(axis=1, kind="stable")
            for row, at, begin, bar in zip(least, order, done[i : i + tile], reach[i : i + tile]):
                cells = at[begin : begin + many]
                out.append(cells[row[cells] <= bar + SLACK * (1.0 + bar)].astype(np.int32))
        ends = np.concatenate([[0], np.cumsum([len(c) for c in out])]).astype(np.int32)
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))

    return next_cells.asNondeterministic()


def _visited(requests: DataFrame, routed: RoutedCenters, part_rows: int) -> DataFrame:
    """(__row, found): the least (distance, id) over the cells that a row asked for."""
    cells = len(routed.radii)
    counts = requests.groupBy("cell").agg(copies_for(F.count(F.lit(1)), part_rows).alias("parts"))
    part = F.pmod(F.xxhash64("__row"), F.col("parts")).cast("int").alias("part")
    asked = requests.join(bounded(counts, cells), "cell").select("cell", part, "__row", "x")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    held = routed.table.join(bounded(counts, cells), "cell").select("cell", every, "id", "center")

    def nearest(rows: pa.Table, centers: pa.Table) -> pa.Table:
        if not rows.num_rows or not centers.num_rows:
            return pa.table({"__row": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "id": pa.array([], pa.int64())})
        centers = centers.sort_by("id")
        best, squared = _nearest(_matrix(rows["x"]), _matrix(centers["center"]))
        return pa.table({
            "__row": rows["__row"], "distance": np.sqrt(squared), "id": centers["id"].combine_chunks().take(pa.array(best)),
        })

    grouped = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part"))
    found = grouped.applyInArrow(nearest, "__row long, distance double, id long")
    return found.groupBy("__row").agg(F.min(F.struct("distance", "id")).alias("found"))


def assign_routed(
    points: DataFrame, routed: RoutedCenters, vector: str = "embedding", out: str = "cluster",
    distance: str | None = None, part_rows: int = PART_ROWS,
) -> DataFrame:
    """B4 with centroids in a table: the nearest one's id, ties to the lowest.

    Rows of a cell that many vectors ask for are divided, the cell's centroids repeated
    for each part.  All but the result's two columns stay in place until the end.
    """
    rows = stage(points.withColumn("__row", F.monotonically_increasing_id()), "points")
    state = rows.select(
        "__row", F.col(vector).alias("x"), F.lit(0).alias("seen"),
        F.struct(F.lit(float("inf")).alias("distance"), F.lit(None).cast("long").alias("id")).alias("best"),
    )
    many, turn, done = FIRST_VISITS, 0, None
    while True:
        asked = state.withColumn("cells", _visits(routed, many)("x", "seen", "best.distance"))
        asked = stage(asked, f"asked{turn}")
        closed = asked.filter(F.size("cells") == 0).select("__row", "best")
        done = closed if done is None else done.unionByName(closed)
        going = asked.filter(F.size("cells") > 0)
        if going.isEmpty():
            break
        requests = going.select("__row", "x", F.explode("cells").alias("cell"))
        found = _visited(requests, routed, part_rows)
        better = F.when(F.col("found") < F.col("best"), F.col("found")).otherwise(F.col("best"))
        # A row that was sent to fewer cells than it might has seen all that can matter so far.
        state = going.join(found, "__row").select(
            "__row", "x", (F.col("seen") + F.size("cells")).alias("seen"), better.alias("best")
        )
        many, turn = many * GROWTH, turn + 1
    columns = [F.col("best.id").alias(out)] + ([F.col("best.distance").alias(distance)] if distance else [])
    kept = rows.drop(out, *([distance] if distance else []))
    return kept.join(done.select("__row", *columns), "__row").drop("__row")


def cluster_means(assigned: DataFrame, vector: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """(id, center) of every cluster that has vectors, for any number of clusters.

    A task adds up the vectors of each batch by cluster; the partial sums of a cluster
    then pass one by one, so no table of all clusters is held anywhere.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
                yield _summed(own, np.ones(len(own), np.int64), x)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, n, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if held is not None:
                own, n, x = (np.concatenate([a, b]) for a, b in zip(held, (own, n, x)))
            # The last cluster may go on in the next batch.
            last = own == own[-1]
            if not last.all():
                yield _summed(own[~last], n[~last], x[~last])
            held = own[-1:], n[last].sum(keepdims=True), x[last].sum(axis=0, keepdims=True)
        if held is not None:
            yield _summed(*held)

    fields = "id long, n long, total array<double>"
    parts = assigned.select(F.col(cluster).cast("long"), vector).mapInArrow(sums, fields)
    added = parts.repartition("id").sortWithinPartitions("id").mapInArrow(merged, fields)
    return added.select("id", F.transform("total", lambda s: s / F.col("n")).alias("center"))


def _summed(own: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """One row of each cluster, in the clusters' order."""
    order = own.argsort(kind="stable")
    ids, firsts = np.unique(own[order], return_index=True)
    total = np.add.reduceat(x[order], firsts, axis=0)
    ends = np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(np.add.reduceat(n[order], firsts)), lists], ["id", "n", "total"]
    )


def seeded_centers(points: DataFrame, k: int, seed: int, key: str, vector: str = "embedding") -> DataFrame:
    """(id, center): the first ``k`` different vectors in seeded order, as a table.

    Fewer than ``k`` different vectors are an error.
    """
    firsts = points.groupBy(F.col(vector).cast("array<double>").alias("center")).agg(
        F.min(seeded_hash(seed, key)).alias("h")
    )
    cut = firsts.withColumn("bucket", hex_prefix("h", 3))
    ranked = row_rank(cut, [], "bucket", ["h"], "id", max_keys=4096)
    table = stage(ranked.filter(F.col("id") < k).select(F.col("id").cast("long"), "center"), "centers")
    if table.count() < k:
        raise ValueError(f"{k} centroids were asked for, but there are fewer different vectors")
    return table


def coarse_centers(centers: DataFrame, k: int, seed: int, steps: int = 2) -> np.ndarray:
    """Centres to route by: a few k-means steps over the centroids themselves."""
    return lloyd(centers, first_vectors(centers, k, seed, "id", "center"), steps, "center")


def lloyd_routed(
    points: DataFrame, centers: DataFrame, coarse_k: int, steps: int, seed: int, vector: str = "embedding"
) -> DataFrame:
    """B2 with centroids (id, center) in a table; an empty cluster keeps its centre."""
    for _ in range(steps):
        routed = route_centers(centers, coarse_centers(centers, coarse_k, seed))
        means = cluster_means(assign_routed(points, routed, vector), vector)
        kept = centers.join(means.withColumnRenamed("center", "__mean"), "id", "left")
        centers = stage(kept.select("id", F.coalesce("__mean", F.col("center").cast("array<double>")).alias("center")), "centers")
    return centers
