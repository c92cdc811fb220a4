"""Embeddings to a cluster tree with balanced quotas.

Vectors never leave the executors.  What reaches the driver and travels back
with the tasks is a matrix of centroids, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.seeded import seeded_hash
from gristmill.operators.joins import BROADCAST_ROWS, bounded

MAX_CENTROID_BYTES = 256 << 20
# Distances that a task holds at a time, for one batch of vectors.
TILE_DISTANCES = 4 << 20


def embed(docs: DataFrame, embedder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """B1: ``text`` to ``embedding ARRAY<FLOAT>``; the model is built once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vectors), dtype=object)

    # Marked so that a filter on the result does not run the model twice.
    return docs.withColumn("embedding", run.asNondeterministic()(F.col("text"))).drop("text")


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def _nearest(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (ties: lowest) and the squared distance.

    The centres are taken in tiles with a running least, so that memory does not grow
    with vectors times centres.
    """
    rows = np.arange(len(vectors))
    best = np.zeros(len(vectors), dtype=np.int64)
    least = np.full(len(vectors), np.inf)
    norms = (centers**2).sum(axis=1)
    tile = max(1, TILE_DISTANCES // max(len(vectors), 1))
    for begin in range(0, len(centers), tile):
        part = slice(begin, begin + tile)
        scores = norms[part] - 2.0 * (vectors @ centers[part].T)
        found = scores.argmin(axis=1)
        here = scores[rows, found]
        closer = here < least
        best[closer] = begin + found[closer]
        least[closer] = here[closer]
    return best, np.maximum(least + (vectors**2).sum(axis=1), 0.0)


def check_centers(centers: np.ndarray) -> np.ndarray:
    centers = np.ascontiguousarray(centers, dtype=np.float64)
    if centers.ndim != 2 or not len(centers):
        raise ValueError("centers must be a non-empty matrix")
    if centers.nbytes > MAX_CENTROID_BYTES:
        raise ValueError(
            f"{len(centers)} centroids are too many to send to every task; "
            "cluster coarsely first and split each cluster"
        )
    return centers


def assign(
    points: DataFrame,
    centers: np.ndarray,
    vector: str = "embedding",
    out: str = "cluster",
    distance: str | None = None,
) -> DataFrame:
    """Nearest centroid of each vector.  Map-only."""
    centers = check_centers(centers)

    @F.arrow_udf("struct<cluster:int,distance:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        best, squared = _nearest(_matrix(vectors), centers)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(np.int32)), pa.array(np.sqrt(squared))], ["cluster", "distance"]
        )

    # Marked so that the optimizer does not evaluate it once more for a filter.
    found = points.withColumn("__near", nearest.asNondeterministic()(F.col(vector)))
    found = found.withColumn(out, F.col("__near.cluster"))
    if distance:
        found = found.withColumn(distance, F.col("__near.distance"))
    return found.drop("__near")


PARTIAL_SUMS = "cluster int, n bigint, sums array<double>"


def _sums_batch(clusters: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """One row per cluster that has vectors."""
    ends = np.arange(len(clusters) + 1, dtype=np.int32) * sums.shape[1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(clusters.astype(np.int32)),
            pa.array(counts[clusters]),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums[clusters].ravel())),
        ],
        ["cluster", "n", "sums"],
    )


def _add_by_cluster(sums: np.ndarray, counts: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> None:
    order = own.argsort(kind="stable")
    seen, firsts = np.unique(own[order], return_index=True)
    sums[seen] += np.add.reduceat(vectors[order], firsts, axis=0)
    counts += np.bincount(own, minlength=len(counts))


def lloyd_step(points: DataFrame, centers: np.ndarray, vector: str = "embedding") -> np.ndarray:
    """One k-means update; an empty cluster keeps its centre.

    Each task sums its own vectors per cluster and emits at most one row per
    cluster, so a cluster holding most of the vectors costs no more to merge
    than any other.  The rows, whole sums as arrays, meet by cluster and are
    added as they stream by.
    """
    centers = check_centers(centers)
    k, dim = centers.shape

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim))
        counts = np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0))
            _add_by_cluster(sums, counts, _nearest(vectors, centers)[0], vectors)
        yield _sums_batch(np.flatnonzero(counts), counts, sums)

    return merged_means(points.select(vector).mapInArrow(partial_sums, PARTIAL_SUMS), centers)


def merged_means(partial: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Centroids from rows (cluster, n, sums) of any number of tasks."""
    k, dim = centers.shape

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim))
        counts = np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(0).to_numpy()
            np.add.at(counts, cluster, batch.column(1).to_numpy())
            np.add.at(sums, cluster, _matrix(batch.column(2)))
        yield _sums_batch(np.flatnonzero(counts), counts, sums)

    # At most k rows, as arrays: the size was checked before.
    found = partial.repartition("cluster").mapInArrow(merge, PARTIAL_SUMS).toArrow()
    updated = centers.copy()
    if found.num_rows:
        counts = found["n"].to_numpy()
        updated[found["cluster"].to_numpy()] = _matrix(found["sums"]) / counts[:, None]
    return updated


def lloyd(points: DataFrame, centers: np.ndarray, steps: int, vector: str = "embedding") -> np.ndarray:
    """B2 from given starting centroids.  Only the centroids pass from step to
    step, so the lineage does not grow."""
    for _ in range(steps):
        centers = lloyd_step(points, centers, vector)
    return centers


def first_vectors(points: DataFrame, k: int, seed: int, key: str, vector: str = "embedding") -> np.ndarray:
    """Starting centroids: the first ``k`` different vectors in seeded order.

    A top-n by hash is cheap; it is widened while copies crowd the front.  Only
    if a bounded number of rows does not show ``k`` different vectors is the
    whole column deduplicated, which gives the same vectors.  Fewer than ``k``
    different vectors are an error.
    """
    hashed = points.select(vector, seeded_hash(seed, key).alias("h"))

    def distinct(rows: pa.Table) -> np.ndarray:
        """Different vectors, each where it first stands."""
        matrix = _matrix(rows[vector]) if rows.num_rows else np.zeros((0, 1))
        return matrix[np.sort(np.unique(matrix, axis=0, return_index=True)[1])]

    wanted = 2 * k
    while True:
        rows = hashed.orderBy("h").limit(wanted).toArrow()
        found = distinct(rows)
        if len(found) >= k or rows.num_rows < wanted:
            break
        wanted *= 4
        if wanted * found.shape[1] * 8 > MAX_CENTROID_BYTES:
            firsts = hashed.groupBy(vector).agg(F.min("h").alias("h"))
            found = distinct(firsts.orderBy("h").limit(k).toArrow())
            break
    if len(found) < k:
        raise ValueError(f"{k} centroids were asked for, but there are only {len(found)} different vectors")
    return check_centers(found[:k])


def fit_kmeans(points: DataFrame, k: int, seed: int, max_iter: int = 20, vector: str = "embedding") -> np.ndarray:
    """B2 in production: parallel initialisation and Lloyd steps of Spark ML."""
    vectors = points.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(vectors)
    return check_centers(np.array(model.clusterCenters()))


@dataclass(frozen=True)
class ClusterTree:
    """Centroids per level (finest first) and each cluster's parent one level up."""

    centers: list[np.ndarray]
    parents: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.centers)

    def paths(self, spark: SparkSession) -> DataFrame:
        """One row per finest cluster with its ancestors: ``c1, c2, ...``."""
        path = [np.arange(len(self.centers[0]))]
        for parent in self.parents:
            path.append(parent[path[-1]])
        table = pa.table({f"c{i + 1}": level.astype(np.int32) for i, level in enumerate(path)})
        return spark.createDataFrame(table)


def build_tree(
    points: DataFrame,
    ks: Sequence[int],
    fit: Callable[[DataFrame, int], np.ndarray],
    vector: str = "embedding",
) -> ClusterTree:
    """Cluster the vectors, then the centroids of each level in turn.

    ``fit(points, k)`` returns centroids; upper levels hand it a DataFrame
    ``(id, embedding)`` of the centroids below, whose number is bounded.
    """
    if ks[0] > BROADCAST_ROWS:
        raise ValueError(f"at most {BROADCAST_ROWS} finest clusters are supported")
    if any(above >= below for below, above in zip(ks, ks[1:])):
        raise ValueError("each level must have fewer clusters than the one below")
    spark = points.sparkSession
    centers = [fit(points, ks[0])]
    parents: list[np.ndarray] = []
    for k in ks[1:]:
        below = centers[-1]
        ends = np.arange(len(below) + 1, dtype=np.int32) * below.shape[1]
        rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(below).ravel()))
        level = spark.createDataFrame(pa.table({"id": np.arange(len(below)), vector: rows}))
        above = fit(level, k)
        parents.append(_nearest(below, above)[0])
        centers.append(above)
    return ClusterTree(centers, parents)


def assign_tree(points: DataFrame, tree: ClusterTree, vector: str = "embedding", distance: str | None = None) -> DataFrame:
    """B4 on a hierarchy: ``c1`` by distance, the ancestors by the tree."""
    leaves = assign(points, tree.centers[0], vector, "c1", distance)
    if tree.depth == 1:
        return leaves
    paths = tree.paths(points.sparkSession)
    return leaves.join(bounded(paths, len(tree.centers[0])), "c1")


def cluster_profile(assigned: DataFrame, levels: Sequence[str], tokens: str = "n_tokens") -> DataFrame:
    """Documents and tokens per cluster of every level, with shares.

    ``imbalance`` is the cluster's size over the mean size at its level.  The
    documents are aggregated once, by their full path.
    """
    paths = assigned.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")
    )
    per_level = F.explode(
        F.array(
            *[
                F.struct(F.lit(i + 1).alias("level"), F.col(name).alias("cluster"))
                for i, name in enumerate(levels)
            ]
        )
    )
    sizes = (
        paths.select("docs", "tokens", per_level.alias("at"))
        .groupBy("at.level", "at.cluster")
        .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    )
    level = Window.partitionBy("level")
    return (
        sizes.withColumn("doc_share", F.col("docs") / F.sum("docs").over(level))
        .withColumn("token_share", F.col("tokens") / F.sum("tokens").over(level))
        .withColumn("imbalance", F.col("docs") / F.avg("docs").over(level))
    )


def _capped(sizes: DataFrame) -> DataFrame:
    """Give each row of (parent, cluster, size, budget) its ``quota``.

    With children sorted by size, sum(min(cap, size)) is linear between two
    sizes.  The cap lies on the first stretch that reaches the budget; of its
    two neighbouring integers the closer one is taken, the smaller on a tie.
    Stretches come from how many clusters have each size, so the windows hold a
    parent's different sizes and not its clusters.
    """
    counted = sizes.groupBy("parent", "size").agg(F.count(F.lit(1)).alias("n"), F.max("budget").alias("budget"))
    ordered = Window.partitionBy("parent").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    smaller = lambda x: F.coalesce(F.sum(x).over(ordered), F.lit(0))
    left = F.sum("n").over(Window.partitionBy("parent")) - smaller(F.col("n"))
    stretches = counted.select(
        "parent", "size", "budget", smaller(F.col("size") * F.col("n")).alias("below"), left.alias("left")
    )
    low = F.expr("(budget - below) div left")
    low_total = F.col("below") + F.col("left") * low
    cap = F.when(F.col("budget") - low_total <= low_total + F.col("left") - F.col("budget"), low).otherwise(low + 1)
    # Later stretches reach the budget too; the first one has the least size.
    reached = F.col("below") + F.col("left") * F.col("size") >= F.col("budget")
    caps = stretches.groupBy("parent").agg(
        F.coalesce(F.min_by(cap, F.when(reached, F.col("size"))), F.max("size")).alias("cap")
    )
    # A row for each parent; where they are few Spark sends them to the clusters.
    return sizes.join(caps, "parent").withColumn("quota", F.least("cap", "size")).drop("cap")


def allocate(assigned: DataFrame, levels: Sequence[str], target: Column | int) -> DataFrame:
    """Split ``target`` documents over the clusters, coarsest level first.

    ``levels`` names the path columns finest first.  Returns one row per
    finest cluster: its path, ``size`` and ``quota``.  ``target`` may be an
    expression over ``total``, the number of documents.  All windows run over
    the table of clusters.
    """
    leaves = assigned.groupBy(*levels).agg(F.count(F.lit(1)).alias("size"))
    tree = leaves.withColumn("total", leaves.agg(F.sum("size")).scalar())
    budget = F.lit(target) if isinstance(target, int) else target
    tree = tree.withColumn("budget", budget.cast("bigint")).drop("total")
    above: list[str] = []
    for name in reversed(levels):
        here = [*above, name]
        sizes = tree.groupBy(*here).agg(F.sum("size").alias("size"), F.max("budget").alias("budget"))
        parent = F.struct(*above) if above else F.lit(0)
        quotas = _capped(sizes.withColumn("parent", parent).withColumn("cluster", F.col(name)))
        quotas = quotas.select(*here, F.col("quota").alias("budget"))
        tree = tree.drop("budget").join(quotas, here)
        above = here
    return tree.withColumnRenamed("budget", "quota")
