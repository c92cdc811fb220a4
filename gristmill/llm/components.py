"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.joins import weighted_lookup
from gristmill.operators.staging import stage

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest of each node and its neighbours, and the node's rows."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def _with_smallest(edges: DataFrame, total: int) -> DataFrame:
    """Edges with the smallest of ``u``; a node with many of the ``total`` edges is divided."""
    return weighted_lookup(edges, _smallest(edges), "u", "n", total, ["v"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both, 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _with_smallest(down, total).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(_smallest(down).select("u", F.col("m").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; root is the smallest node reached.

    ``edges`` has two long columns ``u``, ``v``, in any direction and repeated at will;
    loops and nulls are left out.  Each round is two joins with per-node minima, which
    are pre-aggregated, written to the shared folder; only a count and a checksum reach
    the driver.  A node with many of the edges, such as the root of a large component, is
    divided in these joins.
    """
    now = stage(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        following = stage(_small_star(_large_star(now, seen[0]), seen[0]).filter("u <> v").distinct(), "edges")
        digest = _digest(following)
        now = following
        if digest == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = digest
    if seen[0]:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
