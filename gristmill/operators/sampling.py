"""Subsets of a corpus: balanced, random, repeated, mixed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.seeded import hex_prefix, seeded_hash, unit_draw
from gristmill.operators.joins import bounded
from gristmill.operators.running import ROWS_PER_BUCKET, row_rank, running_total, value_buckets
from gristmill.operators.staging import stage

# Hex digits of the hash that number its buckets, at least.
PREFIX_DIGITS = 3
LAPS_PER_COPY = 1000


def _prefix_digits(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """So many that a bucket has about ``rows_per_bucket`` rows at most."""
    wanted, digits = -(-rows.count() // rows_per_bucket), PREFIX_DIGITS
    while 16**digits < wanted:
        digits += 1
    return digits


def balanced_sample(
    assigned: DataFrame,
    quotas: DataFrame,
    levels: Sequence[str],
    key: str,
    seed: int,
    order: str = "random",
    distance: str = "distance",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Take ``quota`` rows of every leaf, in seeded order or nearest first.

    Ranks come from counts per (leaf, hash prefix), so a leaf that holds most of
    the corpus is ranked by thousands of tasks.  ``order='nearest'`` orders by
    the distance itself, equal ones in seeded order.  Its buckets are quantiles of
    the distance over the corpus; a distance that many rows share has a bucket of
    its own, which the hash divides.
    """
    hashed = assigned.withColumn("__h", seeded_hash(seed, key))
    if order == "random":
        hashed = hashed.withColumn("__b", hex_prefix("__h", PREFIX_DIGITS))
        ordering = ["__h", key]
    elif order == "nearest":
        hashed = value_buckets(hashed, distance, rows_per_bucket, "__b", hex_prefix("__h", 2), 256)
        ordering = [distance, "__h", key]
    else:
        raise ValueError(f"order must be 'random' or 'nearest', got {order!r}")
    ranked = row_rank(hashed, list(levels), "__b", ordering, "__rank")
    # One row per leaf, sent to the rows if they are few enough.
    limits = stage(quotas.select(*levels, "quota"), "quotas")
    limits = bounded(limits, limits.count())
    chosen = ranked.join(limits, list(levels)).filter("__rank < quota")
    return chosen.drop("__h", "__b", "__rank", "quota")


def random_subset(
    docs: DataFrame, budget: Column | int, key: str, seed: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Documents in seeded order while their tokens fit into ``budget``.

    ``budget`` may use ``all_tokens``, or be a scalar subquery such as the token
    count of a curated subset.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    hashed = docs.withColumn("__h", seeded_hash(seed, key))
    digits = _prefix_digits(docs, rows_per_bucket)
    hashed = hashed.withColumn("__b", hex_prefix("__h", digits))
    summed = running_total(
        hashed, [], "__b", ["__h", key], F.col("n_tokens"), start="__start", total="all_tokens",
        max_keys=16**digits, buckets=16**digits,
    )
    return summed.filter(F.col("__start") + F.col("n_tokens") <= limit).drop(
        "__h", "__b", "__start", "all_tokens"
    )


def repeat_subset(
    docs: DataFrame, budget: Column | int, key: str, seed: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Whole passes over the subset, then a seeded part of one more.

    Adds ``pass_no``.  Every pass has its own order, so the partial pass is a
    random subset of its own; a document is copied once per pass it is read in.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    hashed = docs.withColumn("__h", seeded_hash(seed, key))
    digits = _prefix_digits(docs, rows_per_bucket)
    hashed = hashed.withColumn("__b", hex_prefix("__h", digits))
    summed = running_total(
        hashed, [], "__b", ["__h", key], F.col("n_tokens"), start="__start", total="all_tokens",
        max_keys=16**digits, buckets=16**digits,
    )
    summed = summed.withColumn("__budget", limit.cast("bigint"))
    whole = F.expr("__budget div all_tokens")
    left = F.col("__budget") - whole * F.col("all_tokens")
    last = F.when(F.col("__start") + F.col("n_tokens") <= left, whole).otherwise(whole - 1)
    passes = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    return (
        summed.withColumn("pass_no", F.explode(passes))
        .drop("__h", "__b", "__start", "__budget", "all_tokens")
    )


def mixture(
    items: DataFrame,
    weights: Mapping[str, float] | Sequence[str],
    n_draws: int,
    key: str,
    seed: int,
    source: str = "source",
    rows_per_bucket: int = 100_000,
) -> DataFrame:
    """``n_draws`` draws; each picks a source by weight and takes its next item.

    A list of sources means equal weights.  An exhausted source starts again.
    Returns ``draw_id``, source, ``lap`` and the item's columns.
    """
    if not isinstance(weights, Mapping):
        weights = {name: 1.0 / len(weights) for name in weights}
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    mass = float(sum(weights.values()))
    names = list(weights)
    edge = 0.0
    pick = None
    draw = unit_draw(seeded_hash(seed, F.lit("draw"), "draw_id"))
    for name in names[:-1]:
        edge += weights[name]
        inside = F.col("__u") < F.lit(edge / mass)
        pick = F.when(inside, name) if pick is None else pick.when(inside, name)
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])
    draws = (
        items.sparkSession.range(n_draws)
        .withColumnRenamed("id", "draw_id")
        .withColumn("__u", draw)
        .withColumn(source, pick)
        .withColumn("__b", F.expr(f"draw_id div {rows_per_bucket}"))
    )
    draws = row_rank(draws, [source], "__b", ["draw_id"], "__k").drop("__b", "__u")
    hashed = items.filter(F.col(source).isin(names)).withColumn("__h", seeded_hash(seed, key))
    hashed = hashed.withColumn("__b", hex_prefix("__h", PREFIX_DIGITS))
    ranked = row_rank(hashed, [source], "__b", ["__h", key], "__slot", "__n_items").drop("__h", "__b")
    sizes = items.filter(F.col(source).isin(names)).groupBy(source).agg(F.count(F.lit(1)).alias("__size"))
    wanted = draws.groupBy(source).agg(F.count(F.lit(1)).alias("__drawn"))
    drawn = draws.join(bounded(sizes, len(names)), source)
    drawn = (
        drawn.withColumn("__slot", F.col("__k") % F.col("__size"))
        .withColumn("lap", F.expr("__k div __size"))
        .withColumn("__copy", F.expr(f"lap div {LAPS_PER_COPY}"))
        .drop("__k", "__size")
    )
    # A tiny source drawn very often would make its items hot join keys; each
    # copy of an item serves LAPS_PER_COPY laps.
    last_copy = F.expr(f"(__drawn - 1) div __n_items div {LAPS_PER_COPY}")
    copies = (
        ranked.join(bounded(wanted, len(names)), source)
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last_copy)))
        .drop("__drawn", "__n_items")
    )
    return drawn.join(copies, [source, "__slot", "__copy"]).drop("__slot", "__copy")
