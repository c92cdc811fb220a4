"""Lookup join that keeps frequent keys out of single tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of at most this many short rows may be sent to every executor.
BROADCAST_ROWS = 1 << 20
# Rows of one key that may meet in one task.
ROWS_PER_KEY = 1 << 20
# Keys that may be told apart as frequent, and rows of one key that are never divided.
KEYS_APART = 4096
LEAST_PART = 64


def bounded(table: DataFrame, max_rows: int) -> DataFrame:
    """Mark a table for broadcast if its proven row bound allows it; else leave it to Spark."""
    return F.broadcast(table) if max_rows <= BROADCAST_ROWS else table


def copies_for(heaviest: Column, rows_per_key: int = ROWS_PER_KEY) -> Column:
    """Parts that a key with ``heaviest`` rows is divided into."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(heaviest, F.lit(0)) / F.lit(rows_per_key))).cast("int")


def salted_lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], copies: str, spread: Sequence[str]
) -> DataFrame:
    """Left join of ``rows`` to a table with unique keys, the same plan at every size.

    Both sides carry ``copies``, equal on matching keys (``copies_for``).  A row goes to
    one of that many parts by a hash of its ``spread`` columns; the table's row is
    repeated in each.  ``copies`` is left out of the result.
    """
    keys = list(keys)
    part = "__part"
    salted = rows.withColumn(part, F.pmod(F.xxhash64(*spread), F.col(copies)).cast("int")).drop(copies)
    every = F.explode(F.sequence(F.lit(0), F.col(copies) - 1))
    repeated = table.withColumn(part, every).drop(copies)
    return salted.join(repeated, [*keys, part], "left").drop(part)


def weighted_lookup(
    rows: DataFrame, table: DataFrame, key: str, count: str, total: int, spread: Sequence[str],
    keys_apart: int = KEYS_APART, least_rows: int = LEAST_PART,
) -> DataFrame:
    """Inner join of ``rows`` to a table of unique keys that says how many rows each key has.

    ``total`` is at least the number of rows.  A key with more than its part of them, a
    ``keys_apart``-th, is divided, and its rows go to one part by a hash of ``spread``.
    At most ``keys_apart`` keys can be so frequent: their list is broadcast, all other rows
    are dealt by key alone.  ``count`` is left out of the result; null keys match nothing.
    """
    part = max(least_rows, -(-total // keys_apart))
    copies = "__copies"
    divided = F.ceil(F.col(count) / F.lit(part)).cast("int").alias(copies)
    frequent = table.filter(F.col(count) > part).select(key, divided)
    marked = rows.join(F.broadcast(frequent), key, "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    weighed = table.select(*[c for c in table.columns if c != count], F.greatest(F.lit(1), divided).alias(copies))
    # The left join of the lookup keeps rows without a match, which an inner one drops.
    found = salted_lookup(marked, weighed.withColumn("__found", F.lit(True)), [key], copies, spread)
    return found.filter("__found").drop("__found")
