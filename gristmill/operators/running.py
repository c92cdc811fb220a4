"""Running totals, ranks and sliding windows that never need one big task.

A window without PARTITION BY, or one partitioned by a key that holds a third
of the rows, sorts all those rows in a single task.  Every ordered computation
of the package goes through this module instead: the order is first cut into
buckets, each bucket is summed (map-side combined), the bucket sums are
accumulated, and only then is a window run *inside* each bucket.  Buckets are a
tree: a bucket with too many rows is cut again, and where there are more than a
few thousand sums they are added up by the bucket above first.  So neither a
bucket nor a window grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.joins import bounded
from gristmill.operators.staging import stage

# Buckets of the first cut, and sums that one window accumulates.
FANOUT = 4096
# Parts of a bucket that is cut again.
BRANCH = 64
ROWS_PER_BUCKET = 200_000
SPAN = 100_000


def range_splits(
    df: DataFrame,
    key: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = FANOUT,
) -> list[float]:
    """Cut points that spread the rows of ``df`` evenly over ranges of ``key``.

    A count, then one pass over that single column; fewer than ``max_buckets``
    numbers reach the driver.  Quantiles, not equal widths, so clumped ids do
    not make a hot bucket.
    """
    wanted = min(max_buckets, -(-df.count() // rows_per_bucket))
    if wanted <= 1:
        return []
    number = df.select(F.col(key).cast("double").alias("k"))
    grid = [i / wanted for i in range(1, wanted)]
    return sorted(set(number.approxQuantile("k", grid, 1 / (8 * wanted))))


@dataclass(frozen=True)
class Cuts:
    """Cut points of a key: of the whole range, then of every bucket, level by level."""

    first: list[float]
    deeper: tuple[DataFrame, ...] = ()
    fanout: int = FANOUT
    branch: int = BRANCH

    @property
    def buckets(self) -> int:
        """Bucket numbers are below this."""
        return (len(self.first) + 2) * self.branch ** len(self.deeper)


def range_cuts(
    df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET, fanout: int = FANOUT, branch: int = BRANCH
) -> Cuts:
    """Cuts that leave about ``rows_per_bucket`` rows in a bucket, however many rows there are.

    Quantiles of the whole column give the first ``fanout`` buckets; while that is not
    enough, quantiles inside each bucket cut it in ``branch`` parts.  These stay in
    written tables, a row for each bucket of the level above.
    """
    wanted = -(-df.count() // rows_per_bucket)
    cuts = Cuts(range_splits(df, key, rows_per_bucket, fanout), (), fanout, branch)
    reached = fanout
    grid = F.array(*[F.lit(i / branch) for i in range(1, branch)])
    while wanted > reached:
        number = F.col(key).cast("double")
        inside = with_bucket(df.select(key), key, cuts).groupBy("bucket")
        table = inside.agg(F.percentile_approx(number, grid, 16 * branch).alias("cuts"))
        cuts = Cuts(cuts.first, (*cuts.deeper, stage(table, "cuts")), fanout, branch)
        reached *= branch
    return cuts


def with_bucket(df: DataFrame, key: str, splits: Sequence[float] | Cuts, out: str = "bucket") -> DataFrame:
    """Add the range number of ``key``; a non-decreasing function of the key."""
    cuts = splits if isinstance(splits, Cuts) else Cuts(list(splits))
    # A missing key sorts first, as in ORDER BY ... ASC.
    number = "__key"
    keyed = df.withColumn(number, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    if cuts.first:
        cut = Bucketizer(
            splits=[float("-inf"), *cuts.first, float("inf")],
            inputCol=number,
            outputCol=out,
            handleInvalid="keep",
        )
        keyed = cut.transform(keyed).withColumn(out, F.col(out).cast("bigint"))
    else:
        keyed = keyed.withColumn(out, F.lit(0).cast("bigint"))
    for level, table in enumerate(cuts.deeper):
        known = bounded(table.withColumnsRenamed({"bucket": out, "cuts": "__cuts"}), cuts.buckets // cuts.branch ** (len(cuts.deeper) - level))
        below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c <= F.col(number)))
        keyed = keyed.join(known, out, "left").withColumn(out, F.col(out) * cuts.branch + below).drop("__cuts")
    return keyed.select(*[c for c in df.columns if c != out], out)


def value_buckets(df: DataFrame, key: str, rows_per_bucket: int, out: str, among_equals: Column, parts: int) -> DataFrame:
    """Add buckets that follow ORDER BY ``key``, then ``among_equals`` (0 to ``parts`` - 1).

    A key that holds more rows than a bucket is one of the quantiles.  Each quantile
    is a bucket of its own, so equal keys are divided and all others keep their order.
    """
    edges: list[float] = []
    for cut in range_splits(df, key, rows_per_bucket):
        if not edges or cut > edges[-1]:
            edges += [cut, math.nextafter(cut, math.inf)]
    cut_up = with_bucket(df, key, edges, out)
    # The buckets with odd numbers hold one key each.
    inside = F.when(F.col(out) % 2 == 1, among_equals.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return cut_up.withColumn(out, F.col(out) * parts + inside)


def _bases(
    sums: DataFrame, groups: Sequence[str], bucket: str, total: str | None, least: Sequence[str],
    buckets: int | None, fanout: int,
) -> DataFrame:
    """Sum over the group's earlier buckets, and what holds for the whole group.

    No window gets more than ``fanout`` buckets of a group: with more of them the sums
    of ``fanout`` neighbours are accumulated first, by the same rule.
    """
    carried = [*([total] if total else []), *least]
    if buckets is None or buckets <= fanout:
        before, whole = Window.partitionBy(*groups).orderBy(bucket), Window.partitionBy(*groups)
        parts = [(F.sum("__rt_sum").over(before) - F.col("__rt_sum")).alias("__rt_before")]
        if total:
            parts.append(F.sum("__rt_sum").over(whole).alias(total))
        parts += [F.min(name).over(whole).alias(name) for name in least]
        return sums.select(*groups, bucket, *parts)
    above = f"__above{bucket}"
    placed = sums.withColumn(above, F.floor(F.col(bucket) / fanout).cast("bigint"))
    upper = placed.groupBy(*groups, above).agg(
        F.sum("__rt_sum").alias("__rt_sum"), *[F.min(name).alias(name) for name in least]
    )
    upper = _bases(upper, groups, above, total, least, -(-buckets // fanout), fanout)
    inside = F.sum("__rt_sum").over(Window.partitionBy(*groups, above).orderBy(bucket)) - F.col("__rt_sum")
    own = placed.select(*groups, above, bucket, inside.alias("__rt_inside"))
    start = (F.col("__rt_before") + F.col("__rt_inside")).alias("__rt_before")
    return own.join(upper, [*groups, above]).select(*groups, bucket, start, *carried)


def running_total(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    value: Column | None = None,
    start: str = "start",
    total: str | None = None,
    max_keys: int | None = None,
    least: Mapping[str, str] | None = None,
    buckets: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, the row itself excluded.

    ``bucket`` must not decrease along ``order``; groups and buckets must not be
    null.  ``total`` names an optional column with the sum over the whole group.
    ``max_keys`` is a proven bound on the number of (group, bucket) pairs; when it
    is small the bucket sums are broadcast and the rows stay where they are.
    ``least`` names further columns with the group's smallest value of a column;
    the bucket sums carry them, so no join by group alone is needed.  ``buckets`` bounds
    the bucket numbers; if they may exceed ``fanout``, the sums are accumulated in levels.
    """
    least = least or {}
    keys = [*groups, bucket]
    rows = df.withColumn("__rt_value", F.lit(1).cast("bigint") if value is None else value)
    sums = rows.groupBy(*keys).agg(
        F.sum("__rt_value").alias("__rt_sum"), *[F.min(column).alias(name) for name, column in least.items()]
    )
    bases = _bases(sums, groups, bucket, total, list(least), buckets, fanout)
    if max_keys is not None:
        bases = bounded(bases, max_keys)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("__rt_upto", F.sum("__rt_value").over(inside))
        .join(bases, keys)
        .withColumn(start, F.col("__rt_before") + F.col("__rt_upto") - F.col("__rt_value"))
        .drop("__rt_value", "__rt_upto", "__rt_before")
    )


def row_rank(
    df: DataFrame,
    groups: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    out: str = "rank",
    total: str | None = None,
    max_keys: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """0-based position of each row in its group; optionally the group's size."""
    return running_total(df, groups, bucket, order, None, out, total, max_keys, buckets=buckets)


def with_halo(df: DataFrame, rank: str, reach: int, span: int = SPAN) -> DataFrame:
    """Cut a ranked series into spans, repeating ``reach`` rows in front of each.

    Windows then run PARTITION BY (..., span) and still see every earlier row
    they need; rows with ``halo`` set are only context and are dropped after.
    """
    if not 0 <= reach < span:
        raise ValueError(f"reach must be in [0, {span}), got {reach}")
    own = F.floor(F.col(rank) / span).cast("bigint")
    near_end = F.col(rank) % span >= span - reach
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", F.explode(homes).alias("span")).withColumn("halo", F.col("span") != own)
