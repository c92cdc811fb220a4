"""Vectors of an array column as matrices, and the best rows of each group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a group that are ranked before the group is.
PARTS = 64


def matrices(column: pa.Array, below: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double entries of the usable vectors, a matrix for each length.

    Usable are vectors with entries, none of them null, not finite or of ``below`` or
    more in size.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    with np.errstate(invalid="ignore"):
        wrong = np.concatenate([[0], np.cumsum(~(np.abs(flat) < below))])
    usable = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    for n in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == n))
        yield rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def best_of(rows: DataFrame, group: str, order: Sequence[Column], k: int, spread: Sequence[str]) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1.

    Ranked in parts first, chosen by a hash of the ``spread`` columns, so no task gets
    a whole group.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(PARTS))
    few = rows.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    )
    some = few.filter(F.col("rank") <= k).drop("rank", "part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
