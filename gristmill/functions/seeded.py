"""Seeded, engine-independent pseudo-random order and draws.

``rand()`` and friends depend on how rows fall into partitions, so a retried
task could reorder them.  An md5 of ``seed:id`` depends only on the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *ids: Column | str) -> Column:
    """32 hex digits that order rows pseudo-randomly for ``seed``."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def hex_prefix(hash_col: Column | str, digits: int) -> Column:
    """The first hex digits as BIGINT: a bucket number that follows hash order."""
    col = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("bigint")


def unit_draw(hash_col: Column | str) -> Column:
    """A uniform DOUBLE in [0, 1) taken from the first 32 bits of the hash."""
    return hex_prefix(hash_col, 8).cast("double") / F.lit(float(2**32))
