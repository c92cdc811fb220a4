"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


_area: ContextVar[str | None] = ContextVar("area", default=None)


@cache
def _local_dir() -> tempfile.TemporaryDirectory:
    """Kept until the interpreter ends."""
    return tempfile.TemporaryDirectory(prefix="gristmill-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, falls back
    to a folder of its own.
    """
    area = _area.get()
    if area:
        return area
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir().name


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all that is staged inside the block; it goes at the end,
    so results must be written or collected by then."""
    folder = f"{shared_dir(spark).rstrip('/')}/area-{uuid.uuid4().hex}"
    before = _area.set(folder)
    try:
        yield folder
    finally:
        _area.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    ``row_group`` is the most rows of a row group, for wide rows: Parquet looks at bytes
    only every hundred rows, and readers decode a row group of few rows as one batch.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write if row_group is None else df.write.option("parquet.block.row.count.limit", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of what runs inside the block close at ``most`` bytes, or hold one row."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)
