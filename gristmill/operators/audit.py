"""Packed-shard audit, token accounting and budget comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.reading import FILES_PER_BUFFER

# Fixed values of the packed file format.
MAGIC = "LITPKDS"
VERSION = 1
HEADER_BYTES = 24
DTYPE_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 4, 7: 8, 8: 2}


def dtype_width(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DTYPE_WIDTH.items() for x in pair])
    return F.try_element_at(table, code)


def audit_shards(headers: DataFrame) -> DataFrame:
    """Add ``status`` and ``usable`` to file headers.

    ``headers`` holds ``path, magic, version, dtype_code, chunk_size, length``.
    Every file is compared with the first one in path order.  ``usable`` follows
    the counter, which does not look at the version; only the reader rejects a
    wrong one, so that has a status of its own.
    """
    widths = headers.withColumn("width", dtype_width(F.col("dtype_code").cast("int")))
    first = widths.agg(F.min_by(F.struct("magic", "chunk_size", "width"), "path")).scalar()
    same = (F.col("chunk_size") == F.col("first.chunk_size")) & (F.col("width") == F.col("first.width"))
    expected = F.lit(HEADER_BYTES) + F.col("chunk_size") * F.col("width")
    status = (
        F.when(~F.col("first.magic").eqNullSafe(MAGIC), "bad_first_file")
        .when(F.col("first.width").isNull(), "bad_first_file")
        .when(F.col("magic").isNull(), "unreadable_header")
        .when(F.col("magic") != MAGIC, "bad_magic")
        .when(F.col("width").isNull(), "unknown_dtype")
        .when(~same, "header_differs")
        .when(F.col("length") != expected, "bad_size")
        .when(F.col("version") != VERSION, "bad_version")
        .otherwise("ok")
    )
    return (
        widths.withColumn("first", first)
        .withColumn("status", status)
        .withColumn("usable", F.col("status").isin("ok", "bad_version"))
        .drop("first", "width")
    )


def token_accounting(
    files: DataFrame,
    block_size: int,
    micro_batch: int,
    grad_accum: int,
    world_size: int,
    workers: int,
    buffer_files: int = FILES_PER_BUFFER,
) -> DataFrame:
    """One row of totals for files with a ``chunk_size``.

    ``total_raw_tokens`` counts kept files only.  ``max_steps_nominal`` counts
    every kept block, ``max_steps_reachable`` only those a single pass reads.
    """
    readers = world_size * workers
    per_step = micro_batch * grad_accum * world_size
    totals = files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.min("chunk_size"), F.lit(0)).cast("bigint").alias("chunk_size"),
    )
    steps = [
        ("usable_files", f"total_files div {readers} * {readers}"),
        ("dropped_files", "total_files - usable_files"),
        ("blocks_per_file", f"chunk_size div {block_size + 1}"),
        ("total_blocks", "usable_files * blocks_per_file"),
        ("total_raw_tokens", "usable_files * chunk_size"),
        ("total_supervised_tokens", f"total_blocks * {block_size}"),
        ("tokens_per_step", f"cast({per_step * block_size} as bigint)"),
        ("max_steps_nominal", f"total_blocks div {per_step}"),
        ("leftover_blocks", f"total_blocks % {per_step}"),
        (
            "reachable_files",
            f"total_files div {readers} div {buffer_files} * {buffer_files} * {readers}",
        ),
        ("max_steps_reachable", f"reachable_files * blocks_per_file div {per_step}"),
    ]
    for name, rule in steps:
        totals = totals.withColumn(name, F.expr(rule))
    return totals


def compare_budget(accounts: DataFrame, planned_steps: int | str) -> DataFrame:
    """C14: planned steps against one pass; the percentage is relative to the pass."""
    planned = F.col(planned_steps) if isinstance(planned_steps, str) else F.lit(planned_steps)
    pass_steps = F.col("max_steps_nominal")
    verdict = (
        F.when(pass_steps < planned, "repeats_data")
        .when(pass_steps > planned, "leaves_data")
        .otherwise("exact")
    )
    percent = F.when(pass_steps > 0, F.abs(planned - pass_steps) / pass_steps * F.lit(100.0))
    return accounts.select(
        pass_steps.alias("pass_steps"),
        planned.cast("bigint").alias("planned_steps"),
        verdict.alias("verdict"),
        percent.alias("percent"),
    )
