"""How packed files reach readers: assignment, order, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.seeded import hex_prefix, seeded_hash
from gristmill.operators.running import row_rank

# Fixed values.
FILES_PER_BUFFER = 8

READ = "read"
UNREAD_TAIL = "unread_tail"
DROPPED = "dropped"
TOO_FEW_FILES = "too_few_files"


def chunk_file_name(prefix: str = "shard") -> Column:
    """Name of a chunk's file: prefix, shard, and a ten-digit counter."""
    return F.format_string(f"{prefix}-%05d_%010d.bin", "shard", "chunk_no")


def reader_assignment(files: DataFrame, seed: int, world_size: int, workers: int) -> DataFrame:
    """Seeded order of the file names, dealt out to ``world_size * workers`` readers.

    Adds ``file_rank``, ``n_files``, ``kept``, ``reader``, ``slot``, ``gpu_rank``
    and ``worker``.  Files that do not fill a round over all readers are not
    kept.  The ranking is bucketed by hash prefix: no task sees every file.
    """
    readers = world_size * workers
    hashed = files.withColumn("__h", seeded_hash(seed, "name"))
    hashed = hashed.withColumn("__b", hex_prefix("__h", 3))
    ranked = row_rank(hashed, [], "__b", ["__h", "name"], "file_rank", "n_files", 16**3)
    return (
        ranked.drop("__h", "__b")
        .withColumn("kept", F.expr(f"file_rank < n_files div {readers} * {readers}"))
        .withColumn("reader", (F.col("file_rank") % readers).cast("int"))
        .withColumn("slot", F.expr(f"file_rank div {readers}"))
        .withColumn("gpu_rank", F.expr(f"cast(reader div {workers} as int)"))
        .withColumn("worker", F.col("reader") % workers)
        .withColumn("files_each", F.expr(f"n_files div {readers}"))
    )


def with_read_status(assigned: DataFrame, buffer_files: int = FILES_PER_BUFFER) -> DataFrame:
    """C11: a reader restarts when fewer files than a buffer are left, so the tail is never read."""
    status = (
        F.when(~F.col("kept"), DROPPED)
        .when(F.col("files_each") < buffer_files, TOO_FEW_FILES)
        .when(F.col("slot") < F.expr(f"files_each div {buffer_files} * {buffer_files}"), READ)
        .otherwise(UNREAD_TAIL)
    )
    return assigned.withColumn("status", status)


def read_schedule(
    assigned: DataFrame,
    blocks_per_file: int,
    seed: int,
    workers: int,
    micro_batch: int,
    grad_accum: int,
    passes: int = 1,
    buffer_files: int = FILES_PER_BUFFER,
    shuffle: bool = True,
) -> DataFrame:
    """When each block is read, for ``passes`` passes of every reader.

    Blocks are permuted among the files of one buffer, so the sort window holds
    ``buffer_files * blocks_per_file`` short rows.  The workers of a rank take
    turns, a micro-batch each.
    """
    files = with_read_status(assigned, buffer_files).filter(F.col("status") == READ)
    blocks = (
        files.withColumn("file_group", F.expr(f"slot div {buffer_files}"))
        .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("block_no", F.explode(F.sequence(F.lit(0), F.lit(blocks_per_file - 1))))
    )
    if shuffle:
        order = [seeded_hash(seed, "reader", "pass_no", "file_group", "name", "block_no"), "name", "block_no"]
    else:
        order = ["slot", "block_no"]
    buffer = Window.partitionBy("reader", "pass_no", "file_group").orderBy(*order)
    per_buffer = buffer_files * blocks_per_file
    groups = f"(files_each div {buffer_files})"
    return (
        blocks.withColumn("__in_buffer", F.row_number().over(buffer) - 1)
        .withColumn(
            "read_pos", F.expr(f"(pass_no * {groups} + file_group) * {per_buffer} + __in_buffer")
        )
        .withColumn("iter", F.expr(f"(read_pos div {micro_batch}) * {workers} + worker"))
        .withColumn("step", F.expr(f"iter div {grad_accum}"))
        .drop("__in_buffer")
    )


def read_coverage(
    assigned: DataFrame, blocks_per_file: int, block_size: int, buffer_files: int = FILES_PER_BUFFER
) -> DataFrame:
    """C11: files, blocks and supervised tokens by whether one pass reaches them."""
    return (
        with_read_status(assigned, buffer_files)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("blocks", F.col("files") * blocks_per_file)
        .withColumn("supervised_tokens", F.col("blocks") * block_size)
    )


def block_visits(schedule: DataFrame, blocks_per_file: int) -> DataFrame:
    """``shard, shard_block`` and when the block is read, a row for each pass."""
    number = F.col("chunk_no") * blocks_per_file + F.col("block_no")
    return schedule.select("shard", number.alias("shard_block"), "pass_no", "gpu_rank", "iter", "step")


def in_read_order(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks with ``visits`` as the readers see them: with ``gpu_rank``, ``iter`` and ``step``.

    A row for each visit; blocks that are not read have none.  Every micro-batch goes to
    one of ``parts`` partitions, where they are in order; their number is given because
    positions are made there, which take many times the room of the blocks.
    """
    kept = [c for c in blocks.columns if c != "visits"]
    visited = blocks.select(*kept, F.inline("visits")).repartition(parts, "gpu_rank", "iter")
    return visited.sortWithinPartitions("gpu_rank", "iter")
