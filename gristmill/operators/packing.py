"""Sharding, stream offsets and fixed-length packing.

A shard is the concatenation of its documents' tokens in ``doc_id`` order, cut
every ``chunk_size`` tokens.  Order comes from computed offsets, never from the
order in which tasks run.  Documents are exploded to the units they overlap, so
the rows shuffled number documents plus units, not tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import BOS_ID, EOS_ID
from gristmill.operators.running import ROWS_PER_BUCKET, Cuts, range_cuts, row_rank, running_total, with_bucket


def assign_shard(docs: DataFrame, n_shards: int) -> DataFrame:
    """One of ``n_shards`` streams per document."""
    return docs.withColumn("shard", F.pmod(F.col("doc_id"), F.lit(n_shards)).cast("int"))


def stream_offsets(
    docs: DataFrame,
    n_shards: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Cuts | None = None,
) -> DataFrame:
    """C4: adds ``shard``, ``start_pos``, ``end_pos`` and ``shard_tokens``.

    Needs ``doc_id`` and ``n_tokens``; other columns ride along.
    """
    cuts = cuts or range_cuts(docs, "doc_id", rows_per_bucket)
    placed = with_bucket(assign_shard(docs, n_shards), "doc_id", cuts)
    summed = running_total(
        placed,
        ["shard"],
        "bucket",
        [F.col("doc_id").asc_nulls_first()],
        F.col("n_tokens"),
        start="start_pos",
        total="shard_tokens",
        max_keys=n_shards * cuts.buckets,
        buckets=cuts.buckets,
        fanout=cuts.fanout,
    )
    return summed.withColumn("end_pos", F.col("start_pos") + F.col("n_tokens")).drop("bucket")


def full_chunks(tokens: Column, chunk_size: int) -> Column:
    """Chunks written without the remainder.

    A chunk that is filled exactly is only written once a further token arrives,
    hence floor((T - 1) / C) and not floor(T / C).
    """
    return F.when(tokens > 0, F.floor((tokens - 1) / F.lit(chunk_size))).otherwise(0).cast("bigint")


def chunk_manifest(docs: DataFrame, n_shards: int, chunk_size: int) -> DataFrame:
    """The chunks that packing will write, from token counts alone."""
    shards = assign_shard(docs, n_shards).groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    chunks = full_chunks(F.col("t"), chunk_size)
    numbers = F.when(chunks > 0, F.sequence(F.lit(0).cast("bigint"), chunks - 1))
    return shards.select("shard", F.explode(numbers).alias("chunk_no")).withColumn(
        "chunk_size", F.lit(chunk_size).cast("bigint")
    )


def _assemble(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Concatenate the pieces of each unit by position; a unit has a fixed size."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "piece")))
    return (
        pieces.groupBy(*keys)
        .agg(ordered.alias("__pieces"))
        .select(*keys, F.flatten(F.col("__pieces.piece")).alias("tokens"))
    )


def _cut(offsets: DataFrame, unit: int, last_unit: Column | None) -> DataFrame:
    """One row per (document, unit of ``unit`` tokens) overlap."""
    first = F.expr(f"start_pos div {unit}")
    final = F.expr(f"greatest(end_pos - 1, start_pos) div {unit}")
    if last_unit is not None:
        final = F.least(final, last_unit)
    def piece(number: Column) -> Column:
        at = F.greatest(F.col("start_pos"), number * unit)
        upto = F.least(F.col("end_pos"), (number + 1) * unit)
        part = F.slice("tokens", (at - F.col("start_pos") + 1).cast("int"), (upto - at).cast("int"))
        return F.struct(number.alias("unit"), at.alias("at"), part.alias("piece"))

    # Sliced before the explode: no exploded row carries the whole document.
    # The outer form, because for the inner one the optimizer adds a filter on
    # the array's size and so evaluates the array twice.
    units = F.when(first <= final, F.transform(F.sequence(first, final), piece))
    return offsets.select("shard", F.inline_outer(units)).filter(F.col("unit").isNotNull())


def pack_chunks(
    docs: DataFrame,
    n_shards: int,
    chunk_size: int,
    remainder: str = "drop",
    pad_id: int = BOS_ID,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Rows ``(shard, chunk_no, tokens)`` of exactly ``chunk_size`` tokens.

    ``remainder='drop'`` loses the open chunk at the end of a shard; ``'pad'``
    writes it, filled up with ``pad_id``, and gives an empty shard one chunk of
    padding.
    """
    if remainder not in ("drop", "pad"):
        raise ValueError(f"remainder must be 'drop' or 'pad', got {remainder!r}")
    slim = docs.select("doc_id", "n_tokens", "tokens")
    offsets = stream_offsets(slim, n_shards, rows_per_bucket, cuts).filter("n_tokens > 0")
    if remainder == "drop":
        last = full_chunks(F.col("shard_tokens"), chunk_size) - 1
        pieces = _cut(offsets, chunk_size, last)
    else:
        # A zero-length piece at position 0 makes sure that every shard has a chunk.
        opening = docs.sparkSession.range(n_shards).select(
            F.col("id").cast("int").alias("shard"),
            F.lit(0).cast("bigint").alias("unit"),
            F.lit(-1).cast("bigint").alias("at"),
            F.array().cast("array<int>").alias("piece"),
        )
        pieces = _cut(offsets, chunk_size, None).unionByName(opening)
    chunks = _assemble(pieces.withColumnRenamed("unit", "chunk_no"), ["shard", "chunk_no"])
    if remainder == "pad":
        missing = F.lit(chunk_size) - F.size("tokens")
        chunks = chunks.withColumn(
            "tokens", F.concat("tokens", F.array_repeat(F.lit(pad_id).cast("int"), missing))
        )
    return chunks


def split_blocks(chunks: DataFrame, chunk_size: int, block_len: int) -> DataFrame:
    """C7 on stored chunks: ``chunk_size div block_len`` blocks, the tail unused."""
    per_chunk = chunk_size // block_len
    if per_chunk == 0:
        raise ValueError("a chunk must hold at least one block")
    numbered = chunks.withColumn("block_no", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))))
    return numbered.select(
        "shard",
        "chunk_no",
        "block_no",
        F.slice("tokens", F.col("block_no") * block_len + 1, block_len).alias("tokens"),
    )


def pack_blocks(
    docs: DataFrame,
    n_shards: int,
    chunk_size: int,
    block_len: int,
    micro_batch: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    remainder: str = "drop",
    region_batches: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """C5 + C7 in one step, without building megabyte-wide chunk rows.

    ``remainder='drop'`` leaves out the open chunk at the end of a shard (see
    ``dropped_tokens``); ``'pad'`` keeps it, filled up as ``pack_chunks`` does.

    ``shard_block`` numbers the blocks of a shard, ``block_no`` those of a chunk.
    With ``micro_batch`` each block also gets ``batch_no`` (``shard_block`` div
    the batch size) and the blocks of a batch are placed in one
    partition, so that later windows over (shard, batch_no) need no exchange.
    With ``region_batches`` too, so many batches in a row are a ``region`` of the shard,
    and whole regions are placed together, in ``parts`` partitions.
    """
    per_chunk = chunk_size // block_len
    batch_no = F.expr(f"shard_block div {micro_batch}") if micro_batch else None
    region = F.expr(f"shard_block div {micro_batch * region_batches}") if micro_batch and region_batches else None

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("batch_no", batch_no)
        if region is None:
            return rows.repartition("shard", "batch_no")
        return rows.withColumn("region", region).repartition(parts, "shard", "region")

    if chunk_size % block_len or remainder != "drop":
        chunks = pack_chunks(docs, n_shards, chunk_size, remainder, rows_per_bucket=rows_per_bucket)
        blocks = split_blocks(chunks, chunk_size, block_len).withColumn(
            "shard_block", F.col("chunk_no") * per_chunk + F.col("block_no")
        )
        if batch_no is not None:
            blocks = placed(blocks)
        return blocks
    slim = docs.select("doc_id", "n_tokens", "tokens")
    offsets = stream_offsets(slim, n_shards, rows_per_bucket).filter("n_tokens > 0")
    last = full_chunks(F.col("shard_tokens"), chunk_size) * per_chunk - 1
    pieces = _cut(offsets, block_len, last).withColumnRenamed("unit", "shard_block")
    keys = ["shard", "shard_block"]
    if batch_no is not None:
        keys[1:1] = ["batch_no"] if region is None else ["region", "batch_no"]
        pieces = placed(pieces)
    return _assemble(pieces, keys).select(
        *keys,
        F.expr(f"shard_block div {per_chunk}").alias("chunk_no"),
        (F.col("shard_block") % per_chunk).cast("int").alias("block_no"),
        "tokens",
    )


def dropped_tokens(docs: DataFrame, n_shards: int, chunk_size: int) -> DataFrame:
    """Tokens of each shard that ``remainder='drop'`` leaves out; shards without documents have no row."""
    sizes = assign_shard(docs.select("doc_id", "n_tokens"), n_shards).groupBy("shard").agg(
        F.sum(F.col("n_tokens").cast("bigint")).alias("tokens")
    )
    return sizes.withColumn("dropped", F.col("tokens") - full_chunks(F.col("tokens"), chunk_size) * chunk_size)


def next_token_pairs(blocks: DataFrame, keep: Sequence[str], beside: Sequence[str] = ()) -> DataFrame:
    """One row per supervised position: ``pos``, ``prev`` and ``label``.

    The last token of a block is only ever a label; document boundaries are not
    masked.  ``beside`` names arrays with an entry for each position.
    """
    inputs = F.slice("tokens", F.lit(1), F.size("tokens") - 1)
    labels = F.slice("tokens", F.lit(2), F.size("tokens") - 1)
    zipped = F.arrays_zip(inputs.alias("prev"), labels.alias("label"), *[F.col(name) for name in beside])
    exploded = blocks.select(*keep, F.posexplode_outer(zipped).alias("pos", "__pair"))
    return exploded.filter(F.col("pos").isNotNull()).select(
        *keep, "pos", *[F.col(f"__pair.{name}").alias(name) for name in ("prev", "label", *beside)]
    )


def rebuild_documents(chunks: DataFrame, eos_id: int = EOS_ID, chunks_per_bucket: int = 1000) -> DataFrame:
    """Split the packed stream at EOS and rejoin documents cut by a chunk end.

    Returns ``(shard, ordinal, tokens)`` for every document whose EOS was packed;
    ``ordinal`` counts documents in stream order.
    """
    ends = F.filter(
        F.transform("tokens", lambda t, i: F.when(t == eos_id, i + 1)), lambda i: i.isNotNull()
    )
    counted = chunks.withColumn("__ends", ends).withColumn(
        "__bucket", F.expr(f"chunk_no div {chunks_per_bucket}")
    )
    counted = running_total(
        counted, ["shard"], "__bucket", ["chunk_no"], F.size("__ends").cast("bigint"), start="__first"
    )
    # Starts follow the ends by one; the last piece runs to the end of the chunk.
    starts = F.concat(F.array(F.lit(1)), F.transform("__ends", lambda e: e + 1))
    stops = F.concat("__ends", F.array(F.size("tokens")))

    def piece(pair: Column, i: Column) -> Column:
        part = F.slice("tokens", pair["start"], pair["stop"] - pair["start"] + 1)
        return F.struct((F.col("__first") + i).alias("ordinal"), part.alias("piece"))

    bounds = F.arrays_zip(starts.alias("start"), stops.alias("stop"))
    pieces = counted.select("shard", F.col("chunk_no").alias("at"), F.inline_outer(F.transform(bounds, piece)))
    rebuilt = _assemble(pieces.filter(F.size("piece") > 0), ["shard", "ordinal"])
    return rebuilt.filter(F.element_at("tokens", -1) == eos_id)


def roundtrip(
    docs: DataFrame,
    chunks: DataFrame,
    n_shards: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Compare the rebuilt documents with the tokenized corpus, per shard.

    ``cut`` documents ended in the dropped remainder.  Tokens are compared by
    hash and length, so the join moves a few numbers per document.
    """
    digest = [F.xxhash64("tokens").alias("digest"), F.size("tokens").alias("n")]
    cuts = cuts or range_cuts(docs, "doc_id", rows_per_bucket)
    placed = with_bucket(assign_shard(docs, n_shards), "doc_id", cuts, "__bucket")
    slim = placed.select("doc_id", "shard", "__bucket", *digest)
    source = row_rank(
        slim, ["shard"], "__bucket", ["doc_id"], "ordinal", max_keys=n_shards * cuts.buckets, buckets=cuts.buckets
    ).drop("__bucket")
    packed = rebuild_documents(chunks).select("shard", "ordinal", *digest)
    packed = packed.withColumnsRenamed({"digest": "digest_packed", "n": "n_packed"})
    same = (F.col("digest") == F.col("digest_packed")) & (F.col("n") == F.col("n_packed"))
    return (
        source.join(packed, ["shard", "ordinal"], "left")
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.count("n_packed").alias("rebuilt"),
            F.count_if(~same).alias("mismatches"),
            F.count_if(F.col("n_packed").isNull()).alias("cut"),
        )
    )
