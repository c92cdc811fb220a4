"""The package's end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import hashed_ids
from gristmill.operators import clustering as C
from gristmill.operators import packing as P
from gristmill.operators import reading as R
from gristmill.operators import sampling as S
from gristmill.operators import scoring as K
from gristmill.operators.running import ROWS_PER_BUCKET
from gristmill.operators.selection import select_tokens
from gristmill.operators.staging import stage
from gristmill.operators.tokenizing import CodecFactory, tokenize
from gristmill.sources.corpus import subset_of


@dataclass(frozen=True)
class Layout:
    """How a corpus is packed and read."""

    block_size: int = 2048
    blocks_per_chunk: int = 1024
    n_shards: int = 16
    world_size: int = 8
    workers: int = 8
    buffer_files: int = 8
    micro_batch: int = 16
    grad_accum: int = 4
    seed: int = 42
    rows_per_bucket: int = ROWS_PER_BUCKET
    # What packing does with the open chunk at a shard's end: "drop" or "pad".
    # Reading plans list full chunks only.
    remainder: str = "drop"

    @property
    def block_len(self) -> int:
        """Tokens of a stored block: one more than its supervised positions."""
        return self.block_size + 1

    @property
    def chunk_size(self) -> int:
        return self.block_len * self.blocks_per_chunk

    @property
    def region_batches(self) -> int:
        """Micro-batches in a row whose pairs are counted together."""
        return max(1, REGION_POSITIONS // (self.block_size * self.micro_batch))


def tokens_of(docs: DataFrame, codec: CodecFactory | None = None) -> DataFrame:
    """The tokenized corpus, written once as ``doc_id, n_tokens, tokens``.

    Every later job needs the token counts before it needs the tokens.  From the
    written table the counts are one narrow column; from the text, they would
    cost another pass over all of it.
    """
    if codec is None:
        coded = docs.select("doc_id", hashed_ids("text").alias("tokens"))
        coded = coded.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    else:
        coded = tokenize(docs.select("doc_id", "text"), codec)
    return stage(coded.select("doc_id", "n_tokens", "tokens"), "tokens")


def pack_corpus(
    tokens: DataFrame, layout: Layout, batches: bool = False, parts: int | None = None
) -> DataFrame:
    """Tokens to blocks, with the blocks of a micro-batch placed together if asked, and
    with ``parts`` whole regions of them."""
    return P.pack_blocks(
        tokens,
        layout.n_shards,
        layout.chunk_size,
        layout.block_len,
        layout.micro_batch if batches else None,
        layout.rows_per_bucket,
        layout.remainder,
        layout.region_batches if parts else None,
        parts,
    )


# Supervised positions of a region, which one task holds at a time, and of a partition.
REGION_POSITIONS = 1 << 20
PART_POSITIONS = 1 << 21
REGION = ["shard", "region"]


def _parts(tokens: DataFrame) -> int:
    """Partitions for the positions of a table with ``n_tokens``."""
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    return max(tokens.sparkSession.sparkContext.defaultParallelism, -(-total // PART_POSITIONS))


def plan_reads(tokens: DataFrame, layout: Layout, passes: int = 1, shuffle: bool = True) -> DataFrame:
    """The schedule of every block, from token counts alone."""
    return plan_files(P.chunk_manifest(tokens, layout.n_shards, layout.chunk_size), layout, passes, shuffle)


def plan_files(chunks: DataFrame, layout: Layout, passes: int = 1, shuffle: bool = True) -> DataFrame:
    """The schedule of every block of the chunks ``(shard, chunk_no)``."""
    files = chunks.withColumn("name", R.chunk_file_name())
    return R.read_schedule(
        R.reader_assignment(files, layout.seed, layout.world_size, layout.workers),
        layout.blocks_per_chunk,
        layout.seed,
        layout.workers,
        layout.micro_batch,
        layout.grad_accum,
        passes,
        layout.buffer_files,
        shuffle,
    )


def _models(
    blocks: DataFrame, reference_tokens: DataFrame | None, vocab_size: int, alpha: float, parts: int
) -> tuple[K.BigramModel, K.BigramModel]:
    """The base model of the blocks and the reference model; without one, the base's own."""
    base = K.fit_bigram(blocks, vocab_size, alpha)
    if reference_tokens is None:
        return base, base
    return base, K.fit_listed(reference_tokens, vocab_size, alpha, K.pair_buckets(parts, vocab_size))


def score_corpus(
    tokens: DataFrame, reference_tokens: DataFrame | None, layout: Layout, vocab_size: int, alpha: float = 0.1,
    by_batch: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Pack a corpus and score every position with the count models.

    The base model is fitted on all blocks, the reference model on the documents
    of a curated part; without one, the base model is its own reference.  The blocks are
    shuffled as arrays only, by region and then, with the counts of their pairs, by
    micro-batch; the distinct pairs of each region go to their totals and back.  A
    selection by (shard, batch_no) needs no further exchange.

    ``by_batch`` returns a row per micro-batch with lists of its positions' values, worked
    out in the regions without the second shuffle of blocks (``K.score_batches``), and of
    these lists those that ``columns`` names.
    """
    parts = _parts(tokens)
    blocks = pack_corpus(tokens, layout, batches=True, parts=parts)
    if by_batch:
        models = _models(blocks, reference_tokens, vocab_size, alpha, parts)
        return K.score_batches(blocks, *models, REGION, ["shard", "batch_no"], ["chunk_no", "block_no"], parts, columns)
    counted, score = _counted(blocks, reference_tokens, vocab_size, alpha, parts)
    # Blocks in order spare the selection most of sorting their positions.
    placed = counted.repartition("shard", "batch_no").sortWithinPartitions("shard", "batch_no")
    return score(placed, ["shard", "batch_no", "chunk_no", "block_no"])


def _counted(
    blocks: DataFrame, reference_tokens: DataFrame | None, vocab_size: int, alpha: float, parts: int,
    visits: DataFrame | None = None,
) -> tuple[DataFrame, Callable[[DataFrame, Sequence[str]], DataFrame]]:
    """Blocks placed by region with the counts of their pairs and, if given, lists of their
    ``visits``, and what makes scored positions of such blocks."""
    base, other = _models(blocks, reference_tokens, vocab_size, alpha, parts)
    buckets = K.pair_buckets(parts, vocab_size)
    lists = K.count_pairs(blocks, REGION, vocab_size, buckets)
    reference = K.own_model(lists, vocab_size, alpha, buckets) if other is base else other
    counted = K.with_pair_counts(blocks, None if other is base else other, REGION, vocab_size, parts, visits, counted=lists)

    def score(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        positions = P.next_token_pairs(rows, keep, K.count_columns(rows))
        return K.score_counted(positions, K.listed_totals(lists, vocab_size, buckets), base, reference)

    return counted, score


READ_KEYS = ["gpu_rank", "iter", "step", "pass_no", "shard", "chunk_no", "block_no"]


def _select_as_read(
    blocks: DataFrame,
    schedule: DataFrame,
    reference_tokens: DataFrame | None,
    layout: Layout,
    vocab_size: int,
    method: str,
    alpha: float,
    parts: int,
    passes: int,
) -> DataFrame:
    """Pairs are counted once for each block, however often it is read; a visit takes the
    block's tokens and counts along."""
    in_region = layout.micro_batch * layout.region_batches
    visits = R.block_visits(schedule, layout.blocks_per_chunk)
    visits = visits.withColumn("region", F.expr(f"shard_block div {in_region}"))
    counted, score = _counted(blocks, reference_tokens, vocab_size, alpha, parts, visits)
    read = R.in_read_order(counted, parts * passes)
    return select_tokens(score(read, READ_KEYS), method, ["gpu_rank", "iter"])


def select_in_read_order(
    tokens: DataFrame,
    reference_tokens: DataFrame | None,
    layout: Layout,
    vocab_size: int,
    method: str = "self_reference_intersection",
    passes: int = 1,
    alpha: float = 0.1,
) -> DataFrame:
    """Plan the reads, score the blocks of every micro-batch and select its tokens."""
    parts = _parts(tokens)
    blocks, schedule = pack_corpus(tokens, layout, True, parts), plan_reads(tokens, layout, passes)
    return _select_as_read(blocks, schedule, reference_tokens, layout, vocab_size, method, alpha, parts, passes)


def select_from_store(
    chunks: DataFrame,
    reference_tokens: DataFrame | None,
    layout: Layout,
    vocab_size: int,
    method: str = "self_reference_intersection",
    passes: int = 1,
    alpha: float = 0.1,
) -> DataFrame:
    """The same from stored shards: ``(shard, chunk_no, tokens)`` of ``read_chunks`` or ``import_bin``."""
    parts = _parts(chunks.select(F.lit(layout.chunk_size).alias("n_tokens")))
    blocks = P.split_blocks(chunks, layout.chunk_size, layout.block_len).withColumn(
        "shard_block", F.col("chunk_no") * layout.blocks_per_chunk + F.col("block_no")
    )
    in_region = layout.micro_batch * layout.region_batches
    blocks = blocks.withColumn("region", F.expr(f"shard_block div {in_region}")).repartition(parts, *REGION)
    schedule = plan_files(chunks.select("shard", "chunk_no"), layout, passes)
    return _select_as_read(blocks, schedule, reference_tokens, layout, vocab_size, method, alpha, parts, passes)


def assignments(points: DataFrame, tree: C.ClusterTree) -> DataFrame:
    """Each vector's clusters and distance, written once.

    Quotas, profiles and samples read this narrow table several times; the
    vectors are read, and compared with the centroids, only here.
    """
    return stage(C.assign_tree(points, tree, distance="distance").drop("embedding"), "assignments")


def curate(
    points: DataFrame,
    ks: Sequence[int],
    fit: Callable[[DataFrame, int], np.ndarray],
    target: Column | int,
    key: str,
    seed: int,
    order: str = "random",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Embeddings to a balanced subset: cluster tree, quotas, sample."""
    tree = C.build_tree(points, ks, fit)
    levels = [f"c{i + 1}" for i in range(tree.depth)]
    found = assignments(points, tree)
    return S.balanced_sample(found, C.allocate(found, levels, target), levels, key, seed, order, rows_per_bucket=rows_per_bucket)


def hybrid(
    tokens: DataFrame,
    subset: DataFrame,
    reference_tokens: DataFrame,
    layout: Layout,
    vocab_size: int,
    method: str = "self_reference_intersection",
) -> DataFrame:
    """Token selection inside a curated subset, which is written first (A2)."""
    chosen = stage(subset_of(tokens, subset), "subset")
    return select_tokens(score_corpus(chosen, reference_tokens, layout, vocab_size, by_batch=True), method)


def lloyd_fit(steps: int, seed: int, key: str, upper_key: str = "id") -> Callable[[DataFrame, int], np.ndarray]:
    """A reproducible ``fit`` for ``build_tree``: seeded start, fixed number of steps."""

    def fit(points: DataFrame, k: int) -> np.ndarray:
        name = key if key in points.columns else upper_key
        return C.lloyd(points, C.first_vectors(points, k, seed, name), steps)

    return fit


def ml_fit(seed: int, max_iter: int = 20) -> Callable[[DataFrame, int], np.ndarray]:
    return lambda points, k: C.fit_kmeans(points, k, seed, max_iter)


def with_token_counts(points: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Attach ``n_tokens`` of the document with the same id; null where there is none."""
    counts = tokenize(docs.select("doc_id", "text")).select(F.col("doc_id").alias(key), "n_tokens")
    return points.join(counts, key, "left")
