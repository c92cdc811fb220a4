"""Registered queries: every operator run over the given tables."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.seeded import hex_prefix, seeded_hash
from gristmill.functions.text import BOS_ID, EOS_ID, FIRST_WORD_ID, VOCAB_SIZE, WORD_PATTERN
from gristmill.operators import audit as A
from gristmill.operators import clustering as C
from gristmill.operators import evals as V
from gristmill.operators import losses as L
from gristmill.operators import packing as P
from gristmill.operators import reading as R
from gristmill.operators import routing
from gristmill.operators import runs as E
from gristmill.operators import sampling as S
from gristmill.operators import scoring as K
from gristmill.operators import selection as D
from gristmill.operators.bounded_lloyd import lloyd_bounded
from gristmill.operators.running import Cuts, range_cuts, row_rank, running_total, with_bucket
from gristmill.operators.staging import shared_dir, stage
from gristmill.operators.tokenizing import detokenize, tokenize
from gristmill.plans import jobs as J
from gristmill.sources import corpus, results, runlog
from gristmill.sources.corpus import read_corpus, spread, subset_of
from gristmill.functions.losses import cross_entropy, predictive_entropy
from gristmill.sources.files import open_uri, write_whole
from gristmill.sources.packed_format import read_packed, write_packed
from gristmill.sources.packed import HEADER, export_bin, import_bin, read_chunks, read_headers, write_chunks

Query = Callable[[SparkSession, str], DataFrame]

# Small enough that the test tables fill several shards, chunks and buckets.
LAYOUT = J.Layout(
    block_size=128,
    blocks_per_chunk=16,
    n_shards=4,
    world_size=2,
    workers=2,
    buffer_files=2,
    micro_batch=4,
    grad_accum=2,
    seed=42,
    rows_per_bucket=250,
)
SEED = 42
TREE_KS = (8, 3)
KMEANS_STEPS = 2
ROUTES = 3
LANGS = ["de", "en", "es", "fr"]
MIX = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
RUNS = 4
WARMUP, STABLE, MAX_STEPS, PEAK_LR, FLOOR_LR = 100, 1500, 2700, 8e-5, 8e-6

_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet", columns or ("doc_id", "text"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_docs(spark, sf), "doc_id")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize(_texts(spark, sf))


def _good(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the curated part that the reference model is fitted on."""
    return spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")


def _ids_md5(tokens: str = "tokens") -> Column:
    return F.md5(F.array_join(F.col(tokens).cast("array<string>"), " ")).alias("ids_md5")


def _files(tokens: DataFrame) -> DataFrame:
    chunks = P.chunk_manifest(tokens, LAYOUT.n_shards, LAYOUT.chunk_size)
    return chunks.withColumn("name", R.chunk_file_name())


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _files(_tokens(spark, sf))


# --- corpus, tokens, packing -------------------------------------------------


@query
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_profile(_docs(spark, sf, "text", "lang", "source"), ["lang", "source"])


@query
def tokenize_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", "n_tokens", _ids_md5())


@query
def doc_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = tokenize(_docs(spark, sf, "text", "lang"))
    return counted.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n_tokens").alias("tokens"),
        F.max("n_tokens").alias("longest"),
        F.min("n_tokens").alias("shortest"),
    )


@query
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign_shard(_docs(spark, sf, "doc_id"), LAYOUT.n_shards)


@query
def stream_offsets(spark: SparkSession, sf: str) -> DataFrame:
    counts = _written_counts(spark, sf)
    return P.stream_offsets(counts, LAYOUT.n_shards, LAYOUT.rows_per_bucket).select(
        "doc_id", "shard", "start_pos", "end_pos", "shard_tokens"
    )


@query
def stream_offsets_deep(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a tree of small buckets: several levels of cuts and of sums."""
    counts = _written_counts(spark, sf)
    cuts = range_cuts(counts, "doc_id", 8, fanout=4, branch=4)
    offsets = P.stream_offsets(counts, LAYOUT.n_shards, cuts=cuts)
    return offsets.select("doc_id", "shard", "start_pos", "end_pos", "shard_tokens")


def _written_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, n_tokens`` of every document, written once: the text is read once."""
    return stage(_tokens(spark, sf).select("doc_id", "n_tokens"), "counts")


def _written_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return J.tokens_of(_texts(spark, sf))


def _chunks(tokens: DataFrame, remainder: str, cuts: Cuts | None = None) -> DataFrame:
    return P.pack_chunks(
        tokens,
        LAYOUT.n_shards,
        LAYOUT.chunk_size,
        remainder,
        rows_per_bucket=LAYOUT.rows_per_bucket,
        cuts=cuts,
    )


@query
def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(_written_tokens(spark, sf), "drop")
    return chunks.select("shard", "chunk_no", F.size("tokens").alias("n_tokens"), _ids_md5())


@query
def packed_padded(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(_written_tokens(spark, sf), "pad")
    return chunks.select("shard", "chunk_no", F.size("tokens").alias("n_tokens"), _ids_md5())


@query
def packed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = J.pack_corpus(_written_tokens(spark, sf), LAYOUT)
    return blocks.select("shard", "chunk_no", "block_no", _ids_md5())


@query
def packed_blocks_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all tokens: the open chunks are filled up, none is left out."""
    blocks = J.pack_corpus(_written_tokens(spark, sf), replace(LAYOUT, remainder="pad"))
    return blocks.select("shard", "chunk_no", "block_no", _ids_md5())


@query
def packed_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each shard, and those that packing without a remainder leaves out."""
    return P.dropped_tokens(_written_tokens(spark, sf), LAYOUT.n_shards, LAYOUT.chunk_size)


@query
def next_token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["shard", "chunk_no", "block_no"]
    pairs = P.next_token_pairs(J.pack_corpus(_written_tokens(spark, sf), LAYOUT), keys)
    weighted = (F.col("pos") + 1) * (F.col("prev").cast("bigint") * 3 + F.col("label"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum(weighted).alias("checksum"))


@query
def roundtrip_check(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _written_tokens(spark, sf)
    cuts = range_cuts(tokens, "doc_id", LAYOUT.rows_per_bucket)
    return P.roundtrip(tokens, _chunks(tokens, "drop", cuts), LAYOUT.n_shards, cuts=cuts)


class _WordCodec:
    """The built-in tokenizer's rule in Python, to run the plug-in path on whole texts."""

    bos_id, eos_id = BOS_ID, EOS_ID

    def encode(self, string: str) -> list[int]:
        span = VOCAB_SIZE - FIRST_WORD_ID
        found = re.findall(WORD_PATTERN, string)
        return [FIRST_WORD_ID + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % span for w in found]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(str, ids))


@query
def tokenize_plugin(spark: SparkSession, sf: str) -> DataFrame:
    coded = tokenize(_texts(spark, sf), _WordCodec)
    return coded.select("doc_id", "n_tokens", _ids_md5())


@query
def detokenize_plugin(spark: SparkSession, sf: str) -> DataFrame:
    coded = tokenize(_texts(spark, sf), _WordCodec, eos=False)
    return detokenize(coded, _WordCodec).select("doc_id", F.md5("text").alias("text_md5"))


@query
def embed_plugin(spark: SparkSession, sf: str) -> DataFrame:
    def embedder() -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.array([[len(t.split(" ")), len(t)] for t in texts])

    vectors = C.embed(_texts(spark, sf), embedder)
    return vectors.select(
        "doc_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(2)]
    )


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _exported(spark: SparkSession, sf: str) -> str:
    """Write the chunks as ``.bin`` files; the manifest is staged beside them."""
    folder = _new_folder(spark, "bin")
    chunks = _chunks(_written_tokens(spark, sf), "drop")
    stage(export_bin(chunks, folder, VOCAB_SIZE), "manifest")
    return folder


def _packed(spark: SparkSession, sf: str) -> str:
    folder = _new_folder(spark, "packed")
    write_packed(_chunks(_written_tokens(spark, sf), "drop"), folder, VOCAB_SIZE)
    return folder


@query
def bin_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks written through the packed format and read back, a file as a row."""
    chunks = read_packed(spark, _packed(spark, sf))
    return chunks.select("shard", "chunk_no", F.size("tokens").alias("n_tokens"), _ids_md5())


@query
def bin_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same files read block by block, by byte ranges."""
    blocks = read_packed(spark, _packed(spark, sf), LAYOUT.block_len)
    number = F.expr(f"int(begin div {LAYOUT.block_len})").alias("block_no")
    return blocks.select("shard", "chunk_no", number, _ids_md5())


@query
def bin_import(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the export without the format's lists, as another program leaves them."""
    chunks = import_bin(spark, _exported(spark, sf))
    return chunks.select("shard", "chunk_no", F.size("tokens").alias("n_tokens"), _ids_md5())


@query
def bin_audit(spark: SparkSession, sf: str) -> DataFrame:
    headers = stage(read_headers(spark, _exported(spark, sf)), "headers")
    audited = A.audit_shards(headers)
    return audited.groupBy("status", "usable", "version", "dtype_code", "chunk_size").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


# --- reading and accounting --------------------------------------------------


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return R.reader_assignment(_manifest(spark, sf), SEED, LAYOUT.world_size, LAYOUT.workers)


@query
def reader_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("name", "kept", "reader", "slot", "gpu_rank", "worker")


def _schedule(spark: SparkSession, sf: str, shuffle: bool) -> DataFrame:
    return J.plan_reads(_tokens(spark, sf), LAYOUT, passes=2, shuffle=shuffle).select(
        "reader", "gpu_rank", "pass_no", "name", "block_no", "read_pos", "iter", "step"
    )


@query
def read_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return _schedule(spark, sf, True)


@query
def read_schedule_natural(spark: SparkSession, sf: str) -> DataFrame:
    return _schedule(spark, sf, False)


@query
def read_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_coverage(
        _assigned(spark, sf), LAYOUT.blocks_per_chunk, LAYOUT.block_size, LAYOUT.buffer_files
    )


def _damaged_files(spark: SparkSession, sf: str) -> str:
    """``.bin`` files of the chunks, about five of twelve with a seeded fault."""
    folder = _new_folder(spark, "damaged")
    fault = F.when(F.col("chunk_no") > 0, hex_prefix(seeded_hash(SEED, F.lit("fault"), "name"), 2) % 12)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_uri(folder)
        files.create_dir(root, recursive=True)
        for frame in frames:
            for name, fault, tokens in zip(frame["name"], frame["fault"], frame["tokens"]):
                payload = np.append(tokens, [0] * (fault == 2)).astype("<u2").tobytes()
                magic = b"XXXXXXX" if fault == 0 else A.MAGIC.encode()
                version, code = 1 + (fault == 4), 9 if fault == 1 else 8
                header = struct.pack(HEADER, magic, version, code, len(payload) // 2)
                write_whole(files, f"{root}/{name}", header, payload[: len(payload) - (fault == 3)])
            yield frame[["name"]]

    chunks = _chunks(_written_tokens(spark, sf), "drop").withColumn("name", R.chunk_file_name())
    marked = chunks.select("name", F.coalesce(fault, F.lit(11)).alias("fault"), "tokens")
    stage(marked.mapInPandas(write, "name string"), "damaged")
    return folder


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit_shards(stage(read_headers(spark, _damaged_files(spark, sf)), "headers"))


@query
def shard_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).groupBy("status", "usable").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def _accounts(files: DataFrame) -> DataFrame:
    return A.token_accounting(
        files,
        LAYOUT.block_size,
        LAYOUT.micro_batch,
        LAYOUT.grad_accum,
        LAYOUT.world_size,
        LAYOUT.workers,
        LAYOUT.buffer_files,
    )


@query
def token_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return _accounts(_manifest(spark, sf))


@query
def token_accounting_usable(spark: SparkSession, sf: str) -> DataFrame:
    """The stricter counter: bad files are left out first."""
    return _accounts(_audited(spark, sf).filter("usable"))


@query
def budget_compare(spark: SparkSession, sf: str) -> DataFrame:
    accounts = _accounts(_manifest(spark, sf))
    planned = accounts.withColumn("planned", F.expr("max_steps_nominal * 163 div 100"))
    compared = A.compare_budget(planned, "planned").unionByName(A.compare_budget(accounts, 7))
    return compared.withColumn("percent", F.round("percent", 6))


# --- curation ----------------------------------------------------------------


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _tree(points: DataFrame) -> C.ClusterTree:
    return C.build_tree(points, TREE_KS, J.lloyd_fit(KMEANS_STEPS, SEED, "vec_id"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return J.assignments(points, _tree(points))


LEVELS = ["c1", "c2"]


@query
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    centers = C.first_vectors(points, TREE_KS[0], SEED, "vec_id")
    found = C.assign(points, centers, distance="distance")
    return found.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query
def kmeans_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    centers = J.lloyd_fit(KMEANS_STEPS, SEED, "vec_id")(points, TREE_KS[0])
    return C.assign(points, centers).select("vec_id", "cluster")


@query
def kmeans_routed(spark: SparkSession, sf: str) -> DataFrame:
    """The same centroids and assignment with the centroids in a table, dealt to cells."""
    points = _points(spark, sf)
    centers = routing.seeded_centers(points, TREE_KS[0], SEED, "vec_id")
    centers = routing.lloyd_routed(points, centers, ROUTES, KMEANS_STEPS, SEED)
    routed = routing.route_centers(centers, routing.coarse_centers(centers, ROUTES, SEED))
    found = routing.assign_routed(points, routed)
    return found.select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query
def kmeans_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with bounds that skip distances."""
    points = _points(spark, sf)
    start = C.first_vectors(points, TREE_KS[0], SEED, "vec_id")
    return C.assign(points, lloyd_bounded(points, start, KMEANS_STEPS).centers).select("vec_id", "cluster")


@query
def kmeans_ml(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any run of Spark ML's k-means, whose start depends on partitions:
    every vector is assigned, to a centre that no other is nearer than (here by built-in
    expressions), and the centres fit no worse than the seeded start."""
    points, k = _points(spark, sf), 10
    centers = C.fit_kmeans(points, k, SEED)
    found = C.assign(points, centers, distance="distance")
    found = C.assign(found, C.first_vectors(points, k, SEED, "vec_id"), out="first", distance="first_distance")
    known = F.array(*[F.array(*[F.lit(x) for x in c.tolist()]) for c in centers])

    def squared(center: Column) -> Column:
        parts = F.zip_with(center, "embedding", lambda a, b: (a - b) * (a - b))
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    least = F.array_min(F.transform(known, squared))
    off = F.abs(F.col("distance") * F.col("distance") - least)
    return found.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if((F.col("cluster") >= 0) & (F.col("cluster") < len(centers))).alias("n_assigned"),
        F.count_if(off <= F.lit(1e-9) * (1 + least)).alias("n_nearest"),
        (F.sum(F.pow("distance", F.lit(2))) <= F.sum(F.pow("first_distance", F.lit(2)))).alias("no_worse"),
    )


@query
def cluster_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("vec_id", *LEVELS)


@query
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = J.with_token_counts(_paths(spark, sf), _texts(spark, sf), "vec_id")
    profile = C.cluster_profile(found, LEVELS)
    for name in ("doc_share", "token_share", "imbalance"):
        profile = profile.withColumn(name, F.round(name, 6))
    return profile


@query
def balanced_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return C.allocate(_paths(spark, sf), LEVELS, F.expr("total div 2"))


def _balanced(spark: SparkSession, sf: str, order: str) -> DataFrame:
    fit = J.lloyd_fit(KMEANS_STEPS, SEED, "vec_id")
    chosen = J.curate(_points(spark, sf), TREE_KS, fit, F.expr("total div 2"), "vec_id", SEED, order, LAYOUT.rows_per_bucket)
    return chosen.select("vec_id", *LEVELS)


@query
def hier_balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _balanced(spark, sf, "random")


@query
def hier_nearest_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _balanced(spark, sf, "nearest")


@query
def random_budget_subset(spark: SparkSession, sf: str) -> DataFrame:
    counts = _written_counts(spark, sf)
    return S.random_subset(counts, F.expr("all_tokens div 2"), "doc_id", SEED)


@query
def repeat_subset(spark: SparkSession, sf: str) -> DataFrame:
    counts = subset_of(_written_counts(spark, sf), _good(spark, sf))
    return S.repeat_subset(counts, F.expr("all_tokens * 163 div 100"), "doc_id", SEED)


@query
def mixture_draws(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "doc_id", "lang")
    drawn = S.mixture(docs, MIX, 2 * docs.count(), "doc_id", SEED, "lang", rows_per_bucket=500)
    return drawn.select("draw_id", "lang", "doc_id", "lap")


# --- token scores and selection ----------------------------------------------


def _scores(spark: SparkSession, sf: str, *columns: str, tokens: DataFrame | None = None) -> DataFrame:
    """A row per micro-batch, with lists of the ``columns`` of its positions (all: none named)."""
    tokens = _written_tokens(spark, sf) if tokens is None else tokens
    return J.score_corpus(tokens, subset_of(tokens, _good(spark, sf)), LAYOUT, VOCAB_SIZE, by_batch=True, columns=columns or None)


@query
def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = K.batch_positions(_scores(spark, sf))
    names = ("loss", "ref_loss", "ref_entropy", "excess")
    return scores.select(
        "shard", "batch_no", "chunk_no", "block_no", "pos", "label", *[K.shortened(F.col(n), 6).alias(n) for n in names]
    )


@query
def ref_entropy(spark: SparkSession, sf: str) -> DataFrame:
    model = K.fit_bigram(subset_of(_tokens(spark, sf), _good(spark, sf)), VOCAB_SIZE)
    return model.contexts.select("prev", "total", F.round("entropy", 6).alias("entropy"))


BATCH = ["shard", "batch_no"]
PLACE = ["chunk_no", "block_no", "pos"]


def _selected_summary(selected: DataFrame) -> DataFrame:
    """Per batch: how many positions, which (position sum) and their loss."""
    place = (F.col("chunk_no") * 16 + F.col("block_no")) * 128 + F.col("pos")
    return selected.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.count_if("selected").alias("n_selected"),
        F.sum(F.when(F.col("selected"), place)).alias("place_sum"),
        F.round(F.sum(F.when(F.col("selected"), F.col("loss"))), 4).alias("loss_sum"),
    )


@query
def top_ratio_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _selected_summary(D.with_top_ratio(_scores(spark, sf, *PLACE, "loss"), [("loss", 0.07)], BATCH))


@query
def top_ratio_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The highest scores of all positions as one batch, by two measures."""
    # Read three times, so only what is needed is written.
    scores = _scores(spark, sf, *PLACE, "loss", "ref_entropy")
    return _selected_summary(
        D.with_top_ratio_spread(stage(scores, "scores"), [("loss", 0.07), ("-ref_entropy", 0.7)], [])
    )


@query
def select_excess_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _selected_summary(D.select_tokens(_scores(spark, sf, *PLACE, "loss", "excess"), "excess_loss"))


@query
def select_self_reference(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf, *PLACE, "loss", "ref_loss", "ref_entropy")
    return _selected_summary(D.select_tokens(scores, "self_reference_intersection"))


@query
def select_high_high(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf, *PLACE, "loss", "ref_loss", "ref_entropy")
    return _selected_summary(D.select_tokens(scores, "high_intersection"))


@query
def select_plugin_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Selection on the scores of a caller's model, here a rule on the ids."""

    def scorer() -> K.BlockScorer:
        def score(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            prev, label = tokens[:, :-1], tokens[:, 1:]
            return label % 97, label % 89, prev % 83

        return score

    blocks = J.pack_corpus(_written_tokens(spark, sf), LAYOUT, batches=True)
    scores = K.score_blocks(blocks, scorer, ["shard", "batch_no", "chunk_no", "block_no"], place=BATCH)
    return _selected_summary(D.select_tokens(scores, "self_reference_intersection"))


def _batch_losses(spark: SparkSession, sf: str, tokens: DataFrame | None = None) -> DataFrame:
    return L.masked_loss(D.select_tokens(_scores(spark, sf, "loss", "excess", tokens=tokens), "excess_loss"))


@query
def masked_loss(spark: SparkSession, sf: str) -> DataFrame:
    losses = _batch_losses(spark, sf)
    return losses.withColumn("loss_sum", F.round("loss_sum", 4)).withColumn("loss", F.round("loss", 6))


@query
def interval_loss(spark: SparkSession, sf: str) -> DataFrame:
    batches = _batch_losses(spark, sf).withColumn("step", F.expr(f"batch_no div {LAYOUT.grad_accum}"))
    totals = L.interval_loss(batches, "step", 10)
    return (
        totals.withColumn("loss_sum", F.round("loss_sum", 4))
        .withColumn("loss", F.round("loss", 6))
        .withColumn("selected_ratio", F.round("selected_ratio", 6))
    )


@query
def masked_ce_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Document ends are the ignored targets."""
    target = F.when(F.col("label") == EOS_ID, -1).otherwise(F.col("label"))
    means = L.masked_ce_mean(K.batch_positions(_scores(spark, sf, "label", "loss")).withColumn("target", target), ["shard"])
    return means.withColumn("mean_kept", F.round("mean_kept", 6)).withColumn(
        "mean_all", F.round("mean_all", 6)
    )


@query
def hybrid_select(spark: SparkSession, sf: str) -> DataFrame:
    subset = _balanced(spark, sf, "random").select(F.col("vec_id").alias("doc_id"))
    subset, good = stage(subset, "curated"), _good(spark, sf)
    # Documents outside both parts are not tokenized.
    used = subset_of(_texts(spark, sf), subset.unionByName(good))
    tokens = J.tokens_of(used)
    return _selected_summary(J.hybrid(tokens, subset, subset_of(tokens, good), LAYOUT, VOCAB_SIZE))


@query
def read_order_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Interval totals over all ranks, each micro-batch masked as it is read."""
    tokens = _written_tokens(spark, sf)
    selected = J.select_in_read_order(
        tokens, subset_of(tokens, _good(spark, sf)), LAYOUT, VOCAB_SIZE, "excess_loss", passes=2
    )
    totals = L.interval_loss(L.masked_loss(selected, ["gpu_rank", "iter", "step"]), "step", 10)
    return (
        totals.withColumn("loss_sum", F.round("loss_sum", 4))
        .withColumn("loss", F.round("loss", 6))
        .withColumn("selected_ratio", F.round("selected_ratio", 6))
    )


def _stored(spark: SparkSession, tokens: DataFrame) -> DataFrame:
    """The chunks, written to the store of record and read back."""
    folder = _new_folder(spark, "store")
    write_chunks(_chunks(tokens, "drop"), folder)
    return read_chunks(spark, folder)


def _read_summary(selected: DataFrame) -> DataFrame:
    """Per micro-batch as read: positions, which are selected (position sum) and their loss."""
    place = (F.col("chunk_no") * 16 + F.col("block_no")) * 128 + F.col("pos")
    return selected.groupBy("gpu_rank", "iter", "step").agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.count_if("selected").alias("n_selected"),
        F.sum(F.when(F.col("selected"), place)).alias("place_sum"),
        F.round(F.sum(F.when(F.col("selected"), F.col("loss"))), 4).alias("loss_sum"),
    )


@query
def select_stored_read_order(spark: SparkSession, sf: str) -> DataFrame:
    """Selection from stored shards; without a reference, the base model is its own."""
    chunks = _stored(spark, _written_tokens(spark, sf))
    return _read_summary(J.select_from_store(chunks, None, LAYOUT, VOCAB_SIZE, passes=2))


@query
def select_stored_high_high(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _written_tokens(spark, sf)
    reference = subset_of(tokens, _good(spark, sf))
    chunks = _stored(spark, tokens)
    return _read_summary(J.select_from_store(chunks, reference, LAYOUT, VOCAB_SIZE, "high_intersection", passes=2))


@query
def logit_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and entropy straight from logits; the vectors serve as logits."""
    rows = _points(spark, sf).withColumn("label", F.col("vec_id") % F.size("embedding"))
    return rows.select(
        "vec_id",
        F.round(cross_entropy("embedding", "label"), 6).alias("loss"),
        F.round(predictive_entropy("embedding"), 6).alias("entropy"),
    )


@query
def logit_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The same from logits that arrive in slices of the vocabulary, one row each."""
    size = F.size("embedding")
    rows = _points(spark, sf).withColumn("label", F.col("vec_id") % size)
    part = F.explode(F.expr("sequence(0, size(embedding) - 1, 24)")).alias("first_id")
    cut = rows.select("vec_id", "label", "embedding", part).withColumn(
        "logits", F.slice("embedding", F.col("first_id") + 1, F.lit(24))
    )
    scored = K.score_logit_slices(cut, ["vec_id"])
    return scored.select("vec_id", F.round("loss", 6).alias("loss"), F.round("entropy", 6).alias("entropy"))


# --- run analytics -----------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a run log: four runs, one event a step."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select(
        (F.col("user_id") % RUNS).alias("run"),
        F.col("event_id").alias("step"),
        (F.col("value") / 100.0).alias("loss"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.lit(512) + F.floor("value")).cast("bigint").alias("batch_tokens"),
        F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0).alias("eval_seconds"),
    )


def _ranked_log(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    log = with_bucket(log, "step", range_cuts(log, "step", 1000), "bucket")
    ranked = row_rank(log, ["run"], "bucket", ["step"])
    ranked = running_total(
        ranked, ["run"], "bucket", ["step"], F.col("batch_tokens"), "tokens_before", least={"first_us": "us"}
    )
    return (
        ranked.withColumn("elapsed", (F.col("us") - F.col("first_us")) / F.lit(1e6))
        .withColumn("samples", (F.col("rank") + 1) * 16)
        .withColumn("lengths", F.col("tokens_before") + F.col("batch_tokens"))
        .drop("first_us", "tokens_before")
    )


@query
def rolling_loss(spark: SparkSession, sf: str) -> DataFrame:
    rolled = L.rolling_loss(_ranked_log(spark, sf), ["run"], "rank", 50)
    return rolled.select(
        "run", "step", F.round("train_loss", 6).alias("train_loss"), F.round("train_ppl", 6).alias("train_ppl")
    )


@query
def rolling_throughput(spark: SparkSession, sf: str) -> DataFrame:
    rates = E.rolling_throughput(_ranked_log(spark, sf), ["run"], LAYOUT.world_size)
    names = [
        "batches_per_sec",
        "samples_per_sec",
        "tokens_per_sec",
        "tokens_per_sec_by_length",
        "device_batches_per_sec",
        "device_samples_per_sec",
        "device_tokens_per_sec",
    ]
    return rates.select("run", "step", *[F.round(n, 6).alias(n) for n in names])


@query
def interval_throughput(spark: SparkSession, sf: str) -> DataFrame:
    rates = E.interval_throughput(_ranked_log(spark, sf), ["run"], LAYOUT.world_size, 10)
    return rates.select(
        "run", "step", "tokens", F.round("seconds", 6).alias("seconds"), F.round("tok_s", 6).alias("tok_s")
    )


@query
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    log = E.rank_steps(_log(spark, sf).select("run", "step"), ["run"], "step", 1000)
    log = log.select("run", (F.col("rank") + 1).alias("step"))
    rate = E.learning_rate("step", WARMUP, STABLE, MAX_STEPS, PEAK_LR, FLOOR_LR)
    return log.select(
        "run",
        "step",
        E.schedule_phase("step", WARMUP, STABLE).alias("phase"),
        F.round(rate * 1e6, 6).alias("micro_lr"),
    )


@query
def step_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse metrics: one column per event type, several rows a step."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = events.select(
        F.expr("event_id div 7").alias("step"),
        "event_id",
        *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds],
    )
    return E.merge_steps(rows, "step", "event_id", kinds)


@query
def step_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The same from JSON lines, whose metrics are found in the data."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    line = F.to_json(F.create_map(F.col("event_type"), F.col("value"))).alias("line")
    lines = events.select(F.expr("event_id div 7").alias("step"), "event_id", line)
    return E.merge_metrics(E.metric_maps(lines, "line"), "step", "event_id")


@query
def elapsed_time(spark: SparkSession, sf: str) -> DataFrame:
    timed = E.elapsed_time(_ranked_log(spark, sf), ["run"], "bucket", "step", "hours")
    names = ("time_train", "time_val", "time_total")
    return timed.select("run", "step", *[F.round(n, 6).alias(n) for n in names])


@query
def flops_mfu(spark: SparkSession, sf: str) -> DataFrame:
    per_sequence = E.step_flops(1_100_048_384, 0, 22, 2048, 2048)
    log = _ranked_log(spark, sf).withColumn("flops", F.lit(float(per_sequence)) * F.col("batch_tokens"))
    used = E.utilization(log, ["run"], LAYOUT.world_size, "a100", "bf16-true")
    return used.select(
        "run",
        "step",
        F.round(F.col("device_flops_per_sec") / 1e12, 4).alias("device_tflops"),
        F.round(F.col("flops_per_sec") / 1e12, 4).alias("tflops"),
        F.round("mfu", 4).alias("mfu"),
    )


@query
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).withColumn("step_group", F.expr("step div 16"))
    means = log.groupBy("run", "step_group").agg(F.avg("loss").alias("loss"))
    compared = E.compare_runs(means.filter("run = 0"), means.filter("run = 1"), "step_group")
    for name in ("left_value", "right_value", "difference"):
        compared = compared.withColumn(name, F.round(name, 9))
    return compared


def _printed(spark: SparkSession, sf: str, rate: Column) -> DataFrame:
    """The log as a trainer prints it; ``rate`` may use ``rank``."""
    log = E.rank_steps(_log(spark, sf), ["run"], "step", 1000)
    return runlog.format_steps(
        log.select(
            F.concat(F.lit("run"), F.col("run").cast("string")).alias("run"),
            (F.col("rank") + 1).alias("step"),
            F.lit(MAX_STEPS).alias("max_steps"),
            "loss",
            F.when(F.col("run") % 2 == 1, F.lit(0.625)).alias("selected"),
            rate.alias("lr"),
            F.lit(0.5).alias("grad_norm"),
            (F.col("batch_tokens") * 1000).alias("tok_s"),
        )
    )


@query
def run_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Print the log as a trainer would, then read it back."""
    return runlog.parse_steps(_printed(spark, sf, F.lit(PEAK_LR)))


@query
def run_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Logs written to files and read back; their rates held against the schedule, which
    every seventh step leaves."""
    schedule = (WARMUP, STABLE, MAX_STEPS, PEAK_LR, FLOOR_LR)
    at = F.col("rank") + 1
    planned = E.learning_rate(at, *schedule)
    folder = _new_folder(spark, "logs")
    runlog.write_log_lines(_printed(spark, sf, F.when(at % 7 == 0, planned * 1.1).otherwise(planned)), folder)
    steps = runlog.parse_steps(runlog.read_log_lines(spark, folder, by_folder=True))
    return E.audit_schedule(steps, *schedule).groupBy("run").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if("lr_matches").alias("on_schedule"),
        F.sum("tok_s").alias("tok_s"),
        F.round(F.sum("loss"), 2).alias("loss"),
    )


@query
def checkpoint_events(spark: SparkSession, sf: str) -> DataFrame:
    """A save every 500 steps and one at the end, announced twice if both fall together."""
    log = E.rank_steps(_log(spark, sf), ["run"], "step", 1000, "last").withColumn("at", F.col("rank") + 1)
    regular = F.when(F.col("at") % 500 == 0, F.lit("save"))
    final = F.when(F.col("at") == F.col("last"), F.array(F.lit("save"), F.lit("final")))
    saves = log.withColumn("save", F.explode(F.coalesce(final, F.array(regular))))
    lines = saves.filter(F.col("save").isNotNull()).select(
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("run"),
        F.concat(F.lit("[ckpt] saved -> /runs/a/step-"), F.col("at").cast("string")).alias("line"),
    )
    return E.checkpoint_steps(runlog.parse_checkpoints(lines))


@query
def compute_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs: all data once, the curated part repeated, all data with token selection."""
    tokens = _written_tokens(spark, sf)
    accounts = _accounts(_files(tokens))
    plans = [("full", "all", "none"), ("repeated", "curated", "none"), ("selected", "all", "excess_loss")]
    kinds = F.array(
        *[
            F.struct(F.lit(r).alias("run"), F.lit(s).alias("subset"), F.lit(m).alias("method"))
            for r, s, m in plans
        ]
    )
    runs = accounts.select(F.inline(kinds), F.col("max_steps_nominal").alias("steps"), "tokens_per_step")
    whole = tokens.agg(F.sum("n_tokens").alias("unique_tokens"))
    part = subset_of(tokens, _good(spark, sf)).agg(F.sum("n_tokens").alias("unique_tokens"))
    subsets = whole.withColumn("subset", F.lit("all")).unionByName(part.withColumn("subset", F.lit("curated")))
    kept = _batch_losses(spark, sf, tokens).agg(
        (F.sum("n_selected") / F.sum("n_positions")).alias("selected_ratio")
    )
    kept = kept.withColumn("subset", F.lit("all")).withColumn("method", F.lit("excess_loss"))
    return E.compute_ledger(runs, subsets, kept).withColumn("passes", F.round("passes", 6))


# --- evaluation analytics ----------------------------------------------------


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evaluation samples; the quality label is the score."""
    docs = _docs(spark, sf, "doc_id", "source", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    status = F.when(F.col("quality").isNull(), "empty").when(F.col("toxic") == 1, "timeout").otherwise("ok")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("dataset"),
        F.col("lang").alias("type"),
        status.alias("status"),
        F.col("quality").alias("score"),
    )


@query
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return V.accuracy(_samples(spark, sf))


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    report = V.accuracy_report(_samples(spark, sf))
    best = F.array_max(F.map_values("type_acc"))
    return report.select(
        "dataset", "num_samples", "num_scores", "acc", F.size("type_acc").alias("types"), best.alias("best_type")
    )


@query
def eval_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result files written from the report and read back, a row per type."""
    folder = _new_folder(spark, "evals")
    stage(results.write_results(V.accuracy_report(_samples(spark, sf)), folder), "evals")
    read = results.read_results(spark, folder)
    types = results.type_accuracy(read).withColumnRenamed("acc", "type_acc")
    totals = read.select("dataset", "num_samples", "num_scores", "timeout_samples", "empty_samples", "acc")
    return totals.join(types, "dataset")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    by_type = V.accuracy(_samples(spark, sf)).filter(~F.col("whole_dataset"))
    return by_type.select(F.col("dataset").alias("model"), F.col("type").alias("task"), "acc")


@query
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return V.leaderboard(_results(spark, sf), LANGS)


@query
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    return V.baseline_delta(_results(spark, sf), "src1", "src0")
