import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import packing as P
from gristmill.operators.tokenizing import tokenize


def _corpus(spark, lengths, ids=None):
    """Documents whose tokens are unique, so that any misplaced one shows."""
    rows, token = [], 10
    for i, n in enumerate(lengths):
        rows.append((ids[i] if ids else i, list(range(token, token + n)), n))
        token += n
    return rows, spark.createDataFrame(rows, "doc_id bigint, tokens array<int>, n_tokens bigint")


def _expected(rows, n_shards, size, pad=None):
    """Plain packing of each shard's concatenated tokens."""
    out = {}
    for shard in range(n_shards):
        stream = [t for d, ts, _ in sorted(rows) if d % n_shards == shard for t in ts]
        full = (len(stream) - 1) // size if stream else 0
        for c in range(full):
            out[shard, c] = stream[c * size : (c + 1) * size]
        if pad is not None:
            rest = stream[full * size :]
            out[shard, full] = rest + [pad] * (size - len(rest))
    return out


def _collected(df):
    return {(r["shard"], r["chunk_no"]): r["tokens"] for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_chunks_equal_plain_packing(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 2, 7, 16, 150]) for _ in range(rng.randint(1, 60))]
    rows, docs = _corpus(spark, lengths, rng.sample(range(10**9), len(lengths)))
    shuffled = docs.orderBy(F.rand(seed))
    for size in (7, 16):
        got = P.pack_chunks(shuffled, 3, size, rows_per_bucket=5)
        assert _collected(got) == _expected(rows, 3, size)
        padded = P.pack_chunks(shuffled, 3, size, "pad", pad_id=1, rows_per_bucket=5)
        assert _collected(padded) == _expected(rows, 3, size, pad=1)


@pytest.mark.parametrize("total, chunks", [(0, 0), (1, 0), (16, 0), (17, 1), (32, 1), (33, 2)])
def test_exactly_full_chunk_waits_for_the_next_token(spark, total, chunks):
    _, docs = _corpus(spark, [total])
    assert P.pack_chunks(docs, 1, 16).count() == chunks
    assert P.pack_chunks(docs, 1, 16, "pad").count() == chunks + 1
    assert P.chunk_manifest(docs, 1, 16).count() == chunks


def test_empty_shard_is_padded_whole(spark):
    _, docs = _corpus(spark, [3])
    got = _collected(P.pack_chunks(docs, 2, 4, "pad", pad_id=1))
    assert got[1, 0] == [1, 1, 1, 1]


def test_one_document_longer_than_many_chunks(spark):
    rows, docs = _corpus(spark, [5, 5000, 5])
    assert _collected(P.pack_chunks(docs, 1, 16)) == _expected(rows, 1, 16)


def test_direct_blocks_equal_split_chunks(spark):
    _, docs = _corpus(spark, [13] * 50)
    chunks = P.pack_chunks(docs, 2, 20)
    keys = ["shard", "chunk_no", "block_no", "tokens"]
    for micro_batch in (None, 3):
        direct = P.pack_blocks(docs, 2, 20, 5, micro_batch).select(*keys)
        assert sorted(direct.collect()) == sorted(P.split_blocks(chunks, 20, 5).select(*keys).collect())
    # 20 = 2 * 9 + 2: the chunk's tail is unused.
    ragged = P.pack_blocks(docs, 2, 20, 9).select(*keys)
    assert sorted(ragged.collect()) == sorted(P.split_blocks(chunks, 20, 9).select(*keys).collect())


def test_pairs_stay_inside_a_block(spark):
    blocks = spark.createDataFrame([(0, [5, 6, 7]), (1, [8])], "block_no int, tokens array<int>")
    got = P.next_token_pairs(blocks, ["block_no"]).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 5, 6), (0, 1, 6, 7)]


def test_rebuilt_documents(spark):
    text = [(i, " ".join(f"w{i}x{j}" for j in range(i % 7))) for i in range(40)]
    docs = tokenize(spark.createDataFrame(text, "doc_id bigint, text string"))
    for row in P.roundtrip(docs, P.pack_chunks(docs, 2, 8), 2, rows_per_bucket=6).collect():
        assert row["mismatches"] == 0 and row["rebuilt"] + row["cut"] == row["docs"] == 20
    whole = P.rebuild_documents(P.pack_chunks(docs, 2, 8, "pad"))
    got = sorted(tuple(r["tokens"]) for r in whole.collect())
    assert got == sorted(tuple(r["tokens"]) for r in docs.collect())


def test_no_single_partition_over_documents(spark):
    """Only the table of bucket totals may be gathered."""
    docs = tokenize(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))
    plan = P.pack_chunks(docs, 4, 16, rows_per_bucket=50)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_remainder_must_be_known(spark):
    _, docs = _corpus(spark, [3])
    with pytest.raises(ValueError):
        P.pack_chunks(docs, 1, 16, "keep")


def test_default_layout_keeps_a_small_corpus_when_padded(spark):
    from gristmill.plans.jobs import Layout, pack_corpus

    rows = [(i, 3, [5, 6, 2]) for i in range(40)]
    tokens = spark.createDataFrame(rows, "doc_id long, n_tokens int, tokens array<int>")
    layout = Layout(block_size=7, blocks_per_chunk=64, n_shards=2, remainder="pad")
    blocks = pack_corpus(tokens, layout, batches=True).collect()
    assert len(blocks) == 2 * 64 and sum(x in (5, 6) for b in blocks for x in b["tokens"]) == 80
    assert pack_corpus(tokens, Layout(block_size=7, blocks_per_chunk=64, n_shards=2)).count() == 0
    assert [r["dropped"] for r in P.dropped_tokens(tokens, 2, layout.chunk_size).collect()] == [60, 60]
