"""Scores of whole corpora: by hand, and without moving positions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import scoring as K
from gristmill.operators.packing import next_token_pairs
from gristmill.plans import jobs as J

VOCAB = 50
LAYOUT = J.Layout(block_size=4, blocks_per_chunk=4, n_shards=2, world_size=1, workers=2, buffer_files=2, micro_batch=3, grad_accum=1)


def _tokens(spark, docs=60):
    """Two documents in three are one token repeated: a pair with most of the positions."""
    rng = np.random.default_rng(1)
    rows = [(i, [7] * 20 if i % 3 else [int(t) for t in rng.integers(0, VOCAB, 21)]) for i in range(docs)]
    return spark.createDataFrame([(i, len(t), t) for i, t in rows], "doc_id long, n_tokens long, tokens array<int>")


def _pairs(lists):
    return Counter((a, b) for t in lists for a, b in zip(t, t[1:]))


def _expected(pairs, alpha=0.1):
    totals = Counter()
    for (a, _), n in pairs.items():
        totals[a] += n

    def p(a, b):
        return (pairs[a, b] + alpha) / (totals[a] + alpha * VOCAB)

    return p, lambda a: -sum(p(a, b) * math.log(p(a, b)) for b in range(VOCAB))


@pytest.mark.parametrize("own", [False, True])
def test_corpus_scores_by_hand(spark, monkeypatch, own):
    """Many small regions and buckets; a pair is spread over all of them."""
    monkeypatch.setattr(J, "REGION_POSITIONS", 24)
    monkeypatch.setattr(J, "PART_POSITIONS", 100)
    tokens = _tokens(spark)
    part = tokens.filter("doc_id < 9")
    got = J.score_corpus(tokens, None if own else part, LAYOUT, VOCAB).collect()
    blocks = [r.tokens for r in J.pack_corpus(tokens, LAYOUT).collect()]
    base = _pairs(blocks)
    p, h = _expected(base)
    q, g = (p, h) if own else _expected(_pairs(r.tokens for r in part.collect()))
    assert Counter((r.prev, r.label) for r in got) == base
    assert len({(r.shard, r.chunk_no, r.block_no, r.pos) for r in got}) == len(got) > 500
    for r in got:
        loss, ref = -math.log(p(r.prev, r.label)), -math.log(q(r.prev, r.label))
        assert (r.loss, r.ref_loss, r.ref_entropy) == pytest.approx((loss, ref, g(r.prev)), abs=1e-8)
        assert r.excess == pytest.approx(r.loss - r.ref_loss, abs=2e-9)


def _before_explode(df):
    return df._jdf.queryExecution().executedPlan().toString().split("posexplode(")[0]


def test_positions_are_not_shuffled(spark):
    """Blocks move as arrays; from the explode to the mask nothing does."""
    tokens = _tokens(spark)
    scores = J.score_corpus(tokens, tokens.filter("doc_id < 9"), LAYOUT, VOCAB)
    assert "Exchange" not in _before_explode(J.select_tokens(scores, "excess_loss"))
    read = J.select_in_read_order(tokens, tokens.filter("doc_id < 9"), LAYOUT, VOCAB, "high_intersection", passes=2)
    assert "Exchange" not in _before_explode(read)


def test_a_block_is_counted_once_however_often_it_is_read(spark):
    tokens = _tokens(spark, 150)
    once, thrice = (J.select_in_read_order(tokens, None, LAYOUT, VOCAB, passes=n).collect() for n in (1, 3))
    assert len(once) > 0 and len(thrice) == 3 * len(once)
    scores = {(r.shard, r.chunk_no, r.block_no, r.pos): (r.prev, r.label, r.loss, r.ref_entropy) for r in once}
    assert {(r.shard, r.chunk_no, r.block_no, r.pos): (r.prev, r.label, r.loss, r.ref_entropy) for r in thrice} == scores
    base = _pairs(r.tokens for r in J.pack_corpus(tokens, LAYOUT).collect())
    p, _ = _expected(base)
    assert all(r.loss == pytest.approx(-math.log(p(r.prev, r.label)), abs=1e-8) for r in once)


def test_odd_blocks(spark):
    """Empty, null and single-token blocks have no positions; ids outside are an error."""
    rows = [(0, 0, [1, 2, 1, 2]), (0, 0, []), (0, 0, None), (None, 0, [1, 2]), (0, 1, [3])]
    blocks = spark.createDataFrame(rows, "shard int, region long, tokens array<int>")
    counted = K.with_pair_counts(blocks, None, ["shard", "region"], 5, 2)
    assert counted.count() == 5
    got = next_token_pairs(counted.filter("size(tokens) > 0"), ["shard"], K.count_columns(counted)).collect()
    assert sorted((r.prev, r.label, (r.n_base_high << 15) + r.n_base_low) for r in got) == [(1, 2, 3), (1, 2, 3), (1, 2, 3), (2, 1, 1)]
    with pytest.raises(Exception, match="not an id of a vocabulary of 2"):
        K.with_pair_counts(blocks, None, ["shard", "region"], 2, 2).collect()


@pytest.mark.parametrize("vocab", [VOCAB, 100_000])
def test_large_counts_and_vocabularies(spark, vocab):
    """Counts beyond the low half, ids beyond SMALLINT."""
    top = vocab - 1
    blocks = spark.createDataFrame([(0, 0, [top] * 40_001)], "shard int, region long, tokens array<int>")
    base = K.fit_bigram(blocks, vocab)
    counted = K.with_pair_counts(blocks, None, ["shard", "region"], vocab, 2)
    positions = next_token_pairs(counted, ["shard"], K.count_columns(counted))
    got = K.score_counted(positions, K.context_totals(blocks), base, base).select("prev", "label", "loss").distinct()
    assert dict(got.dtypes) == {"prev": "int", "label": "int", "loss": "double"}
    loss = -math.log((40_000 + 0.1) / (40_000 + 0.1 * vocab))
    assert [tuple(r) for r in got.collect()] == [(top, top, pytest.approx(loss, abs=1e-8))]


def test_buckets_divide_frequent_tokens():
    for vocab in (7, 32_000, 30_030):
        buckets = K.pair_buckets(12, vocab)
        assert buckets >= 12
        token = 3
        for pairs in (token * vocab + np.arange(vocab), np.arange(vocab) * vocab + token):
            assert np.bincount(pairs % buckets).max() <= vocab // buckets + 1


def test_rounding_in_doubles(spark):
    values = [0.0, 1.23456789049, 1.23456789051, -1.23456789051, 12.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in df.select("i", K._rounded(F.col("v")).alias("v")).orderBy("i").collect()]
    assert got == [0.0, 1.23456789, 1.234567891, -1.234567891, 12.5, None]


def test_packed_numbers_come_back():
    """Lists of pairs and counts moved as 8 bytes a number."""
    rng = np.random.default_rng(3)
    for values in ([], [0], [-1, 2**62, -(2**63), 7], rng.integers(0, 9, 5000)):
        values = np.array(values, np.int64)
        assert K._unpacked(K._packed(values)).tolist() == values.tolist()
    doubles = np.array([0.5, np.nan, -3.25])
    assert np.array_equal(K._unpacked(K._packed(doubles), np.float64), doubles, equal_nan=True)
    steps = np.diff(np.sort(rng.choice(10**7, 50_000, replace=False)), prepend=0)
    assert len(K._packed(steps)) < 2 * len(steps) and len(K._packed(np.ones(50_000, np.int64))) < 500


def test_listed_models_equal_counted_ones(spark, monkeypatch):
    """Long and empty sequences, several lists for a bucket, a pair with most positions."""
    monkeypatch.setattr(K, "LISTED_POSITIONS", 64)
    rows = [(t,) for t in ([1, 2] * 40, [], None, [3], [1, 2, 4], [VOCAB - 1] * 90)]
    seqs = spark.createDataFrame(rows, "tokens array<int>").repartition(3)
    plain, listed = K.fit_bigram(seqs, VOCAB), K.fit_listed(seqs, VOCAB, 0.1, 7)
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(listed.pairs) == as_rows(plain.pairs)
    assert listed.lists.count() == listed.lists.select("bucket").distinct().count()
    known = {r.prev: tuple(r)[1:] for r in plain.contexts.collect()}
    assert {r.prev: tuple(r)[1:] for r in listed.contexts.collect()} == {k: pytest.approx(v) for k, v in known.items()}
    with pytest.raises(Exception, match="not an id of a vocabulary of 9"):
        K.fit_listed(seqs, 9, 0.1, 7)


def test_totals_return_packed_and_without_pairs(spark):
    """Eight bytes and more for each pair of a region went out, and 24 came back."""
    rng = np.random.default_rng(2)
    rows = [(0, i, [int(t) for t in rng.integers(0, VOCAB, 3000)]) for i in range(4)]
    blocks = spark.createDataFrame(rows, "shard int, region long, tokens array<int>")
    near, buckets = ["shard", "region"], K.pair_buckets(2, VOCAB)
    counted = K.count_pairs(blocks, near, VOCAB, buckets)
    reference = K.fit_listed(blocks.filter("region = 1"), VOCAB, 0.1, buckets)
    totals = K.total_pairs(counted, reference, near, VOCAB, buckets)
    assert totals.columns == [*near, "bucket", "n_base", "n_ref"]
    base = Counter(r.n for r in K.fit_bigram(blocks, VOCAB).pairs.collect())
    got = [n for r in totals.filter("region = 0").collect() for n in K._unpacked(r.n_base)]
    assert max(got) >= max(base) and all(len(r.n_base) < 4 * len(K._unpacked(r.n_base)) for r in totals.collect())
    rows = lambda df: sorted((r.region, r.bucket, r.n_base, r.n_ref) for r in df.collect())
    plain = K.fit_bigram(blocks.filter("region = 1"), VOCAB)
    assert rows(K.total_pairs(counted, plain, near, VOCAB, buckets)) == rows(totals)
    assert dict((r.prev, r.t_base) for r in K.listed_totals(counted, VOCAB, buckets).collect()) == dict(
        (r.prev, r.t_base) for r in K.context_totals(blocks).collect()
    )


def test_visits_of_blocks(spark):
    """Blocks that come twice, once and never; a block that comes twice has all visits each time."""
    rows = [(0, 0, b, [1, 2, b]) for b in (4, 2, 2, 9)] + [(0, 1, 20, [])]
    blocks = spark.createDataFrame(rows, "shard int, region long, shard_block long, tokens array<int>")
    seen = [(0, 0, 2, 5), (0, 0, 4, 6), (0, 0, 2, 7), (0, 0, 3, 8)]
    visits = spark.createDataFrame(seen, "shard int, region long, shard_block long, iter long")
    got = K.with_pair_counts(blocks, None, ["shard", "region"], 10, 2, visits).collect()
    assert sorted((r.shard_block, sorted(v.iter for v in r.visits)) for r in got) == [(2, [5, 7]), (2, [5, 7]), (4, [6]), (9, []), (20, [])]


def test_visits_meet_their_blocks_without_a_join(spark):
    """A join by block moved every block once more, and positions of one partition were sorted together."""
    tokens = _tokens(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = J.select_in_read_order(tokens, tokens.filter("doc_id < 9"), LAYOUT, VOCAB, "excess_loss", passes=2)
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert "shard_block" not in "".join(line for line in plan.splitlines() if "Join" in line)
    parts = J._parts(tokens)
    placed = [line for line in plan.splitlines() if "hashpartitioning(gpu_rank" in line]
    assert any(f", {2 * parts}), REPARTITION_BY_NUM" in line for line in placed)
