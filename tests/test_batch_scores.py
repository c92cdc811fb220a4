"""Scores with a row per micro-batch: the same values and masks, and nothing is shuffled for them."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as W
from gristmill.operators import scoring as K
from gristmill.operators.selection import select_tokens, with_top_ratio, with_top_ratio_spread
from gristmill.plans import jobs as J
from test_placed_scores import LAYOUT, VOCAB, _tokens

KEYS = ["shard", "batch_no", "chunk_no", "block_no", "pos"]


def _both(spark, monkeypatch, own):
    """Rows of positions and of batches, from many small regions."""
    monkeypatch.setattr(J, "REGION_POSITIONS", 24)
    monkeypatch.setattr(J, "PART_POSITIONS", 100)
    tokens = _tokens(spark)
    part = None if own else tokens.filter("doc_id < 9")
    return [J.score_corpus(tokens, part, LAYOUT, VOCAB, by_batch=b) for b in (False, True)]


def _marks(df):
    return {tuple(r[c] for c in KEYS): r.selected for r in df.collect()}


@pytest.mark.parametrize("own", [False, True])
def test_batches_have_the_scores_of_positions(spark, monkeypatch, own):
    rows, batches = _both(spark, monkeypatch, own)
    names = [*KEYS, "prev", "label", "loss", "ref_loss", "ref_entropy", "excess"]
    want, got = (sorted(tuple(r[n] for n in names) for r in df.collect()) for df in (rows, K.batch_positions(batches)))
    assert len(got) == len(want) > 500
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert np.allclose([r[7:] for r in got], [r[7:] for r in want], atol=2e-9)
    assert batches.count() == rows.select("shard", "batch_no").distinct().count()


@pytest.mark.parametrize("method", ["excess_loss", "self_reference_intersection", "high_intersection"])
def test_batches_have_the_masks_of_positions(spark, monkeypatch, method):
    rows, batches = _both(spark, monkeypatch, False)
    plan = select_tokens(batches, method)._jdf.queryExecution().executedPlan().toString()
    # Neither a sort nor an exchange above the regions' scores.
    above = plan.split("FlatMapCoGroupsInArrow")[0]
    assert "Exchange" not in above and "Window" not in above
    positions = K.batch_positions(batches)
    assert _marks(select_tokens(batches, method)) == _marks(select_tokens(positions, method))


def test_whole_corpus_as_one_batch(spark, monkeypatch):
    _, batches = _both(spark, monkeypatch, False)
    ranked = [("loss", 0.07), ("-ref_entropy", 0.7)]
    by_row = [(F.col("loss"), 0.07), (-F.col("ref_entropy"), 0.7)]
    positions = K.batch_positions(batches).cache()
    for batch in ([], ["shard"]):
        want = _marks(with_top_ratio(positions.withColumn("all", F.lit(0)), by_row, batch or ["all"]))
        assert _marks(with_top_ratio_spread(batches, ranked, batch)) == want
    positions.unpersist()


def test_spread_thresholds_of_lists_of_any_sign(spark):
    """Ties, signs, both zeros, null batches, a batch in several rows, one without positions."""
    rng = np.random.default_rng(3)
    lists = [(g, [float(x) for x in np.round(rng.normal(0, 1, int(n)), 2)] + [0.0, -0.0]) for g in (0, 0, 1, None) for n in (50, 9)]
    rows = [(g, list(range(len(s))), s) for g, s in lists] + [(2, [], [])]
    df = spark.createDataFrame(rows, "g int, pos array<int>, s array<double>").withColumn("i", F.monotonically_increasing_id())
    flat = K.batch_positions(df)
    for name, column in (("s", F.col("s")), ("-s", -F.col("s"))):
        want = {(r.i, r.pos): r.selected for r in with_top_ratio(flat, [(column, 0.3)], ["g"]).collect()}
        got = with_top_ratio_spread(df, [(name, 0.3)], ["g"])
        assert {(r.i, r.pos): r.selected for r in got.collect()} == want
    bad = spark.createDataFrame([(0, [0], [math.nan])], "g int, pos array<int>, s array<double>")
    for mark in (with_top_ratio, with_top_ratio_spread):
        with pytest.raises(Exception, match="not finite"):
            mark(bad, [("s", 0.5)], ["g"]).collect()
        with pytest.raises(ValueError):
            mark(bad, [("s", 0.0)], ["g"])


def test_ids_of_many_texts_together():
    rng = np.random.default_rng(5)
    signs = list(" \t\r\n  aböc 　é😀\x0b\x00")
    texts = ["".join(rng.choice(signs, int(n))) for n in rng.integers(0, 30, 500)] + ["", None, "  ", "a", " a", "a "]

    def ids(text):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(W.WORD_PATTERN, text or "")]
        return [*[W.FIRST_WORD_ID + h % (W.VOCAB_SIZE - W.FIRST_WORD_ID) for h in hashes], W.EOS_ID]

    assert W._hashed(pa.array(texts)).to_pylist() == [ids(t) for t in texts]
    assert W._hashed(pa.array(texts).slice(7, 100)).to_pylist() == [ids(t) for t in texts[7:107]]


def test_hashed_ids_are_token_ids(spark, monkeypatch):
    monkeypatch.setattr(W, "TEXT_BYTES", 16)
    texts = ["one two  three", None, "", " x", "word " * 40, "end\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = df.select(W.hashed_ids("t").alias("a"), W.token_ids("t").alias("b")).collect()
    assert len(got) == 6 and all(r.a == r.b for r in got)


def test_shortened_scores_round_as_written(spark):
    values = [0.0, 1.2345675, 1.234567499, -1.2345675, 2.0000005, 0.0000015, 10.3734915, 12.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.a == r.b for r in df.select(K.shortened(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b")).collect())
