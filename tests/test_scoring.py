import json
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions.losses import cross_entropy, predictive_entropy
from gristmill.operators import joins
from gristmill.operators import scoring as K
from gristmill.operators.packing import next_token_pairs
from gristmill.operators.tokenizing import codec_from_dir, detokenize, tokenize


def test_losses_from_logits(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 0.0, -1000.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(x, 2) for x in logits], "x array<double>, y int")
    got = df.select(cross_entropy("x", "y").alias("l"), predictive_entropy("x").alias("h")).collect()
    for row, x in zip(got, logits):
        shifted = np.array(x) - max(x)
        logp = shifted - math.log(np.exp(shifted).sum())
        assert row["l"] == pytest.approx(-logp[2])
        assert row["h"] == pytest.approx(-(np.exp(logp) * logp).sum(), abs=1e-12)


def _plain(x, label):
    x = np.array(x, float)
    shifted = x - x.max()
    logp = shifted - math.log(np.exp(shifted).sum())
    share = np.exp(logp)
    return -logp[label], -(share[share > 0] * logp[share > 0]).sum()


def test_losses_at_a_real_vocabulary_and_in_slices(spark):
    """32,000 logits, whole and in slices that arrive in any order, in seconds."""
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(60, 32_000)) * rng.choice([0.01, 1, 30], size=(60, 1))
    labels = rng.integers(0, 32_000, 60)
    edges = [0, 1, 9_000, 9_001, 24_000, 32_000]
    whole = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(logits, labels))], "i int, x array<double>, y long")
    cut = [(i, int(y), a, x[a:b].tolist()) for i, (x, y) in enumerate(zip(logits, labels)) for a, b in zip(edges, edges[1:])]
    rng.shuffle(cut)
    rows = [(int(i), int(y), int(a), list(x)) for i, y, a, x in cut]
    slices = spark.createDataFrame(rows, "i int, label long, first_id int, logits array<double>")
    begun = time.perf_counter()
    one = whole.select("i", cross_entropy("x", "y").alias("l"), predictive_entropy("x").alias("h")).collect()
    many = K.score_logit_slices(slices, ["i"]).collect()
    assert time.perf_counter() - begun < 60
    assert len(one) == len(many) == 60
    for i, loss, entropy in [*map(tuple, one), *map(tuple, many)]:
        assert (loss, entropy) == pytest.approx(_plain(logits[i], labels[i]), rel=1e-9, abs=1e-9)


def test_logit_slices_edges(spark):
    inf = float("inf")
    rows = [
        (1, 2, 0, [0.0, 1.0]), (1, 2, 2, [5.0]), (1, 2, 3, []), (1, 2, 3, None),  # empty and null slices
        (2, 0, 0, None), (3, None, 0, [1.0, 1.0]), (4, 9, 0, [1.0, 1.0]),  # no logits, no label, label outside
        (5, 1, 0, [-inf, -inf]), (5, 1, 2, [3.0, 3.0]), (6, 0, 0, [None, 700.0, 0.0]), (7, 1, 0, [900.0]), (7, 1, 1, [-900.0]),
    ]
    table = spark.createDataFrame(rows, "i int, label int, first_id int, logits array<double>").withColumn("loss", F.lit("x"))
    got = {r.i: (r.loss, r.entropy) for r in K.score_logit_slices(table, ["i"]).collect()}
    assert got[1] == pytest.approx(_plain([0, 1, 5], 2)) and got[2] == (None, None)
    assert got[3] == (None, pytest.approx(math.log(2))) and got[4] == (None, pytest.approx(math.log(2)))
    assert got[5][0] == inf and got[5][1] == pytest.approx(math.log(2))
    assert got[6] == (None, pytest.approx(0, abs=1e-12))
    assert got[7] == pytest.approx((1800.0, 0.0), abs=1e-12)
    assert K.score_logit_slices(table.filter("i < 0"), ["i"]).count() == 0


def test_masked_logits_have_no_weight(spark):
    inf = float("inf")
    df = spark.createDataFrame([([-inf, 1.0, 1.0],), ([],), (None,), ([-inf, -inf],)], "x array<double>")
    got = [r.h for r in df.select(predictive_entropy("x").alias("h")).collect()]
    assert got == [pytest.approx(math.log(2)), None, None, None]


def _sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(t) for t in rng.integers(0, 5, 40)]) for i in range(30)]
    return rows, spark.createDataFrame(rows, "block_no int, tokens array<int>")


def _by_hand(rows, vocab, alpha):
    pairs = Counter((a, b) for _, t in rows for a, b in zip(t, t[1:]))
    totals = Counter()
    for (a, _), n in pairs.items():
        totals[a] += n
    return lambda a, b: (pairs[a, b] + alpha) / (totals[a] + alpha * vocab)


def test_bigram_scores(spark):
    rows, seqs = _sequences(spark)
    base = K.fit_bigram(seqs, 7, 0.1)
    ref = K.fit_bigram(seqs.filter("block_no < 3"), 7, 0.1)
    p, q = _by_hand(rows, 7, 0.1), _by_hand(rows[:3], 7, 0.1)
    positions = next_token_pairs(seqs, ["block_no"])
    extra = spark.createDataFrame([(99, 0, 6, 6), (99, 1, 0, 6)], positions.schema)
    got = K.score_with_bigrams(positions.unionByName(extra), base, ref).collect()
    assert len(got) == 30 * 39 + 2
    for r in got:
        a, b = r["prev"], r["label"]
        assert r["loss"] == pytest.approx(-math.log(p(a, b)), abs=1e-8)
        assert r["ref_loss"] == pytest.approx(-math.log(q(a, b)), abs=1e-8)
        entropy = -sum(q(a, c) * math.log(q(a, c)) for c in range(7))
        assert r["ref_entropy"] == pytest.approx(entropy, abs=1e-8)
        assert r["excess"] == pytest.approx(r["loss"] - r["ref_loss"], abs=1e-8)


def test_vocabularies_must_agree(spark):
    _, seqs = _sequences(spark)
    with pytest.raises(ValueError):
        K.score_with_bigrams(next_token_pairs(seqs, []), K.fit_bigram(seqs, 7), K.fit_bigram(seqs, 8))


def test_heavy_contexts_are_divided(spark):
    """Any number of parts gives the same scores, and no part holds many rows of a pair."""
    rows, seqs = _sequences(spark)
    hot = spark.createDataFrame([(100, [3, 3] * 300)], seqs.schema)
    seqs = seqs.unionByName(hot)
    base, ref = K.fit_bigram(seqs, 32_000), K.fit_bigram(seqs.filter("block_no < 3"), 32_000)
    positions = next_token_pairs(seqs, ["block_no"])
    whole = K.score_with_bigrams(positions, base, ref).collect()
    divided = K.score_with_bigrams(positions, base, ref, rows_per_key=50)
    assert sorted(whole) == sorted(divided.collect()) and len(whole) == 30 * 39 + 599
    keyed = positions.withColumn("copies", joins.copies_for(F.lit(610), 50))
    table = spark.createDataFrame([(3, 3, 13, 1.0)], "prev int, label int, copies int, v double")
    found = joins.salted_lookup(keyed, table, ["prev", "label"], "copies", positions.columns)
    assert found.count() == len(whole)
    assert found.filter("prev = 3 and label = 3 and v is null").count() == 0
    part = F.pmod(F.xxhash64(*positions.columns), F.lit(13))
    fullest = positions.filter("prev = 3 and label = 3").groupBy(part).count().agg(F.max("count")).first()[0]
    assert fullest < 100


def test_frequent_keys_are_divided(spark):
    """Equals a plain inner join; keys with more than their part of the rows go to many parts."""
    rows = spark.createDataFrame([(i % 7 if i % 2 else None if i % 10 == 0 else 3, i) for i in range(2000)], "k int, i int")
    table = rows.filter("k < 6").groupBy("k").agg(F.max("i").alias("m"), F.count(F.lit(1)).alias("n"))
    plain = rows.join(table.drop("n"), "k").select("k", "i", "m").collect()
    for keys_apart, least in ((4096, 64), (4, 1), (4096, 1 << 20)):
        found = joins.weighted_lookup(rows, table, "k", "n", 2000, ["i"], keys_apart, least)
        assert found.columns == ["k", "i", "m"] and sorted(found.collect()) == sorted(plain)
    assert joins.weighted_lookup(rows.limit(0), table.limit(0), "k", "n", 0, ["i"]).count() == 0


def test_one_plan_whatever_the_vocabulary(spark):
    """Positions are shuffled by pair once; there is no union of plans."""
    _, seqs = _sequences(spark)
    positions = next_token_pairs(seqs, ["block_no"])
    plans = []
    for vocab in (7, 32_000):
        model = K.fit_bigram(seqs, vocab)
        plan = K.score_with_bigrams(positions, model, model)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan
        plans.append(plan.count("Join "))
    assert plans[0] == plans[1]


def test_ids_outside_the_vocabulary_are_an_error(spark):
    _, seqs = _sequences(spark)
    with pytest.raises(Exception, match="not an id of a vocabulary of 4"):
        K.fit_bigram(seqs, 4).pairs.collect()


def test_plug_in_scorer(spark):
    blocks = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(10)], "block_no int, tokens array<int>")

    def scorer():
        def score(tokens):
            label = tokens[:, 1:].astype(float)
            return label * 2, label, label * 0 + 0.5

        return score

    got = K.score_blocks(blocks, scorer, ["block_no"], batch_rows=4).orderBy("block_no", "pos").collect()
    assert len(got) == 20
    assert got[3].asDict() == {
        "block_no": 1, "pos": 1, "prev": 2, "label": 3,
        "loss": 6.0, "ref_loss": 3.0, "ref_entropy": 0.5, "excess": 3.0,
    }


@pytest.fixture
def vocabulary(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = {w: i for i, w in enumerate(["<unk>", "<s>", "</s>", "red", "green", "blue"])}
    model = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, unk_token="<unk>"))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    model.save(str(tmp_path / "tokenizer.json"))
    names = {"bos_token": "<s>", "eos_token": {"content": "</s>"}}
    (tmp_path / "tokenizer_config.json").write_text(json.dumps(names))
    return str(tmp_path)


def test_plug_in_tokenizer(spark, vocabulary):
    docs = spark.createDataFrame([(0, "red blue"), (1, ""), (2, None)], "doc_id int, text string")
    codec = codec_from_dir(vocabulary)
    plain = {r["doc_id"]: (r["tokens"], r["n_tokens"]) for r in tokenize(docs, codec).collect()}
    assert plain == {0: ([3, 5, 2], 3), 1: ([2], 1), 2: ([2], 1)}
    cut = tokenize(docs, codec, bos=True, max_length=3).filter("doc_id = 0").first()
    assert cut["tokens"] == [1, 3, 5]
    text = detokenize(tokenize(docs, codec, eos=False), codec).filter("doc_id = 0").first()["text"]
    assert text == "red blue"


def test_sentencepiece_file_wins(spark, vocabulary, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    (tmp_path / "text.txt").write_text("red green blue\n" * 50)
    spm.SentencePieceTrainer.train(
        input=str(tmp_path / "text.txt"), model_prefix=str(tmp_path / "tokenizer"), vocab_size=13, minloglevel=2
    )
    docs = spark.createDataFrame([(0, "red blue")], "doc_id int, text string")
    codec = codec_from_dir(vocabulary)
    coded = tokenize(docs, codec)
    direct = spm.SentencePieceProcessor(model_file=str(tmp_path / "tokenizer.model"))
    assert coded.first()["tokens"] == direct.encode("red blue") + [direct.eos_id()]
    assert detokenize(tokenize(docs, codec, eos=False), codec).first()["text"] == "red blue"


def test_missing_tokenizer(tmp_path):
    with pytest.raises(FileNotFoundError):
        codec_from_dir(str(tmp_path))()


def test_builtin_tokens(spark):
    docs = spark.createDataFrame([(0, " a\tb \n a"), (1, None)], "doc_id int, text string")
    first, second = tokenize(docs, bos=True).orderBy("doc_id").collect()
    assert first["tokens"][0] == 1 and first["tokens"][-1] == 2
    assert first["tokens"][1] == first["tokens"][3] != first["tokens"][2]
    assert (first["n_tokens"], second["tokens"], second["n_tokens"]) == (5, [1, 2], 2)
    cut = tokenize(docs, max_length=2).filter("doc_id = 0").first()
    assert len(cut["tokens"]) == cut["n_tokens"] == 2 and 2 not in cut["tokens"]


def test_a_plug_in_runs_once(spark, vocabulary):
    docs = spark.createDataFrame([(0, "red blue")], "doc_id int, text string")
    coded = tokenize(docs, codec_from_dir(vocabulary)).filter("n_tokens > 0")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and coded.count() == 1
