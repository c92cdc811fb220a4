"""What a plug-in's worker holds does not follow the size of the batches Spark hands over."""

import gc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.operators import scoring as K
from gristmill.operators import tokenizing as Z
from gristmill.operators.selection import select_tokens


def _letters():
    class Letters:
        bos_id, eos_id = 1, 2

        def encode(self, string):
            # Lists of this codec that are still held when the next text comes.
            held = 0
            if string.endswith("999"):
                held = sum(1 for x in gc.get_objects() if type(x) is list and x and type(x[0]) is int and x[0] == 777_000)
            return [777_000, held, *map(ord, string)]

        def decode(self, ids):
            return "".join(map(chr, ids[2:]))

    return Letters


def test_ids_are_not_kept_as_lists(spark):
    """Of 3,000 texts in one batch, the ids of few are lists at a time; results are in order."""
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    codec = _letters()
    coded = Z.tokenize(docs, codec, eos=False)
    back = Z.detokenize(coded, codec)
    got = back.collect()
    assert all(r.text == str(r.doc_id) for r in got) and len(got) == 3000
    assert max(r.tokens[1] for r in got) < 100


def test_parts_are_bounded():
    parts = list(Z._parts(iter([pa.array(range(Z.ROWS * 2 + 1)), pa.array([], pa.int64())])))
    assert [len(p) for p in parts] == [Z.ROWS, Z.ROWS, 1]
    assert [v for p in parts for v in p.to_pylist()] == list(range(Z.ROWS * 2 + 1))


def _scorer():
    def label_scorer():
        def score(tokens):
            label = tokens[:, 1:]
            return label * 2.0, label, label % 3

        return score

    return label_scorer


@pytest.mark.parametrize("cells", [1, 7, 1 << 18])
def test_scored_blocks_move_as_arrays(spark, monkeypatch, cells):
    monkeypatch.setattr(K, "SCORED_CELLS", cells)
    blocks = spark.createDataFrame([(i % 5, i, [i, i + 1, i + 2]) for i in range(53)], "b int, i int, tokens array<int>")
    scores = K.score_blocks(blocks, _scorer(), ["b", "i"], batch_rows=4, place=["b"])
    got = sorted((r.i, r.pos, r.prev, r.label, r.loss, r.ref_loss) for r in scores.collect())
    assert got == [(i, p, i + p, i + p + 1, 2.0 * (i + p + 1), i + p + 1.0) for i in range(53) for p in (0, 1)]
    plan = select_tokens(scores, batch=["b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("posexplode")[0]


def test_blocks_of_unlike_length_are_an_error(spark):
    blocks = spark.createDataFrame([(0, [1, 2, 3]), (1, [1])], "i int, tokens array<int>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        K.score_blocks(blocks, _scorer(), ["i"]).collect()
    assert np.allclose(_scorer()()(np.array([[1, 2]]))[0], 4.0)
