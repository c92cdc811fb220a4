import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.operators import losses as L
from gristmill.operators.selection import select_tokens, with_top_ratio, with_top_ratio_spread


def _kept(spark, scores, ratio):
    df = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)], "b int, i int, s double")
    masked = with_top_ratio(df, [(F.col("s"), ratio)], ["b"], "m")
    return [r["m"] for r in masked.orderBy("i").collect()]


def test_ties_are_kept(spark):
    assert _kept(spark, [3, 1, 3, 2], 0.5) == [True, False, True, False]
    assert _kept(spark, [1, 1, 1, 0], 0.5) == [True, True, True, False]
    assert _kept(spark, [5, 4], 1.0) == [True, True]
    assert _kept(spark, [5, 4], 0.01) == [True, False]


def test_ratio_is_taken_in_doubles(spark):
    assert sum(_kept(spark, range(100), 0.07)) == 8


@pytest.mark.parametrize("ratio", [0.07, 0.29, 0.6, 0.7, 1 / 3, 1e-9, 1.0])
def test_threshold_law(spark, ratio):
    """Many batches at once, with ties, against the k-th largest score."""
    rng = random.Random(3)
    batches = [[float(rng.randint(0, 20)) for _ in range(rng.randint(1, 130))] for _ in range(300)]
    rows = [(b, s) for b, scores in enumerate(batches) for s in scores]
    df = spark.createDataFrame(rows, "b int, s double")
    got = with_top_ratio(df, [(F.col("s"), ratio)], ["b"]).filter("selected").groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("limit")
    )
    want = {}
    for b, scores in enumerate(batches):
        limit = sorted(scores, reverse=True)[max(1, math.ceil(len(scores) * ratio)) - 1]
        want[b] = (sum(s >= limit for s in scores), limit)
    assert {r["b"]: (r["n"], r["limit"]) for r in got.collect()} == want


@pytest.mark.parametrize("ratio", [0.0, -1.0, 1.1])
def test_ratio_out_of_range(spark, ratio):
    with pytest.raises(ValueError):
        with_top_ratio(spark.range(3), [(F.col("id"), ratio)], ["id"])
    with pytest.raises(ValueError):
        select_tokens(_scores(spark), loss_ratio=ratio)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_scores_must_be_finite(spark, bad):
    with pytest.raises(PySparkException, match="not finite"):
        _kept(spark, [1.0, bad], 0.5)


def _scores(spark):
    rows = [(0, 0, 5.0, 1.0, 0.1), (0, 1, 4.0, 4.0, 0.2), (0, 2, 9.0, 2.0, 3.0), (0, 3, 1.0, 3.0, 4.0)]
    return spark.createDataFrame(rows, "shard int, pos int, loss double, ref_loss double, ref_entropy double")


def test_methods(spark):
    def chosen(method, **ratios):
        got = select_tokens(_scores(spark), method, ["shard"], **ratios)
        return [r["pos"] for r in got.filter("selected").orderBy("pos").collect()]

    assert chosen("excess_loss", excess_ratio=0.5) == [0, 2]
    assert chosen("self_reference_intersection", loss_ratio=0.5, entropy_ratio=0.5) == [0]
    assert chosen("high_intersection", loss_ratio=0.5, entropy_ratio=0.5) == [3]
    with pytest.raises(ValueError, match="unknown"):
        chosen("best")


def test_masked_loss_without_selection(spark):
    none = _scores(spark).withColumn("selected", F.lit(False))
    row = L.masked_loss(none, ["shard"]).first()
    assert (row["loss"], row["n_selected"], row["n_positions"]) == (0.0, 0, 4)


def test_interval_is_weighted(spark):
    rows = [(0, 10.0, 1, 4), (1, 2.0, 3, 4), (2, 6.0, 2, 4)]
    batches = spark.createDataFrame(rows, "step bigint, loss_sum double, n_selected bigint, n_positions bigint")
    got = {r["interval_no"]: r for r in L.interval_loss(batches, "step", 2).collect()}
    assert got[0]["loss"] == 3.0 and got[0]["selected_ratio"] == 0.5
    assert got[1]["loss"] == 3.0


def test_ignored_targets(spark):
    rows = [(0, 2.0, 5), (0, 4.0, 6), (0, 100.0, -1), (0, 100.0, -1)]
    row = L.masked_ce_mean(spark.createDataFrame(rows, "g int, loss double, target int"), ["g"]).first()
    assert (row["mean_kept"], row["mean_all"], row["n_kept"]) == (3.0, 1.5, 2)


@pytest.mark.parametrize("ratio", [0.07, 0.5, 1.0, 1e-9])
def test_spread_mask_equals_the_window(spark, ratio):
    rng = random.Random(9)
    values = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, 1.0, 1.0, 1.0 + 2**-52, -3.5]
    rows = [(rng.choice([None, 0, 0, 0, 1]), i, rng.choice(values) if rng.random() < 0.6 else rng.gauss(0, 10)) for i in range(800)]
    df = spark.createDataFrame(rows, "g int, i int, s double").withColumn("prefix", F.lit("x")).repartition(4)
    ranked = [(F.col("s"), ratio), (-F.col("s") * F.col("i") % 7, 0.8)]
    want = {r.i: r.selected for r in with_top_ratio(df, ranked, ["g"]).collect()}
    got = with_top_ratio_spread(df, ranked, ["g"])
    assert got.columns == [*df.columns, "selected"]
    assert {r.i: r.selected for r in got.collect()} == want
    whole = with_top_ratio(df.withColumn("one", F.lit(1)), ranked, ["one"])
    assert {r.i: r.selected for r in with_top_ratio_spread(df, ranked, []).collect()} == {r.i: r.selected for r in whole.collect()}


def test_spread_mask_edges(spark):
    df = spark.createDataFrame([(1, float("nan"))], "g int, s double")
    with pytest.raises(Exception, match="not finite"):
        with_top_ratio_spread(df, [(F.col("s"), 0.5)], ["g"]).collect()
    with pytest.raises(ValueError):
        with_top_ratio_spread(df, [(F.col("s"), 0.0)], ["g"])
    assert with_top_ratio_spread(df.filter("g > 1"), [(F.col("s"), 0.5)], ["g"]).count() == 0
