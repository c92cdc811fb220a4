import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evals as V
from gristmill.operators import runs as E
from gristmill.operators.losses import rolling_loss


def _rate(spark, step, *plan):
    return spark.range(1).select(E.learning_rate(F.lit(step), *plan)).first()[0]


def test_learning_rate(spark):
    plan = (300, 8000, 8576, 8e-5, 8e-6)
    assert f"{_rate(spark, 10, *plan):.2e}" == "2.67e-06"
    assert _rate(spark, 300, *plan) == _rate(spark, 8299, *plan) == 8e-5
    assert _rate(spark, 8438, *plan) == pytest.approx(4.4e-5)
    assert _rate(spark, 8576, *plan) == pytest.approx(8e-6)


def _steady(spark, n=250):
    """A batch of 4 samples and 40 tokens every half second."""
    return spark.range(n).select(
        F.lit("r").alias("run"),
        F.col("id").alias("rank"),
        ((F.col("id") + 1) * 0.5).alias("elapsed"),
        ((F.col("id") + 1) * 4).alias("samples"),
        ((F.col("id") + 1) * 40).alias("lengths"),
        F.lit(1e12).alias("flops"),
    )


def test_throughput(spark):
    rows = E.rolling_throughput(_steady(spark), ["run"], 8).orderBy("rank").collect()
    assert rows[99]["tokens_per_sec"] is None and rows[100]["tokens_per_sec"] == 640.0
    assert rows[249]["device_samples_per_sec"] == 8.0 and rows[249]["batches_per_sec"] == 16.0
    # Right only when lengths grow by one sequence a batch.
    assert rows[249]["tokens_per_sec_by_length"] == 2560.0
    lines = E.interval_throughput(_steady(spark), ["run"], 8, 10).orderBy("rank").collect()
    assert len(lines) == 25 and {r["tok_s"] for r in lines} == {640.0}


def test_utilization(spark):
    rows = E.utilization(_steady(spark), ["run"], 8, "a100", "bf16-true").orderBy("rank").collect()
    assert rows[99]["mfu"] is None
    assert rows[150]["device_flops_per_sec"] == 2e12 and rows[150]["mfu"] == pytest.approx(2 / 312)
    assert E.utilization(_steady(spark), ["run"], 8, "unknown", "x").filter("mfu is not null").count() == 0


def test_flops():
    one = E.sequence_flops(1000, 2, 8, 16)
    assert one == 2 * 1000 * 16 + 2 * 4 * 8 * 16**2
    frozen = E.sequence_flops(10, 2, 8, 16)
    assert E.step_flops(1000, 10, 2, 8, 16) == 3 * one + 2 * frozen
    assert E.step_flops(1000, 10, 2, 8, 16, training=False) == one + frozen


def test_perplexity(spark):
    log = spark.range(5).select(F.lit(0).alias("run"), F.col("id").alias("rank"), F.col("id").cast("double").alias("loss"))
    rows = rolling_loss(log, ["run"], "rank", 2).orderBy("rank").collect()
    assert [r["train_loss"] for r in rows] == [0.0, 0.5, 1.5, 2.5, 3.5]
    assert rows[1]["train_ppl"] == pytest.approx(math.exp(0.5))


def test_elapsed(spark):
    log = _steady(spark, 4).withColumn("eval_seconds", F.lit(30.0)).withColumn("bucket", F.expr("rank div 2"))
    rows = E.elapsed_time(log, ["run"], "bucket", "rank", "minutes").orderBy("rank").collect()
    assert [r["time_val"] for r in rows] == [0.5, 1.0, 1.5, 2.0]
    assert rows[3]["time_total"] == pytest.approx(2 + 2 / 60)
    with pytest.raises(ValueError):
        E.elapsed_time(log, ["run"], "bucket", "rank", "weeks")


def test_metrics_found_in_the_data(spark):
    lines = [
        (1, '{"step": 1, "loss": 2.0, "acc": 0.5}'), (2, '{"step": 1, "loss": 1.5, "lr": 1e-3}'), (3, '{"step": 2, "a b.c": 7}'),
        (4, '{"loss": 9.0}'), (5, '{"step": 2, "loss": "none"}'), (6, "no json"), (7, '{"step": 3}'), (8, '{"step": 1, "acc": null}'),
    ]
    table = E.metric_maps(spark.createDataFrame(lines, "seq int, value string"))
    table = table.withColumn("step", F.col("metrics")["step"].cast("int"))
    merged = E.merge_metrics(table, "step", "seq")
    assert merged.columns == ["step", "a b.c", "acc", "loss", "lr"]
    rows = {r.step: tuple(r)[1:] for r in merged.collect()}
    # The last line with the key wins, also where it has no value.
    assert rows == {1: (None, None, 1.5, 1e-3), 2: (7.0, None, None, None), 3: (None, None, None, None)}
    assert E.merge_metrics(table.filter("seq = 6"), "step", "seq").columns == ["step"]


def test_step_merge(spark):
    rows = [(1, 0, 1.0, None), (0, 1, 5.0, 6.0), (1, 2, None, 2.0), (1, 3, 3.0, None), (None, 4, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "step int, seq int, loss double, acc double")
    merged = E.merge_steps(df, "step", "seq", ["loss", "acc"])
    assert merged.columns == ["step", "acc", "loss"]
    assert sorted(map(tuple, merged.collect())) == [(0, 6.0, 5.0), (1, 2.0, 3.0)]


def test_ledger(spark):
    runs = spark.createDataFrame(
        [("full", "a", 10, 100, "none"), ("twice", "b", 10, 100, "none"), ("chosen", "a", 10, 100, "m")],
        "run string, subset string, steps bigint, tokens_per_step bigint, method string",
    )
    subsets = spark.createDataFrame([("a", 1000), ("b", 400)], "subset string, unique_tokens bigint")
    kept = spark.createDataFrame([("a", "m", 0.6)], "subset string, method string, selected_ratio double")
    got = {r["run"]: tuple(r)[1:] for r in E.compute_ledger(runs, subsets, kept).collect()}
    assert got == {
        "full": (1000, 1000, 1000, 1.0), "twice": (400, 1000, 1000, 2.5), "chosen": (1000, 1000, 600, 1.0),
    }


def test_run_comparison(spark):
    left = spark.createDataFrame([(1, 2.0), (2, 1.5)], "step int, loss double")
    right = spark.createDataFrame([(2, 1.0), (3, 0.5)], "step int, loss double")
    got = sorted(map(tuple, E.compare_runs(left, right).collect()))
    assert got == [(1, 2.0, None, None), (2, 1.5, 1.0, 0.5), (3, None, 0.5, None)]


def test_accuracy(spark):
    rows = [("d", "x", "ok", 1), ("d", "x", "ok", 0), ("d", None, "timeout", 0), ("d", "y", "empty", None)]
    df = spark.createDataFrame(rows, "dataset string, type string, status string, score int")
    got = {(r["type"], r["whole_dataset"]): r for r in V.accuracy(df).collect()}
    whole = got[None, True]
    assert (whole["num_samples"], whole["num_scores"], whole["acc"]) == (4, 3, 33.3)
    assert (whole["timeout_samples"], whole["empty_samples"]) == (1, 1)
    assert got["x", False]["acc"] == 50.0 and got[None, False]["num_samples"] == 1
    report = V.accuracy_report(df.filter("type is not null")).first()
    assert report["type_acc"] == {"x": 50.0, "y": None}


TASKS = ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9"]


def test_leaderboard(spark):
    full = [5.3, 19.9, 32.7, 42.1, 14.7, 11.9, 20.4, 25.0, 3.5]
    rows = [("a", t, x) for t, x in zip(TASKS, full)] + [("b", t, 1.0) for t in TASKS[:-1]]
    df = spark.createDataFrame(rows, "model string, task string, acc double")
    got = {r["model"]: r for r in V.leaderboard(df, TASKS).collect()}
    assert got["a"]["average"] == 19.5 and got["b"]["average"] is None and got["b"]["t9"] is None
    delta = V.baseline_delta(df, "a", "b").filter("task = 't2'").first()
    assert (delta["acc"], delta["baseline_acc"], delta["delta"]) == (19.9, 1.0, 18.9)
    lone = V.baseline_delta(df, "b", "a").filter("task = 't9'").collect()
    assert [(r["acc"], r["baseline_acc"], r["delta"]) for r in lone] == [(None, 3.5, None)]


def test_peak_of_a_device_with_one_precision(spark):
    log = spark.createDataFrame([(0, i, float(i), 1e12, "a") for i in range(4)], "step long, rank long, elapsed double, flops double, run string")
    got = E.utilization(log, ["run"], 1, "tpu-v4", "bf16-true", window=2).filter("rank = 3").first()
    assert got["mfu"] is not None
