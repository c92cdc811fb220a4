"""Evaluation analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(scores: DataFrame) -> DataFrame:
    """Per dataset, and per (dataset, type), from ``dataset, type, status, score``.

    ``type`` is null in the row of the whole dataset.  One pass: the grouping
    sets are expanded before the map-side combine.
    """
    return (
        scores.groupingSets([["dataset"], ["dataset", "type"]], "dataset", "type")
        .agg(
            F.grouping_id().alias("__level"),
            F.count(F.lit(1)).alias("num_samples"),
            F.count("score").alias("num_scores"),
            F.count_if(F.col("status") == "timeout").alias("timeout_samples"),
            F.count_if(F.col("status") == "empty").alias("empty_samples"),
            F.round(F.avg(F.col("score").cast("double")) * 100.0, 1).alias("acc"),
        )
        .withColumn("whole_dataset", F.col("__level") > 0)
        .drop("__level")
    )


def accuracy_report(scores: DataFrame) -> DataFrame:
    """The shape of a result file: one row per dataset with a ``type_acc`` map."""
    rows = accuracy(scores)
    types = (
        rows.filter(~F.col("whole_dataset"))
        .groupBy("dataset")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "acc")))).alias("type_acc"))
    )
    return rows.filter("whole_dataset").drop("type", "whole_dataset").join(types, "dataset", "left")


def leaderboard(results: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """``model, task, acc`` to one row per model with an unweighted mean.

    A model that lacks a task has no average.
    """
    wide = results.groupBy("model").pivot("task", list(tasks)).agg(F.first("acc"))
    total = sum((F.col(f"`{t}`") for t in tasks), F.lit(0.0))
    return wide.withColumn("average", F.round(total / F.lit(float(len(tasks))), 1))


def baseline_delta(results: DataFrame, model: str, baseline: str) -> DataFrame:
    """accuracy of a model minus that of the baseline, per task.

    A task that one side lacks stays, with nulls there and no difference.
    """
    ours = results.filter(F.col("model") == model).select("task", F.col("acc").alias("acc"))
    theirs = results.filter(F.col("model") == baseline).select("task", F.col("acc").alias("baseline_acc"))
    return ours.join(theirs, "task", "full").withColumn("delta", F.round(F.col("acc") - F.col("baseline_acc"), 1))
