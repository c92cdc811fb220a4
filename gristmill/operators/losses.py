"""Aggregated losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.losses import perplexity
from gristmill.operators.running import with_halo


def masked_loss(selected: DataFrame, batch: Sequence[str] = ("shard", "batch_no")) -> DataFrame:
    """Per batch, the sums and ``sum(loss * mask) / max(sum(mask), 1)``."""
    sums = selected.groupBy(*batch).agg(
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("loss"))), F.lit(0.0)).alias("loss_sum"),
        F.count_if("selected").alias("n_selected"),
        F.count(F.lit(1)).alias("n_positions"),
    )
    return sums.withColumn("loss", F.col("loss_sum") / F.greatest("n_selected", F.lit(1)))


def interval_loss(batches: DataFrame, step: str, interval: int) -> DataFrame:
    """Weighted totals over ``interval`` steps and all readers.

    Takes the sums of ``masked_loss`` plus a 0-based ``step``; the ratio of the
    sums, not a mean of per-batch means.
    """
    return (
        batches.groupBy(F.expr(f"{step} div {interval}").alias("interval_no"))
        .agg(
            F.sum("loss_sum").alias("loss_sum"),
            F.sum("n_selected").alias("n_selected"),
            F.sum("n_positions").alias("n_positions"),
        )
        .withColumn("loss", F.col("loss_sum") / F.greatest("n_selected", F.lit(1)))
        .withColumn("selected_ratio", F.col("n_selected") / F.greatest("n_positions", F.lit(1)))
    )


def masked_ce_mean(losses: DataFrame, groups: Sequence[str], target: str = "target", ignore: int = -1) -> DataFrame:
    """Mean loss when some targets are ignored.

    ``mean_kept`` divides by the targets that count; ``mean_all`` (the chunked
    variant) lets ignored ones add 0 but keeps them in the denominator.
    """
    counted = F.when(F.col(target) != ignore, F.col("loss"))
    return losses.groupBy(*groups).agg(
        F.avg(counted).alias("mean_kept"),
        (F.coalesce(F.sum(counted), F.lit(0.0)) / F.count(F.lit(1))).alias("mean_all"),
        F.count(counted).alias("n_kept"),
        F.count(F.lit(1)).alias("n_all"),
    )


def rolling_loss(log: DataFrame, run: Sequence[str], rank: str, width: int) -> DataFrame:
    """Mean of the last ``width`` losses of a run and its perplexity.

    ``rank`` is the 0-based position in the run (``row_rank``); the series is cut
    into overlapping spans, so a long run is spread over many tasks.
    """
    spans = with_halo(log, rank, width - 1)
    recent = Window.partitionBy(*run, "span").orderBy(rank).rowsBetween(1 - width, 0)
    return (
        spans.withColumn("train_loss", F.avg("loss").over(recent))
        .filter(~F.col("halo"))
        .drop("halo", "span")
        .withColumn("train_ppl", perplexity("train_loss"))
    )
