"""Run analytics over step logs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.running import range_cuts, row_rank, running_total, with_bucket, with_halo

# Fixed values.
WINDOW_BATCHES = 100
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
# Peak dense FLOP/s per device and precision (public data sheets).
DEVICE_PEAKS = {
    ("h100-sxm", "64-true"): 67e12,
    ("h100-sxm", "32-true"): 67e12,
    ("h100-sxm", "16-true"): 1.979e15 / 2,
    ("h100-sxm", "16-mixed"): 1.979e15 / 2,
    ("h100-sxm", "bf16-true"): 1.979e15 / 2,
    ("h100-sxm", "bf16-mixed"): 1.979e15 / 2,
    ("h100-sxm", "8-true"): 3.958e15 / 2,
    ("h100-sxm", "8-mixed"): 3.958e15 / 2,
    ("h100-pcie", "64-true"): 51e12,
    ("h100-pcie", "32-true"): 51e12,
    ("h100-pcie", "16-true"): 1.513e15 / 2,
    ("h100-pcie", "16-mixed"): 1.513e15 / 2,
    ("h100-pcie", "bf16-true"): 1.513e15 / 2,
    ("h100-pcie", "bf16-mixed"): 1.513e15 / 2,
    ("h100-pcie", "8-true"): 3.026e15 / 2,
    ("h100-pcie", "8-mixed"): 3.026e15 / 2,
    ("a100", "64-true"): 19.5e12,
    ("a100", "32-true"): 19.5e12,
    ("a100", "16-true"): 312e12,
    ("a100", "16-mixed"): 312e12,
    ("a100", "bf16-true"): 312e12,
    ("a100", "bf16-mixed"): 312e12,
    ("a10g", "32-true"): 31.2e12,
    ("a10g", "16-true"): 125e12,
    ("a10g", "16-mixed"): 125e12,
    ("a10g", "bf16-true"): 125e12,
    ("a10g", "bf16-mixed"): 125e12,
    ("v100-sxm", "64-true"): 7.8e12,
    ("v100-sxm", "32-true"): 15.7e12,
    ("v100-sxm", "16-true"): 125e12,
    ("v100-sxm", "16-mixed"): 125e12,
    ("v100-pcie", "64-true"): 7e12,
    ("v100-pcie", "32-true"): 14e12,
    ("v100-pcie", "16-true"): 112e12,
    ("v100-pcie", "16-mixed"): 112e12,
    ("v100s-pcie", "64-true"): 8.2e12,
    ("v100s-pcie", "32-true"): 16.4e12,
    ("v100s-pcie", "16-true"): 130e12,
    ("v100s-pcie", "16-mixed"): 130e12,
    ("t4", "32-true"): 8.1e12,
    ("t4", "16-true"): 65e12,
    ("t4", "16-mixed"): 65e12,
    ("t4", "8-true"): 130e12,
    ("t4", "int4"): 260e12,
    ("quadro rtx 5000", "32-true"): 11.2e12,
    ("quadro rtx 5000", "16-true"): 89.2e12,
    ("quadro rtx 5000", "16-mixed"): 89.2e12,
    ("tpu-v2", "any"): 45e12,
    ("tpu-v3", "any"): 123e12,
    ("tpu-v4", "any"): 275e12,
}


def rank_steps(
    log: DataFrame, run: Sequence[str], step: str, rows_per_bucket: int = 200_000, total: str | None = None
) -> DataFrame:
    """Add ``rank``, the 0-based position of each row in its run; optionally the run's length."""
    cuts = range_cuts(log, step, rows_per_bucket)
    bucketed = with_bucket(log, step, cuts, "__bucket")
    return row_rank(bucketed, run, "__bucket", [step], "rank", total, buckets=cuts.buckets).drop("__bucket")


def _back(column: str, reach: int, run: Sequence[str]) -> Column:
    return F.lag(column, reach).over(Window.partitionBy(*run, "span").orderBy("rank"))


def rolling_throughput(log: DataFrame, run: Sequence[str], world_size: int, window: int = WINDOW_BATCHES) -> DataFrame:
    """Rates over the last ``window`` batches, null until ``window + 1`` rows are held.

    Needs ``rank`` and the running ``elapsed`` (seconds), ``samples`` and
    ``lengths`` (tokens) per device.  ``tokens_per_sec`` is tokens over time.
    ``tokens_per_sec_by_length`` multiplies the sample rate by tokens per batch,
    which is the same only at one sample per batch.
    """
    spans = with_halo(log, "rank", window)
    seconds = F.nullif(F.col("elapsed") - _back("elapsed", window, run), F.lit(0.0))
    samples = F.col("samples") - _back("samples", window, run)
    tokens = F.col("lengths") - _back("lengths", window, run)
    world = F.lit(world_size)
    rated = (
        spans.withColumn("__s", seconds)
        .withColumn("device_batches_per_sec", F.lit(float(window)) / F.col("__s"))
        .withColumn("device_samples_per_sec", samples / F.col("__s"))
        .withColumn("device_tokens_per_sec", tokens / F.col("__s"))
        .withColumn("device_tokens_per_sec_by_length", samples / F.col("__s") * (tokens / F.lit(float(window))))
        .filter(~F.col("halo"))
        .drop("halo", "span", "__s")
    )
    for name in ("batches_per_sec", "samples_per_sec", "tokens_per_sec", "tokens_per_sec_by_length"):
        rated = rated.withColumn(name, F.col(f"device_{name}") * world)
    return rated


def interval_throughput(log: DataFrame, run: Sequence[str], world_size: int, interval: int) -> DataFrame:
    """Tokens of all ranks per second since the line logged ``interval`` steps ago.

    Needs ``rank`` (0-based), ``elapsed`` and ``lengths``; a line is logged at
    every ``interval``-th step, and the first one counts from the start.
    """
    spans = with_halo(log, "rank", interval)
    first = F.lit(0)
    seconds = F.nullif(F.col("elapsed") - F.coalesce(_back("elapsed", interval, run), first), F.lit(0.0))
    tokens = F.col("lengths") - F.coalesce(_back("lengths", interval, run), first)
    return (
        spans.withColumn("tokens", tokens * world_size)
        .withColumn("seconds", seconds)
        .withColumn("tok_s", F.col("tokens") / F.col("seconds"))
        .filter(~F.col("halo") & ((F.col("rank") + 1) % interval == 0))
        .drop("halo", "span")
    )


def learning_rate(
    step: Column | str, warmup: int, stable: int, max_steps: int, peak: float, floor: float
) -> Column:
    """Linear warm-up, a plateau, then cosine decay to ``floor``."""
    at = F.col(step) if isinstance(step, str) else step
    decay_from = warmup + stable
    done = (at - decay_from) / F.lit(float(max_steps - decay_from))
    decayed = F.lit(floor) + (F.lit(1.0) + F.cos(F.lit(math.pi) * done)) / 2 * F.lit(peak - floor)
    return (
        F.when(at < warmup, F.lit(peak) * at / F.lit(float(warmup)))
        .when(at < decay_from, F.lit(peak))
        .otherwise(decayed)
    )


def schedule_phase(step: Column | str, warmup: int, stable: int) -> Column:
    at = F.col(step) if isinstance(step, str) else step
    return F.when(at < warmup, "warmup").when(at < warmup + stable, "stable").otherwise("decay")


def audit_schedule(
    steps: DataFrame, warmup: int, stable: int, max_steps: int, peak: float, floor: float
) -> DataFrame:
    """Compare logged rates, printed with three digits, with the schedule."""
    expected = learning_rate("step", warmup, stable, max_steps, peak, floor)
    printed = F.format_string("%.2e", expected).cast("double")
    return steps.withColumn("expected_lr", expected).withColumn("lr_matches", printed == F.col("lr"))


def merge_steps(rows: DataFrame, step: str, order: str, columns: Sequence[str]) -> DataFrame:
    """E5: one row per step; of each column the last value present wins.

    Rows without a step are dropped, columns come out in sorted order.
    """
    latest = [
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)
        for name in sorted(columns)
    ]
    return rows.filter(F.col(step).isNotNull()).groupBy(step).agg(*latest)


# Metric names that may become columns.
MAX_METRICS = 2000


def metric_maps(lines: DataFrame, line: str = "value", out: str = "metrics") -> DataFrame:
    """Add the metrics of a JSON line as MAP<STRING, DOUBLE>; null for a line that is no object.

    A value that is no number is present without a value.
    """
    texts = F.from_json(F.col(line), "map<string,string>")
    return lines.withColumn(out, F.transform_values(texts, lambda _, v: v.try_cast("double")))


def merge_metrics(rows: DataFrame, step: str, order: str, metrics: str = "metrics") -> DataFrame:
    """E5 with the metrics found in the data: one row per step, one column per metric.

    ``metrics`` is a MAP<STRING, DOUBLE>.  Of each metric the last row in ``order`` that
    has the key wins, also without a value.  Columns are the union of all keys of rows
    with a step, sorted; a key called like the step column is the step's own and left
    out.  Rows without a step are dropped; one without metrics keeps its step.
    """
    known = rows.filter(F.col(step).isNotNull()).select(F.col(step).alias("__step"), F.col(order).alias("__order"), F.col(metrics).alias("__metrics"))
    cells = known.select("__step", "__order", F.explode_outer("__metrics").alias("__name", "__value"))
    last = cells.groupBy("__step", "__name").agg(F.max_by("__value", "__order").alias("__value"))
    found = last.select("__name").filter(F.col("__name").isNotNull() & (F.col("__name") != step)).distinct()
    names = sorted(r[0] for r in found.limit(MAX_METRICS + 1).collect())
    if len(names) > MAX_METRICS:
        raise ValueError(f"more than {MAX_METRICS} metrics; a table cannot have a column for each")
    entries = F.collect_list(F.when(F.col("__name").isNotNull(), F.struct("__name", "__value")))
    merged = last.groupBy("__step").agg(F.map_from_entries(entries).alias("__all"))
    return merged.select(F.col("__step").alias(step), *[F.try_element_at("__all", F.lit(n)).alias(n) for n in names])


def compute_ledger(runs: DataFrame, subsets: DataFrame, selections: DataFrame) -> DataFrame:
    """Unique, forward and backward tokens per run.

    ``runs(run, subset, steps, tokens_per_step, method)``; ``subsets(subset,
    unique_tokens)``; ``selections(subset, method, selected_ratio)``.  A run
    without a method trains on every forward token.
    """
    forward = F.col("steps") * F.col("tokens_per_step")
    kept = F.coalesce(F.col("selected_ratio"), F.lit(1.0))
    return (
        runs.join(subsets, "subset")
        .join(selections, ["subset", "method"], "left")
        .select(
            "run",
            "unique_tokens",
            forward.alias("forward_tokens"),
            F.round(forward * kept).cast("bigint").alias("backward_tokens"),
            (forward / F.col("unique_tokens")).alias("passes"),
        )
    )


def sequence_flops(params: int, n_layer: int, n_embd: int, block_size: int) -> int:
    """FLOPs of one sequence: two per parameter and token, plus attention."""
    return 2 * params * block_size + 4 * n_layer * n_embd * block_size**2


def step_flops(
    trainable: int, frozen: int, n_layer: int, n_embd: int, block_size: int, training: bool = True
) -> int:
    shape = (n_layer, n_embd, block_size)
    times = (3, 2) if training else (1, 1)
    return times[0] * sequence_flops(trainable, *shape) + times[1] * sequence_flops(frozen, *shape)


def utilization(
    log: DataFrame,
    run: Sequence[str],
    world_size: int,
    device: str,
    precision: str,
    window: int = WINDOW_BATCHES,
) -> DataFrame:
    """FLOP/s over the last ``window`` batches and their share of the device's peak.

    Needs ``rank``, ``elapsed`` and ``flops`` (one batch on one device).
    """
    # Some devices have one peak for every precision.
    peak = DEVICE_PEAKS.get((device, precision), DEVICE_PEAKS.get((device, "any")))
    spans = with_halo(log, "rank", window)
    at = Window.partitionBy(*run, "span").orderBy("rank")
    seconds = F.nullif(F.col("elapsed") - _back("elapsed", window, run), F.lit(0.0))
    done = F.sum("flops").over(at.rowsBetween(1 - window, 0))
    return (
        spans.withColumn("device_flops_per_sec", done / seconds)
        .filter(~F.col("halo"))
        .drop("halo", "span")
        .withColumn("flops_per_sec", F.col("device_flops_per_sec") * world_size)
        .withColumn("mfu", F.col("device_flops_per_sec") / F.lit(peak))
    )


def elapsed_time(log: DataFrame, run: Sequence[str], bucket: str, step: str, unit: str = "hours") -> DataFrame:
    """Training, validation and total time up to each row.

    Needs running ``elapsed`` and per-row ``eval_seconds``; ``bucket`` follows ``step``.
    """
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unit must be one of {', '.join(UNIT_SECONDS)}, got {unit!r}")
    per = F.lit(float(UNIT_SECONDS[unit]))
    summed = running_total(log, run, bucket, [step], F.col("eval_seconds"), start="__before")
    val = F.col("__before") + F.col("eval_seconds")
    return (
        summed.withColumn("time_train", F.col("elapsed") / per)
        .withColumn("time_val", val / per)
        .withColumn("time_total", (F.col("elapsed") + val) / per)
        .drop("__before")
    )


def checkpoint_steps(checkpoints: DataFrame) -> DataFrame:
    """Each saved step once; the last one is often announced twice."""
    return checkpoints.dropDuplicates(["run", "step"])


def compare_runs(left: DataFrame, right: DataFrame, step: str = "step", value: str = "loss") -> DataFrame:
    """Two runs side by side; steps that only one of them logged are kept."""
    return (
        left.select(step, F.col(value).alias("left_value"))
        .join(right.select(step, F.col(value).alias("right_value")), step, "full_outer")
        .withColumn("difference", F.col("left_value") - F.col("right_value"))
    )
