"""Console logs of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+0-9.eE,naif]+"
STEP_LINE = (
    rf"^step\s+(\d+)/(\d+) \| loss ({NUMBER})(?: \| selected ({NUMBER}))?"
    rf" \| lr ({NUMBER}) \| grad_norm ({NUMBER}) \| tok/s ({NUMBER})\s*$"
)
CHECKPOINT_LINE = r"^\[ckpt\] saved -> (.*?)/?step-(\d+)\s*$"


def read_log_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """``run, line`` of text files: a run is a file, or with ``by_folder`` a folder ``run=...``."""
    if by_folder:
        return spark.read.schema("value string, run string").text(path).select("run", F.col("value").alias("line"))
    run = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path).select(run.alias("run"), F.col("value").alias("line"))


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Text files, a folder per run, each in the order of its part of the table."""
    lines.select("run", "line").write.partitionBy("run").text(path)


def parse_steps(lines: DataFrame) -> DataFrame:
    """Typed rows of ``run, line``; ``selected`` is null where it is not logged."""

    def field(i: int, kind: str) -> Column:
        return F.regexp_replace(F.regexp_extract("line", STEP_LINE, i), ",", "").try_cast(kind)

    return lines.filter(F.col("line").rlike(STEP_LINE)).select(
        "run",
        field(1, "bigint").alias("step"),
        field(2, "bigint").alias("max_steps"),
        field(3, "double").alias("loss"),
        field(4, "double").alias("selected"),
        field(5, "double").alias("lr"),
        field(6, "double").alias("grad_norm"),
        field(7, "bigint").alias("tok_s"),
    )


def parse_checkpoints(lines: DataFrame) -> DataFrame:
    """Checkpoint announcements, not yet deduplicated."""
    return lines.filter(F.col("line").rlike(CHECKPOINT_LINE)).select(
        "run",
        F.regexp_extract("line", CHECKPOINT_LINE, 1).alias("folder"),
        F.regexp_extract("line", CHECKPOINT_LINE, 2).cast("bigint").alias("step"),
    )


def format_steps(steps: DataFrame) -> DataFrame:
    """Log lines as the trainer prints them, ``selected`` only where present."""
    selected = F.coalesce(F.format_string(" | selected %.3f", "selected"), F.lit(""))
    selected = F.when(F.col("selected").isNull(), "").otherwise(selected)
    line = F.concat(
        F.format_string("step %6d/%d | loss %.4f", "step", "max_steps", "loss"),
        selected,
        F.format_string(" | lr %.2e | grad_norm %.2f | tok/s %,d", "lr", "grad_norm", "tok_s"),
    )
    return steps.select("run", line.alias("line"))
