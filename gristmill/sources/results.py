"""Evaluation result files (A5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.files import open_uri, write_whole

# Declared, not inferred: type names that differ only in case ("Geometry" and
# "geometry") must both survive, which they do as map keys.
SCHEMA = """
    num_samples bigint, num_scores bigint, timeout_samples bigint, empty_samples bigint,
    acc double, type_acc map<string, double>, time_use_in_second double, time_use_in_minite string
"""


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``<root>/<dataset>/*_metrics.json``."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(f"{root}/*/*_metrics.json")
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return files.withColumn("dataset", folder)


def write_results(report: DataFrame, root: str) -> DataFrame:
    """One ``<root>/<dataset>/<dataset>_metrics.json`` per row of ``accuracy_report``.

    Returns ``dataset, path``, lazily: the files are written when it is materialised.
    """
    fields = [c for c in report.columns if c != "dataset"]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = open_uri(root)
        for frame in frames:
            paths = []
            for name, text in zip(frame["dataset"], frame["body"]):
                files.create_dir(f"{folder}/{name}", recursive=True)
                paths.append(f"{folder}/{name}/{name}_metrics.json")
                write_whole(files, paths[-1], text.encode())
            yield pd.DataFrame({"dataset": frame["dataset"], "path": paths})

    named = report.select(F.coalesce("dataset", F.lit("unnamed")).alias("dataset"), body.alias("body"))
    return named.mapInPandas(write, "dataset string, path string")


def type_accuracy(results: DataFrame) -> DataFrame:
    return results.select("dataset", F.explode("type_acc").alias("type", "acc"))
