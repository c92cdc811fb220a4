"""Corpus and subset scans (A1, A2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """A1: the text table, only the columns asked for."""
    return spark.read.parquet(path).select(*columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table stored in fewer splits than there are cores.

    Splitting and hashing words costs far more than moving the text once.  A
    table with splits for everyone, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def corpus_profile(docs: DataFrame, by: Sequence[str]) -> DataFrame:
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("text").cast("bigint")).alias("chars"),
        F.max(F.length("text").cast("bigint")).alias("longest"),
    )


def subset_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """A2: documents whose id is in a curated subset."""
    return docs.join(ids.select(key), key, "left_semi")


def write_subset(docs: DataFrame, path: str) -> None:
    docs.write.mode("errorifexists").parquet(path)
