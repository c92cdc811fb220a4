"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor's
result, which is written as Parquet and read again in between.  All but the last return
the columns of ``documents``; the last returns the pieces with their places.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, language, packing, secret_scan, simhash
from gristmill.operators.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; the length follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learned languages.  The others go: null, empty
    and letterless texts, and texts that no language fits clearly."""
    rows = _documents(docs)
    model = language.matrix(language.learn(rows))
    found = language.identify(rows, model)
    return _documents(found.filter(language.accepted(F.col("lang_pred"), F.col("score"), LEAST_LANGUAGE_SCORE)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; null ids come
    last, and rows that share the id are told apart by a digest of the row."""
    return simhash.one_of_each(_documents(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that a benchmark item has too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_documents(docs), benchmark)
    clean = decontaminate.remove_contamination(found)
    return _with_text(clean)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mask in place of every secret."""
    return _with_text(secret_scan.redact_secrets(_documents(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(_documents(docs), tokenizer))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", remove_benchmark),
    ("secret_scan", mask_secrets),
    ("best_fit_pack", pack),
]

# Hashing by XXH64, learned scores and a vocabulary are beyond SQL; tests hold the rows
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
