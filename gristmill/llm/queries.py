"""Registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import ctw
from gristmill.llm import decontaminate as D
from gristmill.llm import lexical
from gristmill.llm import language as L
from gristmill.llm import merkle as M
from gristmill.llm import packing as P
from gristmill.llm import pii
from gristmill.llm import secret_scan as X
from gristmill.llm import segment_search as N
from gristmill.llm import simhash as S
from gristmill.llm import warc
from gristmill.llm.common import remainder
from gristmill.llm.longest_match import token_counts
from gristmill.llm.whitening import whiten

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def op1_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Code length of every document under a context tree of four fifths of them."""
    return ctw.score_documents(_table(spark, sf, "documents", "doc_id", "text"))


def op2_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of every document and its edited text, and how much their trees share."""
    pairs = M.with_next(_table(spark, sf, "documents", "doc_id", "text"))
    changed = pairs.withColumn("edited", M.edited(F.col("text"), F.col("next_text")))
    hashed = changed.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        M.tree(F.col("text")).alias("own"),
        M.tree(F.col("edited")).alias("edited"),
        M.tree(F.col("next_text")).alias("next"),
    )
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    return hashed.select(
        *["doc_id", "n_chars", "edited_sha256"],
        own["root"].alias("fingerprint"),
        edited["root"].alias("edited_fingerprint"),
        M.likeness(own, edited).alias("near_edited"),
        M.likeness(own, following).alias("near_next"),
    )


def op4_skip_chain_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: by patterns, and by the field that starts from them."""
    docs = _table(spark, sf, "documents", "doc_id", "text")
    found = pii.find_personal_data(docs, pii.potentials(pii.learn(docs)))
    return found.select(
        "doc_id",
        *[pii.count_of("base_spans", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.shown("base_spans"), 256).alias("base_sha256"),
        pii.shown("pii_spans").alias("spans"),
    )


def op5_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(warc.responses_of(_table(spark, sf, "pages", "page_id", "url", "html")))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document; a quarter of them is held out of learning."""
    docs = _table(spark, sf, "documents", "doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    model = L.matrix(L.learn(docs.filter(~held & F.col("lang").isNotNull())))
    found = L.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_fm_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that occur in a benchmark window, and the items found."""
    found = D.find_contamination(
        _table(spark, sf, "documents", "doc_id", "text"), _table(spark, sf, "benchmark", "item_id", "text")
    )
    hit = D.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op7_certified_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 ids."""
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return P.pack(P.token_pieces(docs, public_tokenizers.path(VOCABULARY)))


def op8_randomness_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: by patterns, and by tests of randomness."""
    found = X.find_secrets(_table(spark, sf, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        *[X.count_of("base", k).alias(f"n_{k}") for k in X.KINDS[:3]],
        F.sha2(X.shown("base"), 256).alias("base_sha256"),
        X.shown("spans").alias("spans"),
    )


def op9_pivot_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = S.near_duplicates(_table(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", S.hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


def op10_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_words", "n_tokens")


def op11_interval_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = lexical.write_index(_table(spark, sf, "documents", "doc_id", "text"))
    return lexical.search(index, _table(spark, sf, "benchmark", "item_id", "text"), 50)


def op12_polarised_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding on the eight leading whitened components."""
    return whiten(_table(spark, sf, "embeddings", "vec_id", "embedding"))


def op13_segment_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five best neighbours of every fiftieth embedding among all others."""
    vectors = _table(spark, sf, "embeddings", "vec_id", "embedding")
    asked = vectors.filter(F.col("vec_id") % 50 == 0)
    return N.top_k(vectors, asked, 5, sample=asked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_context_tree,
        op2_merkle,
        op3_language_id,
        op4_skip_chain_pii,
        op5_warc_derivatives,
        op6_fm_decontaminate,
        op7_certified_packing,
        op8_randomness_secrets,
        op9_pivot_simhash,
        op10_longest_match,
        op11_interval_search,
        op12_polarised_whitening,
        op13_segment_search,
    )
    return {q.__name__: q for q in named}
