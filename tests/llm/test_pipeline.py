"""The staged pipeline against a plain version of its decisions."""

import duckdb
import numpy as np
import public_tokenizers
from test_corpus import _slow_groups, _slow_simhash
from test_scans import _naive_hits
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gristmill.llm import decontaminate, secret_scan

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = []
    for name, apply in pipeline.STAGES:
        path_before = docs
        docs = pipeline.stage(apply(spark, path_before, SF_DIR), name)
        found.append(docs)
    for step in found[:-1]:
        assert step.columns == list(pipeline.COLUMNS)
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    known, single, clean, masked = [{r.doc_id: r for r in step.collect()} for step in found[:-1]]
    # Every text with letters is in a learned language here.
    assert set(known) == {i for i, r in start.items() if r.text and any(c.isalpha() for c in r.text)}
    ids = sorted(known)
    label = _slow_groups([_slow_simhash(known[i].text) for i in ids])
    assert set(single) == {min(ids[j] for j in range(len(ids)) if label[j] == k) for k in set(label)}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    ids = sorted(single)
    assert sorted(clean) == ids
    hits = _naive_hits([single[i].text for i in ids], items)
    for i, (n, hit, _) in zip(ids, hits):
        assert len(decontaminate.words_of(clean[i].text.encode())) == n - hit
        assert hit or clean[i].text == single[i].text
        assert clean[i].n_chars == len(clean[i].text)
    assert sorted(masked) == ids
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(found[2]).collect()}
    for i in ids:
        assert ("[SECRET]" in masked[i].text) == bool(spans[i]) and (spans[i] or masked[i].text == clean[i].text)
    packed = found[-1].collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(plain.encode(masked[i].text, add_special_tokens=False).ids) + 1 for i in ids}
    for i in ids:
        own = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == lengths[i]
    assert np.unique([r.sequence_id for r in packed if r.offset == 0]).size == sum(r.offset == 0 for r in packed)


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in pipeline.run(spark, SF_DIR).columns


def test_stages_take_odd_and_empty_rows(spark, edge, empty):
    odd = edge.selectExpr("doc_id", "text", "lang", "cast(null as string) as source", "cast(null as long) as n_chars", "block", "row")
    for docs, most in ((odd, 9), (odd.filter("doc_id < 0"), 0)):
        for name, apply in pipeline.STAGES[:-1]:
            kept = apply(spark, docs, SF_DIR)
            assert kept.columns == list(pipeline.COLUMNS) and kept.count() <= most, name
        assert pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= most


def test_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    """Repeated ids with different texts, null ids, exact copies."""
    near, clean, other = "the cat sat on the mat today", "a wholly different line of text", "nothing like the rest at all here"
    rows = [(1, near), (2, near), (2, clean), (None, near), (None, other), (None, other), (3, None), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = [(1, near), (2, clean), (3, None), (None, other)]
    for parts in (1, 5):
        kept = pipeline.drop_near_copies(spark, docs.repartition(parts), SF_DIR)
        assert kept.columns == list(pipeline.COLUMNS)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)
