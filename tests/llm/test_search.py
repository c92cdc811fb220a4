"""Lexical search, whitening and vector search against plain versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import support
from pyspark.sql import functions as F

from gristmill.llm import lexical, segment_search, whitening
from gristmill.llm.oracles import oracle_sql
from gristmill.llm.queries import op12_polarised_whitening, queries
from gristmill.operators.staging import small_batches

VECTORS = "vec_id long, embedding array<float>"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_interval_search", "op13_segment_search"])
def test_searches_equal_sql(spark, name):
    assert support.difference(queries()[name](spark, SMALL), support.connect(SMALL), oracle_sql()[name]) is None


# Ranked lexical search


def plain_search(docs, items, k):
    def terms(text):
        return [
            "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        ]

    held = [(i, Counter(terms(x))) for i, x in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, size = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in held:
            m = 100 - 50 + (50 * length * n) // size
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_lexical_search_equals_plain_scores(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)] + ["Ünï", "A1", "a1"]
    docs = [(rng.choice([None, *range(300)]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(600)]
    docs += [(450, " ".join(f"long{i} w{i % 9}" for i in range(900)))]  # longer than a shard
    docs += [(7, "same text here w1")] * 90 + [(1000 + i, "same text here w1") for i in range(90)]
    items = [(i, " .,".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(30)]
    items += [(3, "same W1"), (3, "same w1"), (None, "w2"), (99, None), (98, ""), (97, "absent")]
    shards = lexical.SHARD_BYTES
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    lexical.SHARD_BYTES = 2000
    try:
        index = lexical.build_index(table)
        assert index.count() > 5
        for k in (1, 50):
            got = sorted(map(tuple, lexical.search(index, asked, k).collect()), key=repr)
            assert got == sorted(plain_search(docs, items, k), key=repr)
    finally:
        lexical.SHARD_BYTES = shards


def test_lexical_search_in_blocks_of_queries(spark, monkeypatch):
    docs = [(i, f"common w{i % 7} w{i % 11}") for i in range(200)]
    items = [(str(i), f"w{i} common") for i in range(12)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 20)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = lexical.search(index, spark.createDataFrame(items, "item_id string, text string"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(plain_search(docs, items, 5))


def test_intervals_skip_documents_that_cannot_win():
    n = 20_000
    impact = np.arange(n) % 97 + 1
    impact[[5, 900, 15_000]] = 100_000
    rare = np.array([5, 900, 15_000])
    postings = lexical.Postings(
        np.array([n, 3]), np.concatenate([np.arange(n), rare]), np.concatenate([impact, np.full(3, 500)]), n
    )
    found = lexical.Ranking(3)
    seen = lexical.best_first(postings, np.array([0, 1]), np.zeros(n, bool), np.arange(n), found)
    assert found.ids.tolist() == [5, 900, 15_000] and found.score.tolist() == [100_500] * 3
    assert seen < 100


def test_ranks_by_search_equal_ranks_by_table(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [np.sort(rng.choice(50, size, replace=False)) for size in (1, 20, 50)]
    impacts = [rng.integers(1, 9, len(x)) for x in docs]
    found = []
    for cells in (lexical.CELLS, 1):
        monkeypatch.setattr(lexical, "CELLS", cells)
        r = lexical.Ranking(50)
        lists = lexical.Postings(np.array([len(x) for x in docs]), np.concatenate(docs), np.concatenate(impacts), 50)
        lexical.best_first(lists, np.arange(3), np.zeros(50, bool), np.arange(50), r)
        found.append((r.ids.tolist(), r.score.tolist()))
    total = np.zeros(50, int)
    for d, v in zip(docs, impacts):
        total[d] += v
    order = sorted((-s, i) for i, s in enumerate(total) if s)
    assert found[0] == found[1] == ([i for _, i in order], [-s for s, _ in order])


def test_lexical_term_counts_in_pieces(monkeypatch):
    text = ("Abc déf_x9 " * 50).encode()
    whole = lexical.term_counts(text)
    assert whole == {b"abc": 50, "déf".encode(): 50, b"x9": 50}
    monkeypatch.setattr(lexical, "WORD_BYTES", 7)
    assert lexical.term_counts(text) == whole


def test_lexical_search_edges(edge, empty, spark):
    items = spark.createDataFrame([(1, "straße cat", "x")], "item_id long, text string, score string")
    rows = lexical.search(lexical.build_index(edge), items).collect()
    want = plain_search([(r.doc_id, r.text) for r in edge.collect()], [(1, "straße cat")], 50)
    assert sorted(map(tuple, rows)) == sorted(want) and {r.doc_id for r in rows} == {1, 5, 6}
    assert lexical.search(lexical.build_index(empty), items).count() == 0
    nothing = lexical.search(lexical.build_index(edge), items.filter("item_id < 0"))
    assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]


# Whitening


def exact_covariance(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[a] for r in x) for a in range(d)]
    return [
        [Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n**3) for b in range(d)] for a in range(d)
    ]


def test_polarised_covariance_is_exact(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6) * 50
    values[3, 2] = 9e8  # squares beyond 64 bits
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    found = whitening.moments(table)
    got = whitening.covariance(found, whitening.pair_squares(table, found))
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in values.tolist()]
    assert found.n == 200 and found.sums == [sum(c) for c in zip(*x)]
    assert got.tolist() == [[float(c) for c in row] for row in exact_covariance(x)]


def test_whitening_query_against_numpy(spark):
    rows = op12_polarised_whitening(spark, SMALL).toPandas()
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(1024 * np.stack(given.embedding).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, columns = np.linalg.eigh(v)
    assert len(rows) == 8 * n and set(rows.component) == set(range(1, 9)) and set(rows.n) == {n}
    deviation = dict(zip(given.vec_id, ((n * x - sums) ** 2).sum(1)))
    assert all(deviation[i] == d for i, d in zip(rows.vec_id, rows.deviation))
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    for k in range(1, 9):
        own = rows[rows.component == k].sort_values("vec_id")
        want = centred @ columns[:, -k] / np.sqrt(values[-k])
        assert min(np.abs(own.whitened - want).max(), np.abs(own.whitened + want).max()) < 1e-8
        assert np.allclose(own.explained, values[-k] / np.trace(v), rtol=1e-10)


def test_whitening_edges(spark):
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    rows = good + [(None, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0])]
    rows += [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0])]
    rows += [(54, [float("inf"), 0.0, 0.0]), (55, [1e30, 0.0, 0.0]), (56, [1.0, 2.0])]
    table = spark.createDataFrame(rows, VECTORS).withColumn("component", F.lit("x")).withColumn("n", F.lit("x"))
    got = whitening.whiten(table).collect()
    assert Counter(r.vec_id for r in got) == Counter([*range(30), None, 4, 4] * 3)
    assert {r.n for r in got} == {33} and {r.component for r in got} == {1, 2, 3}
    assert whitening.whiten(table.filter("vec_id > 49")).select("n").distinct().collect()[0].n == 1
    assert whitening.whiten(table.filter("vec_id < 0")).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [2.0, 3.0]) for i in range(4)], VECTORS)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, 0.0, 0.0)}


def test_whitening_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i % 2) * 9e8]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 40 and {r.deviation for r in got} == {None}
    assert np.allclose(sorted({round(r.whitened, 9) for r in got}), [-1, 1])


# Exact vector search


def plain_nearest(rows, asked, k):
    def grid(v):
        good = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
        return [math.floor(256 * c) for c in v] if good else None

    held = [(i, grid(v)) for i, v in rows]
    out = []
    for qi, q in ((i, grid(v)) for i, v in asked):
        if q is None:
            continue
        scored = [
            (-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), i is None, i or 0)
            for i, x in held if x is not None and len(x) == len(q) and (qi is None or i != qi)
        ]
        out += [(qi, r, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("length", [1, 3, 8, 33])
def test_segment_search_equals_all_pairs(spark, length):
    rng = np.random.default_rng(length)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(700, length)))]
    rows += [(2000 + i, rows[3][1]) for i in range(60)]  # many equal scores
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.filter("vec_id % 50 = 0")
    want = sorted(plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5))
    assert sorted(map(tuple, segment_search.top_k(table, asked, 5, sample=asked).collect())) == want
    assert sorted(map(tuple, segment_search.top_k(table, asked, 5).collect())) == want


def test_segment_search_edges(spark, monkeypatch):
    rows = [(i, [float(i % 7), -1.0, 0.5]) for i in range(40)]
    rows += [(0, [3.0, 1.0, 1.0]), (0, [3.0, 1.0, 1.0]), (None, [9.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0])]
    rows += [(50, None), (100, []), (150, [1.0, None, 1.0]), (200, [float("nan"), 1.0, 1.0]), (250, [1.0, 2.0])]
    rows += [(300, [1e12, -1e12, 1e12]), (301, [-1e12, 1e12, -1e12])]  # products beyond 64 bits
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    asked = table.filter("vec_id % 50 = 0 or vec_id is null")
    own = [r for r in rows if r[0] is None or r[0] % 50 == 0]
    want = sorted(plain_nearest(rows, own, 5), key=repr)
    assert sorted(map(tuple, segment_search.top_k(table, asked).collect()), key=repr) == want
    monkeypatch.setattr(segment_search, "BLOCK_ENTRIES", 6)
    assert sorted(map(tuple, segment_search.top_k(table, asked, sample=asked).collect()), key=repr) == want
    assert segment_search.top_k(table, asked.filter("vec_id < 0")).count() == 0
    assert segment_search.top_k(table.filter("vec_id < 0"), asked).count() == 0


def test_segment_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (40, 37))
    exact = x @ x.T
    bounds = [segment_search.statistics(x, s) @ segment_search.statistics(x, s).T for s in (1, 4, 16)]
    for b in bounds:
        assert (b >= exact - 1e-6).all()
    assert bounds[0].sum() > bounds[1].sum() > bounds[2].sum()


def test_a_written_index_is_read_a_shard_at_a_time(spark):
    """a row group, a decoded batch and an Arrow batch held all shards of a partition."""
    shards, key = lexical.SHARD_BYTES, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    lexical.SHARD_BYTES = 2000
    try:
        texts = [(i, None if i % 5 == 0 else f"word{i} common " * 20) for i in range(60)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
        index = lexical.write_index(docs)
        held = spark.range(40).coalesce(1).selectExpr("repeat('x', 100000) AS wide")
        with small_batches(spark, 1 << 20):
            sizes = held.mapInArrow(lambda rows: (pa.RecordBatch.from_arrays([pa.array([r.num_rows])], names=["n"]) for r in rows), "n long").collect()
    finally:
        lexical.SHARD_BYTES = shards
    assert index.count() > 5
    for path in index.inputFiles():
        found = pq.ParquetFile(path.removeprefix("file://")).metadata
        assert [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [1] * found.num_rows
    assert max(r.n for r in sizes) < 20 and sum(r.n for r in sizes) == 40
    assert spark.conf.get(key, None) == before
