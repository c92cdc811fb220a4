import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import clustering as C
from gristmill.operators import sampling as S
from gristmill.plans.jobs import curate, lloyd_fit, ml_fit


def _points(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def _best_cap(sizes, budget):
    return min(range(max(sizes) + 1), key=lambda n: (abs(budget - sum(min(n, s) for s in sizes)), n))


def _assigned(spark, sizes):
    rows = [(c, p) for (p, c), n in sizes.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c1 int, c2 int")


def test_cap_of_a_known_case(spark):
    sizes = {(0, i): n for i, n in enumerate([106, 129, 145, 620])}
    got = {r["c1"]: r["quota"] for r in C.allocate(_assigned(spark, sizes), ["c1"], 500).collect()}
    assert got == {0: 106, 1: 129, 2: 132, 3: 132}


@pytest.mark.parametrize("seed", range(6))
def test_allocation_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {(c % 3, c): rng.choice([1, 2, 5, 30, 200]) for c in range(rng.randint(1, 9))}
    total = sum(sizes.values())
    target = rng.randint(0, total + 3)
    got = {r["c1"]: r["quota"] for r in C.allocate(_assigned(spark, sizes), ["c1", "c2"], target).collect()}
    tops = {}
    for (p, _), n in sizes.items():
        tops[p] = tops.get(p, 0) + n
    cap = _best_cap(list(tops.values()), target)
    for p, size in tops.items():
        own = {c: n for (q, c), n in sizes.items() if q == p}
        inner = _best_cap(list(own.values()), min(cap, size))
        assert {c: got[c] for c in own} == {c: min(inner, n) for c, n in own.items()}


def test_lloyd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 5)).astype(np.float32).astype(float)
    points = _points(spark, vectors).repartition(7)
    centers = C.first_vectors(points, 4, 1, "vec_id")
    want = centers
    for _ in range(3):
        near = ((vectors[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([vectors[near == k].mean(axis=0) if (near == k).any() else want[k] for k in range(4)])
    got = C.lloyd(points, centers, 3)
    assert np.allclose(got, want)
    rows = C.assign(points, got, distance="d").orderBy("vec_id").collect()
    distances = np.sqrt(((vectors[:, None] - got[None]) ** 2).sum(axis=2))
    assert [r["cluster"] for r in rows] == distances.argmin(axis=1).tolist()
    assert np.allclose([r["d"] for r in rows], distances.min(axis=1))


def test_copies_do_not_become_equal_centroids(spark):
    vectors = [[1, 0]] * 80 + [[0, 1], [5, 5], [9, 0]]
    centers = C.first_vectors(_points(spark, vectors), 4, 3, "vec_id")
    assert len({tuple(c) for c in centers}) == 4
    with pytest.raises(ValueError, match="only 4 different"):
        C.first_vectors(_points(spark, vectors), 9, 3, "vec_id")


def test_tiles_of_centers_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    vectors, centers = rng.integers(0, 4, (200, 3)).astype(float), rng.integers(0, 4, (50, 3)).astype(float)
    whole = C._nearest(vectors, centers)
    monkeypatch.setattr(C, "TILE_DISTANCES", 1400)  # seven centres at a time
    tiled = C._nearest(vectors, centers)
    assert (whole[0] == tiled[0]).all() and np.allclose(whole[1], tiled[1])


def test_many_centers_fit_into_a_task():
    """50,000 centres and a batch of 10,000 vectors: the whole matrix would take 4 GB."""
    import tracemalloc

    rng = np.random.default_rng(6)
    vectors, centers = rng.normal(size=(10_000, 4)), rng.normal(size=(50_000, 4))
    tracemalloc.start()
    best, _ = C._nearest(vectors, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    some = [0, 17, 9_999]
    assert best[some].tolist() == [int(((centers - vectors[i]) ** 2).sum(axis=1).argmin()) for i in some]


def test_empty_cluster_keeps_its_center(spark):
    centers = np.array([[0.0, 0.0], [100.0, 100.0]])
    assert C.lloyd_step(_points(spark, [[1, 1], [3, 3]]), centers).tolist() == [[2, 2], [100, 100]]


def test_too_many_centroids_are_refused(monkeypatch):
    monkeypatch.setattr(C, "MAX_CENTROID_BYTES", 100)
    with pytest.raises(ValueError, match="too many"):
        C.check_centers(np.zeros((10, 10)))


def test_tree_and_profile(spark):
    rng = np.random.default_rng(4)
    spots = [(x, y) for x in (0, 100) for y in (0, 5)]
    vectors = [np.array(s) + rng.normal(scale=0.1, size=2) for s in spots for _ in range(25)]
    points = _points(spark, vectors)
    tree = C.build_tree(points, (4, 2), ml_fit(7))
    found = C.assign_tree(points, tree).withColumn("n_tokens", F.lit(2))
    rows = C.cluster_profile(found, ["c1", "c2"]).collect()
    by_level = {lv: sorted(r["docs"] for r in rows if r["level"] == lv) for lv in (1, 2)}
    assert by_level == {1: [25] * 4, 2: [50, 50]}
    assert {r["imbalance"] for r in rows} == {1.0} and sum(r["tokens"] for r in rows) == 400
    sides = found.select((F.col("vec_id") < 50).alias("left"), "c2").distinct().count()
    assert sides == 2
    with pytest.raises(ValueError):
        C.build_tree(points, (4, 4), ml_fit(7))


def test_embedder_plug_in(spark):
    docs = spark.createDataFrame([(0, "ab"), (1, None)], "doc_id int, text string")
    vectors = C.embed(docs, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert sorted(map(tuple, vectors.collect())) == [(0, [2.0, 1.0]), (1, [0.0, 1.0])]


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_nearest_is_exact_at_any_scale(spark, scale):
    """The order is that of the distances, however close together or far apart."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(d) * scale) for i, d in enumerate(rng.random(2000))]
    rows += [(2000 + i, 0, 0.5 * scale) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id bigint, c1 int, distance double")
    quotas = spark.createDataFrame([(0, 300), (1, 77)], "c1 int, quota bigint")
    got = S.balanced_sample(df, quotas, ["c1"], "vec_id", 5, "nearest", rows_per_bucket=100)
    for leaf, quota in ((0, 300), (1, 77)):
        nearest = sorted((d, i) for i, c, d in rows if c == leaf)[:quota]
        assert sorted(r["vec_id"] for r in got.filter(f"c1 = {leaf}").collect()) == sorted(i for _, i in nearest)


@pytest.mark.parametrize("order", ["random", "nearest"])
def test_sample_from_a_hot_leaf(spark, order):
    """One leaf is nearly everything, all of it at one distance."""
    df = spark.range(3000).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("c1"),
        F.when(F.col("id") % 100 == 0, 0.25).otherwise(0.5).alias("distance"),
    )
    quotas = spark.createDataFrame([(0, 700), (1, 40)], "c1 int, quota bigint")
    got = S.balanced_sample(df, quotas, ["c1"], "vec_id", 5, order)
    assert {r["c1"]: r["count"] for r in got.groupBy("c1").count().collect()} == {0: 700, 1: 40}
    again = S.balanced_sample(df.repartition(5), quotas, ["c1"], "vec_id", 5, order)
    assert sorted(got.select("vec_id").collect()) == sorted(again.select("vec_id").collect())
    if order == "nearest":
        near = got.filter("c1 = 1 and distance < 0.3").count()
        assert near == 30
    with pytest.raises(ValueError):
        S.balanced_sample(df, quotas, ["c1"], "vec_id", 5, "best")


def test_curate(spark):
    rng = np.random.default_rng(8)
    points = _points(spark, rng.normal(size=(200, 3)))
    got = curate(points, (6, 2), lloyd_fit(2, 1, "vec_id"), 50, "vec_id", 1)
    assert 40 <= got.count() <= 60 and set(got.columns) == {"vec_id", "c1", "c2", "distance"}


def _docs(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n_tokens"))


def test_random_subset_fills_its_budget(spark):
    docs = _docs(spark, 500)
    half = S.random_subset(docs, 1000, "doc_id", 3)
    spent = half.agg(F.sum("n_tokens")).first()[0]
    assert 993 < spent <= 1000
    same = docs.filter("doc_id < 100")
    by_scalar = S.random_subset(docs, same.agg(F.sum("n_tokens")).scalar(), "doc_id", 3)
    total = same.agg(F.sum("n_tokens")).first()[0]
    assert total - 7 < by_scalar.agg(F.sum("n_tokens")).first()[0] <= total
    assert S.random_subset(docs, 0, "doc_id", 3).count() == 0


def test_repeats(spark):
    docs = _docs(spark, 100)
    total = docs.agg(F.sum("n_tokens")).first()[0]
    got = S.repeat_subset(docs, 2 * total + total // 2, "doc_id", 3)
    passes = {r["pass_no"]: r["count"] for r in got.groupBy("pass_no").count().collect()}
    assert passes[0] == passes[1] == 100 and 30 < passes[2] < 70
    part = S.repeat_subset(docs, total // 2, "doc_id", 3)
    assert {r["pass_no"] for r in part.collect()} == {0} and part.count() == passes[2]


def test_mixture_takes_items_in_turn(spark, monkeypatch):
    monkeypatch.setattr(S, "LAPS_PER_COPY", 3)
    rows = [(i, "big") for i in range(200)] + [(200, "tiny"), (201, "tiny"), (202, "none")]
    items = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = S.mixture(items, {"big": 3.0, "tiny": 1.0}, 600, "doc_id", 9, rows_per_bucket=64)
    rows = got.orderBy("draw_id").collect()
    assert [r["draw_id"] for r in rows] == list(range(600))
    tiny = [r for r in rows if r["source"] == "tiny"]
    assert 100 < len(tiny) < 200 and {r["source"] for r in rows} == {"big", "tiny"}
    order = [r["doc_id"] for r in tiny[:2]]
    assert [r["doc_id"] for r in tiny] == [order[i % 2] for i in range(len(tiny))]
    assert [r["lap"] for r in tiny] == [i // 2 for i in range(len(tiny))]
    big = [r["doc_id"] for r in rows if r["source"] == "big"]
    assert len(set(big[:200])) == 200 and big[200:400] == big[: len(big[200:400])]
    even = S.mixture(items, ["big", "tiny"], 400, "doc_id", 9)
    assert 150 < even.filter("source = 'tiny'").count() < 250
    with pytest.raises(ValueError):
        S.mixture(items, {"big": 0.0}, 5, "doc_id", 9)
