"""Routed assignment and bounded Lloyd steps against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import bounded_lloyd, clustering, routing
from gristmill.operators.bounded_lloyd import lloyd_bounded


def _points(spark, x, name="vec_id"):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>").repartition(3)


def _centers(spark, c):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "id long, center array<double>")


@pytest.fixture(scope="module")
def clumped():
    rng = np.random.default_rng(8)
    homes = rng.normal(size=(30, 6)) * 4
    x = homes[rng.integers(0, 30, 900)] + rng.normal(size=(900, 6))
    x[:300] = x[0]  # a third of all rows are one vector
    return x, homes[rng.integers(0, 30, 200)] + rng.normal(size=(200, 6))


def _squared(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(-1)


@pytest.mark.parametrize("cell_centers,part_rows", [(4096, 1 << 16), (7, 50)])
def test_routed_assignment_is_exact(spark, clumped, cell_centers, part_rows):
    x, c = clumped
    points = _points(spark, x).withColumn("cell", F.lit("x")).withColumn("best", F.lit("x"))
    routed = routing.route_centers(_centers(spark, c), c[:9], cell_centers)
    assert routed.table.count() == 200 and routed.table.groupBy("cell").count().agg(F.max("count")).first()[0] <= 200
    got = routing.assign_routed(points, routed, distance="d", part_rows=part_rows).collect()
    want = _squared(x, c)
    assert sorted(r.vec_id for r in got) == list(range(900)) and {r.cell for r in got} == {"x"}
    assert all(r.cluster == want[r.vec_id].argmin() for r in got)
    assert np.allclose([r.d for r in got], [np.sqrt(want[r.vec_id].min()) for r in got])


def test_routed_ties_go_to_the_lowest_id(spark):
    c = np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 2.0], [2.0, 0.0], [0.0, 0.0]])
    routed = routing.route_centers(_centers(spark, c), np.array([[0.0, 0.0], [2.0, 2.0]]), 1)
    x = np.array([[1.0, 0.0], [2.0, 0.1], [0.0, 0.0], [1.0, 1.0], [0.0, 9.0]])
    got = {r.vec_id: r.cluster for r in routing.assign_routed(_points(spark, x), routed).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 2}
    assert routing.assign_routed(_points(spark, x).filter("vec_id < 0"), routed).count() == 0


def test_more_centroids_than_may_travel(spark, clumped, monkeypatch):
    """Where the broadcast form refuses, the routed one gives the exact answer."""
    x, c = clumped
    monkeypatch.setattr(clustering, "MAX_CENTROID_BYTES", 20 * 6 * 8)
    with pytest.raises(ValueError):
        clustering.assign(_points(spark, x), c)
    routed = routing.route_centers(_centers(spark, c), c[:15], 10)
    got = routing.assign_routed(_points(spark, x), routed).collect()
    assert all(r.cluster == _squared(x, c)[r.vec_id].argmin() for r in got)


def test_a_vector_visits_few_cells(spark):
    """Well parted clumps: the bounds end the search after the first cell."""
    rng = np.random.default_rng(1)
    homes = np.eye(8) * 1000
    c = np.repeat(homes, 20, axis=0) + rng.normal(size=(160, 8))
    routed = routing.route_centers(_centers(spark, c), homes)
    asked = _points(spark, c + 0.1).withColumn("seen", F.lit(1)).withColumn("best", F.lit(5.0))
    assert asked.filter(F.size(routing._visits(routed, 8)("embedding", "seen", "best")) > 0).count() == 0


def test_routed_lloyd_equals_lloyd(spark, clumped):
    x, _ = clumped
    points = _points(spark, x)
    start = clustering.first_vectors(points, 20, 3, "vec_id")
    table = routing.seeded_centers(points, 20, 3, "vec_id")
    assert np.allclose([r.center for r in table.orderBy("id").collect()], start)
    want = clustering.lloyd(points, start, 3)
    got = routing.lloyd_routed(points, table, 4, 3, 3).orderBy("id").collect()
    assert [r.id for r in got] == list(range(20)) and np.allclose([r.center for r in got], want)
    with pytest.raises(ValueError):
        routing.seeded_centers(points, 700, 3, "vec_id")


def test_cluster_means_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i % 4 if i < 40 else 1, [float(i), 1.0]) for i in range(100)]
        table = spark.createDataFrame(rows, "cluster int, embedding array<double>").repartition(5)
        got = {r.id: r.center for r in routing.cluster_means(table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(4):
        assert got[c] == pytest.approx([np.mean([v[0] for k, v in rows if k == c]), 1.0])


@pytest.mark.parametrize("k", [1, 2, 25])
def test_bounded_lloyd_equals_lloyd(spark, clumped, k):
    x, _ = clumped
    points = _points(spark, x)
    start = clustering.first_vectors(points, k, 5, "vec_id")
    fit = lloyd_bounded(points, start, 6)
    assert np.allclose(fit.centers, clustering.lloyd(points, start, 6))
    assert fit.looked[0] == fit.full[0] == 900 * k and len(fit.looked) == 6
    if k == 25:
        assert fit.looked[-1] < fit.full[-1] / 2


def test_bounded_lloyd_keeps_empty_clusters(spark):
    points = _points(spark, np.array([[0.0], [1.0], [10.0]]))
    start = np.array([[0.0], [10.0], [99.0]])
    fit = lloyd_bounded(points, start, 3)
    assert fit.centers.tolist() == [[0.5], [10.0], [99.0]]
    nothing = lloyd_bounded(points.filter("vec_id < 0"), start, 2)
    assert nothing.centers.tolist() == start.tolist() and nothing.looked == [0, 0]


def test_two_nearest_in_tiles(monkeypatch):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(50, 3)), rng.normal(size=(31, 3))
    c[20] = c[4]
    monkeypatch.setattr(bounded_lloyd, "TILE_DISTANCES", 50 * 4)
    own, first, second = bounded_lloyd._two_nearest(x, c)
    d = np.sqrt(_squared(x, c))
    assert (own == d.argmin(1)).all()
    assert np.allclose(first, np.sort(d, axis=1)[:, 0]) and np.allclose(second, np.sort(d, axis=1)[:, 1])
    gaps = np.sqrt(_squared(c, c)) + np.diag(np.full(31, np.inf))
    assert np.allclose(bounded_lloyd._half_gaps(c), gaps.min(1) / 2, atol=1e-6)
