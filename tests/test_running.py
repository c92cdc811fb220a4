import os
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators.running import (
    range_cuts,
    range_splits,
    row_rank,
    running_total,
    value_buckets,
    with_bucket,
    with_halo,
)
from gristmill.operators.staging import shared_dir, stage, staging_area


def _rows(n=2000, seed=1):
    """One group holds most rows, and the keys are clumped far apart."""
    rng = random.Random(seed)
    keys = rng.sample(range(500), 400) + rng.sample(range(10**12, 10**12 + 10**4), n - 400)
    return [(k, "hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 9)) for k in keys]


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_running_total_equals_cumsum(spark, partitions):
    rows = _rows()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "k bigint, g string, v bigint").repartition(partitions)
        bucketed = with_bucket(df, "k", range_splits(df, "k", 50))
        got = running_total(bucketed, ["g"], "bucket", ["k"], F.col("v"), total="total").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values("k")
    want["start"] = want.groupby("g")["v"].cumsum() - want["v"]
    want["total"] = want.groupby("g")["v"].transform("sum")
    got = got.sort_values("k").reset_index(drop=True)
    want = want.reset_index(drop=True)
    assert got["start"].tolist() == want["start"].tolist()
    assert got["total"].tolist() == want["total"].tolist()


@pytest.mark.parametrize("fanout,branch,levels", [(4, 4, 2), (6, 5, 2), (2, 2, 5), (64, 2, 0)])
def test_prefix_sums_through_a_tree_of_buckets(spark, fanout, branch, levels):
    """Three levels and more: buckets stay small, sums equal a plain running sum."""
    rows = _rows() + [(None, "hot", 3), (7 * 10**12, "lone", 1)]
    df = spark.createDataFrame(rows, "k bigint, g string, v bigint").repartition(5)
    cuts = range_cuts(df, "k", 40, fanout, branch)
    assert len(cuts.deeper) == levels
    bucketed = with_bucket(df, "k", cuts)
    sizes = [r["count"] for r in bucketed.groupBy("bucket").count().collect()]
    assert max(sizes) <= 100 and bucketed.agg(F.max("bucket")).first()[0] < cuts.buckets
    got = running_total(
        bucketed, ["g"], "bucket", [F.col("k").asc_nulls_first()], F.col("v"), total="total", least={"first": "k"},
        buckets=cuts.buckets, fanout=fanout,
    ).toPandas()
    want = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values("k", na_position="first")
    want["start"] = want.groupby("g")["v"].cumsum() - want["v"]
    want["total"] = want.groupby("g")["v"].transform("sum")
    want["first"] = want.groupby("g")["k"].transform("min")
    assert len(got) == len(want)
    for name in ("start", "total", "first"):
        left = got.sort_values("k", na_position="first")[name].tolist()
        assert left == want[name].tolist(), name


def test_sums_in_levels_without_groups(spark):
    df = spark.range(3000).withColumn("b", F.floor(F.col("id") / 3))
    got = running_total(df, [], "b", ["id"], start="s", total="t", buckets=1000, fanout=7)
    assert got.filter((F.col("s") != F.col("id")) | (F.col("t") != 3000)).count() == 0


def test_buckets_stay_even_on_clumped_keys(spark):
    df = spark.createDataFrame(_rows(), "k bigint, g string, v bigint")
    splits = range_splits(df, "k", 100)
    sizes = [r["count"] for r in with_bucket(df, "k", splits).groupBy("bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 150


def test_few_rows_need_no_splits(spark):
    assert range_splits(spark.range(10), "id", 100) == []
    bucketed = with_bucket(spark.range(10), "id", [])
    assert bucketed.select("bucket").distinct().count() == 1


def test_halo_window_equals_plain_window(spark):
    df = spark.createDataFrame(_rows(), "k bigint, g string, v bigint").withColumn("bucket", F.lit(0))
    ranked = row_rank(df, ["g"], "bucket", ["k"])
    spans = with_halo(ranked, "rank", 6, span=25)
    window = Window.partitionBy("g", "span").orderBy("rank").rowsBetween(-6, 0)
    got = spans.withColumn("s", F.sum("v").over(window)).filter(~F.col("halo")).select("k", "s")
    plain = Window.partitionBy("g").orderBy("k").rowsBetween(-6, 0)
    want = df.withColumn("s", F.sum("v").over(plain)).select("k", "s")
    assert sorted(got.collect()) == sorted(want.collect())


def test_halo_must_be_shorter_than_its_span(spark):
    with pytest.raises(ValueError):
        with_halo(spark.range(3), "id", 10, span=10)


def test_buckets_of_equal_values(spark):
    """A value that half of the rows share is divided; the buckets follow the order."""
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v")
    )
    df = df.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(16)))
    rows = value_buckets(df, "v", 100, "b", F.col("h"), 16).toPandas()
    assert rows.groupby("b").size().max() < 400
    assert rows.sort_values(["v", "h"])["b"].is_monotonic_increasing


def test_running_total_carries_the_least(spark):
    df = spark.createDataFrame(_rows(), "k bigint, g string, v bigint")
    bucketed = with_bucket(df, "k", range_splits(df, "k", 50))
    got = running_total(bucketed, ["g"], "bucket", ["k"], F.col("v"), least={"first": "k"})
    want = df.groupBy("g").agg(F.min("k").alias("first"))
    assert got.select("g", "first").distinct().exceptAll(want).isEmpty()
    assert got.count() == df.count()


def test_what_is_staged_in_an_area_goes_with_it(spark):
    with staging_area(spark) as folder:
        held = stage(spark.range(5).toDF("n"), "numbers")
        assert held.count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert folder not in shared_dir(spark)
