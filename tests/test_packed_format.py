"""The packed data source: byte ranges, blocks, two-phase writes."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.sources import packed, packed_format
from gristmill.sources.packed_format import read_packed, write_packed


def _chunks(spark, n=12, size=1000):
    rng = np.random.default_rng(4)
    rows = [(i % 3, i // 3, rng.integers(0, 60_000, size + 7 * i).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "shard int, chunk_no bigint, tokens array<int>").repartition(4)


def _names(folder):
    return sorted(os.listdir(folder))


@pytest.mark.parametrize("vocab", [60_000, 100_000])
@pytest.mark.parametrize("block,most", [(0, 1 << 20), (129, 1 << 20), (129, 700), (1, 4096), (5000, 64)])
def test_blocks_of_any_range_add_up(spark, tmp_path, vocab, block, most):
    rows, table = _chunks(spark)
    write_packed(table, str(tmp_path), vocab)
    read = spark.read.format("packed").option("blocksize", block).option("partitionbytes", most).load(str(tmp_path))
    if most < 1000 and block:
        assert read.rdd.getNumPartitions() > 12
    got = {}
    for r in read.orderBy("shard", "chunk_no", "begin").collect():
        whole = got.setdefault((r.shard, r.chunk_no), [])
        assert r.begin == len(whole) and (not block or len(r.tokens) <= block)
        whole += r.tokens
        assert r.chunk_size >= len(whole)
    assert got == {(a, b): x for a, b, x in rows}


def test_files_equal_those_of_the_export(spark, tmp_path):
    _, table = _chunks(spark)
    write_packed(table, str(tmp_path / "a"), 60_000)
    packed.export_bin(table, str(tmp_path / "b"), 60_000).collect()
    names = [n for n in _names(tmp_path / "a") if n.endswith(".bin")]
    assert names == [n for n in _names(tmp_path / "b") if n.endswith(".bin")] and len(names) == 12
    for n in names:
        assert (tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes()
    # Files of others have no list and are read as they lie.
    assert read_packed(spark, str(tmp_path / "b")).count() == 12


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    _, table = _chunks(spark)
    folder = str(tmp_path)
    bad = F.when(F.col("chunk_no") == 3, F.raise_error(F.lit("stop")).cast("array<int>")).otherwise(F.col("tokens"))
    with pytest.raises(Exception, match="stop"):
        write_packed(table.withColumn("tokens", bad), folder, 60_000)
    assert _names(folder) == []
    with pytest.raises(Exception, match="does not fit"):
        write_packed(table.withColumn("tokens", F.array(F.lit(70_000))), folder, 60_000)
    with pytest.raises(Exception, match="more than once"):
        write_packed(table.union(table), folder, 60_000)
    assert _names(folder) == []
    assert read_packed(spark, folder).count() == 0


def test_append_and_overwrite(spark, tmp_path):
    _, table = _chunks(spark)
    folder = str(tmp_path)
    write_packed(table.filter("shard = 0"), folder, 60_000)
    write_packed(table.filter("shard = 1"), folder, 60_000)
    assert read_packed(spark, folder).select("shard").distinct().count() == 2
    write_packed(table.filter("shard = 2"), folder, 60_000, overwrite=True)
    assert {r.shard for r in read_packed(spark, folder).collect()} == {2}
    assert not [n for n in _names(folder) if n.startswith("_pending")]


def test_only_finished_writes_are_read(spark, tmp_path):
    _, table = _chunks(spark)
    folder = str(tmp_path)
    write_packed(table.filter("shard = 0"), folder, 60_000)
    stray = tmp_path / "shard-00007_0000000000.bin"
    stray.write_bytes(struct.pack(packed.HEADER, b"LITPKDS", 1, 8, 2) + struct.pack("<2H", 5, 6))
    assert read_packed(spark, folder).count() == 4
    every = spark.read.format("packed").option("files", "all").load(folder)
    assert every.count() == 5 and every.filter("shard = 7").first().tokens == [5, 6]
    os.remove(tmp_path / [n for n in _names(folder) if n.endswith(".bin")][0])
    with pytest.raises(Exception, match="missing"):
        read_packed(spark, folder).count()


@pytest.mark.parametrize(
    "head,body,said",
    [(b"", b"", "shorter"), (struct.pack(packed.HEADER, b"XXXXXXX", 1, 8, 0), b"", "not a packed"),
     (struct.pack(packed.HEADER, b"LITPKDS", 2, 8, 0), b"", "version"), (struct.pack(packed.HEADER, b"LITPKDS", 1, 99, 0), b"", "dtype"),
     (struct.pack(packed.HEADER, b"LITPKDS", 1, 6, 1), b"0000", "floats"), (struct.pack(packed.HEADER, b"LITPKDS", 1, 8, 2), b"000", "too few"),
     (struct.pack(packed.HEADER, b"LITPKDS", 1, 5, 1), struct.pack("<q", 1 << 40), "32 bits")],
)
def test_damaged_files_are_refused(spark, tmp_path, head, body, said):
    (tmp_path / "shard-00000_0000000000.bin").write_bytes(head + body)
    with pytest.raises(Exception, match=said):
        read_packed(spark, str(tmp_path), 16).collect()


def test_empty_files_and_folders(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, [])], "shard int, chunk_no bigint, tokens array<int>")
    write_packed(one, str(tmp_path), 60_000)
    assert [r.tokens for r in read_packed(spark, str(tmp_path)).collect()] == [[]]
    assert read_packed(spark, str(tmp_path), 8).count() == 0
    write_packed(one.filter("shard > 0"), str(tmp_path / "none"), 60_000)
    assert read_packed(spark, str(tmp_path / "none")).count() == 0


def test_small_files_share_a_partition():
    ranges = packed_format.plan_ranges([(f"f{i}", 100) for i in range(10)], 8, 250)
    assert [len(r.stretches) for r in ranges] == [2] * 5
    one = packed_format.plan_ranges([("f", 1000)], 8, 300)
    assert [r.stretches[0][2:] for r in one] == [(0, 300), (300, 600), (600, 900), (900, 1000)]
