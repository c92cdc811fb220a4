import pytest
from pyspark.sql import functions as F

from gristmill.operators import audit as A
from gristmill.operators import reading as R


def _files(spark, n, chunk_size=2049 * 1024):
    return spark.range(n).select(
        F.format_string("f%05d", "id").alias("name"), F.lit(chunk_size).cast("bigint").alias("chunk_size")
    )


@pytest.mark.parametrize("files, dropped", [(4305, 17), (4344, 56)])
def test_accounting_of_a_published_run(spark, files, dropped):
    row = A.token_accounting(_files(spark, files), 2048, 16, 4, 8, 8).first()
    assert row["usable_files"] == 4288 and row["dropped_files"] == dropped
    assert row["total_blocks"] == 4_390_912 and row["tokens_per_step"] == 1_048_576
    assert row["max_steps_nominal"] == 8576 and row["max_steps_reachable"] == 8192
    assert row["total_raw_tokens"] == 4288 * 2049 * 1024


def test_accounting_of_nothing(spark):
    row = A.token_accounting(_files(spark, 0), 2048, 16, 4, 8, 8).first()
    assert (row["total_files"], row["max_steps_nominal"]) == (0, 0)


def test_budget(spark):
    accounts = A.token_accounting(_files(spark, 4305), 2048, 16, 4, 8, 8)
    over = A.compare_budget(accounts, 14_700).first()
    assert over["verdict"] == "repeats_data" and over["percent"] == pytest.approx(71.4, abs=0.05)
    assert A.compare_budget(accounts, 8576).first()["verdict"] == "exact"
    assert A.compare_budget(accounts, 4288).first()["percent"] == pytest.approx(50.0)


def test_tail_of_every_reader_is_never_read(spark):
    assigned = R.reader_assignment(_files(spark, 4305), 42, 8, 8)
    got = {r["status"]: r["files"] for r in R.read_coverage(assigned, 1024, 2048).collect()}
    assert got == {"read": 64 * 64, "unread_tail": 3 * 64, "dropped": 17}


def test_too_few_files(spark):
    assigned = R.reader_assignment(_files(spark, 9), 1, 2, 2)
    got = {r["status"]: r["files"] for r in R.read_coverage(assigned, 4, 8, buffer_files=3).collect()}
    assert got == {"too_few_files": 8, "dropped": 1}


def test_assignment_deals_every_kept_file_once(spark):
    rows = R.reader_assignment(_files(spark, 103), 7, 2, 4).collect()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == 96 and {r["files_each"] for r in rows} == {12}
    assert len({(r["reader"], r["slot"]) for r in kept}) == 96
    assert all(r["reader"] == r["gpu_rank"] * 4 + r["worker"] for r in rows)
    assert sorted(r["file_rank"] for r in rows) == list(range(103))


@pytest.mark.parametrize("shuffle", [True, False])
def test_schedule(spark, shuffle):
    assigned = R.reader_assignment(_files(spark, 20), 7, 2, 2)
    rows = R.read_schedule(assigned, 6, 7, 2, 3, 2, passes=2, buffer_files=2, shuffle=shuffle).collect()
    # 5 files a reader, 4 of them read, 6 blocks each, twice.
    assert len(rows) == 4 * 4 * 6 * 2
    for reader in range(4):
        own = sorted((r for r in rows if r["reader"] == reader), key=lambda r: r["read_pos"])
        assert [r["read_pos"] for r in own] == list(range(48))
        first, second = own[:24], own[24:]
        assert {(r["name"], r["block_no"]) for r in first} == {(r["name"], r["block_no"]) for r in second}
        # Only the files of one buffer are mixed.
        assert {r["file_group"] for r in own[:12]} == {0} and {r["file_group"] for r in own[12:24]} == {1}
        order = [(r["slot"], r["block_no"]) for r in first]
        assert (order == sorted(order)) is not shuffle
    batches = {}
    for r in rows:
        batches.setdefault((r["gpu_rank"], r["iter"]), set()).add(r["reader"])
        assert r["step"] == r["iter"] // 2
    assert all(len(readers) == 1 for readers in batches.values())


def _headers(spark, rows):
    columns = "path string, magic string, version bigint, dtype_code int, chunk_size bigint, length bigint"
    return spark.createDataFrame(rows, columns)


def test_audit_statuses(spark):
    rows = [
        ("a", "LITPKDS", 1, 8, 10, 44),
        ("b", "LITPKDX", 1, 8, 10, 44),
        ("c", "LITPKDS", 1, 77, 10, 44),
        ("d", "LITPKDS", 1, 8, 11, 46),
        ("e", "LITPKDS", 1, 8, 10, 43),
        ("f", "LITPKDS", 2, 8, 10, 44),
        ("g", "LITPKDS", 1, 3, 10, 44),
        ("h", "LITPKDS", 1, 4, 10, 64),
    ]
    got = {r["path"]: (r["status"], r["usable"]) for r in A.audit_shards(_headers(spark, rows)).collect()}
    assert got == {
        "a": ("ok", True),
        "b": ("bad_magic", False),
        "c": ("unknown_dtype", False),
        "d": ("header_differs", False),
        "e": ("bad_size", False),
        "f": ("bad_version", True),
        "g": ("ok", True),  # same width and size: the counter accepts it
        "h": ("header_differs", False),
    }
    broken = A.audit_shards(_headers(spark, [("a", "XXXXXXX", 1, 8, 10, 44), *rows[1:]]))
    assert {r["status"] for r in broken.collect()} == {"bad_first_file"}
