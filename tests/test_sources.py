import json
import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.operators import audit as A
from gristmill.operators import runs as E
from gristmill.operators.staging import shared_dir, stage
from gristmill.sources import corpus, files, packed, results, runlog


def _chunks(spark):
    rows = [(s, c, [s * 100 + c * 10 + i for i in range(6)]) for s in range(2) for c in range(3)]
    return spark.createDataFrame(rows, "shard int, chunk_no bigint, tokens array<int>")


@pytest.mark.parametrize("vocab, code, width", [(32_000, 8, 2), (65_499, 8, 2), (65_500, 4, 4)])
def test_bin_round_trip(spark, tmp_path, vocab, code, width):
    folder = str(tmp_path / "bin")
    manifest = packed.export_bin(_chunks(spark), folder, vocab).collect()
    assert {r["length"] for r in manifest} == {24 + 6 * width} and {r["dtype_code"] for r in manifest} == {code}
    assert sorted(os.listdir(folder))[0] == "shard-00000_0000000000.bin"
    raw = (tmp_path / "bin" / "shard-00000_0000000001.bin").read_bytes()
    assert raw[:7] == b"LITPKDS" and raw[7:15] == (1).to_bytes(8, "little") and raw[15] == code
    assert raw[16:24] == (6).to_bytes(8, "little") and raw[24 : 24 + width] == (10).to_bytes(width, "little")
    back = packed.import_bin(spark, folder).select("shard", "chunk_no", "tokens")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, _chunks(spark).collect()))
    # A second run replaces the files and leaves nothing else behind.
    packed.export_bin(_chunks(spark), folder, vocab).count()
    packed.export_bin(_chunks(spark), folder, vocab).collect()
    assert len(os.listdir(folder)) == 6


def test_width_needs_a_vocabulary():
    with pytest.raises(ValueError):
        packed.storage_code(None)


def test_ids_must_fit(spark, tmp_path):
    wide = _chunks(spark).withColumn("tokens", F.array(F.lit(70_000)))
    with pytest.raises(PySparkException, match="does not fit"):
        packed.export_bin(wide, str(tmp_path), 100).collect()


def test_audit_of_damaged_files(spark, tmp_path):
    folder = str(tmp_path / "bin")
    packed.export_bin(_chunks(spark), folder, 100).collect()

    def damage(name, change):
        path = os.path.join(folder, name)
        with open(path, "rb") as source:
            data = bytearray(source.read())
        with open(path, "wb") as target:
            target.write(change(data))

    damage("shard-00000_0000000001.bin", lambda d: b"X" + d[1:])
    damage("shard-00000_0000000002.bin", lambda d: d[:-1])
    damage("shard-00001_0000000000.bin", lambda d: d[:7] + b"\x02" + d[8:])
    damage("shard-00001_0000000001.bin", lambda d: d[:10])
    audited = A.audit_shards(packed.read_headers(spark, folder)).orderBy("path").collect()
    assert [r["status"] for r in audited] == [
        "ok", "bad_magic", "bad_size", "bad_version", "unreadable_header", "ok",
    ]
    assert [r["usable"] for r in audited] == [True, False, False, True, False, True]
    with pytest.raises(PySparkException):
        packed.import_bin(spark, folder).collect()


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "store")
    packed.write_chunks(_chunks(spark), path)
    back = packed.read_chunks(spark, path).select("shard", "chunk_no", "tokens")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, _chunks(spark).collect()))
    assert sorted(d for d in os.listdir(path) if d.startswith("shard")) == ["shard=0", "shard=1"]


def test_subset(spark, tmp_path):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    chosen = corpus.subset_of(docs, spark.createDataFrame([(3,), (3,), (42,)], "doc_id bigint"))
    path = str(tmp_path / "subset")
    corpus.write_subset(chosen, path)
    assert corpus.read_corpus(spark, path).collect() == [(3, "x")]


def test_stage_uses_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert sorted(stage(spark.range(5), "five").collect()) == sorted(spark.range(5).collect())


def test_result_files_keep_types_that_differ_in_case(spark, tmp_path):
    base = {"num_samples": 4, "num_scores": 4, "timeout_samples": 0, "empty_samples": 1, "acc": 50.0}
    for name, types in (("one", {"Geometry": 1.5, "geometry": 2.5}), ("two", None)):
        (tmp_path / name).mkdir()
        body = {**base, "time_use_in_second": 1.25, "time_use_in_minite": "0:01"}
        if types:
            body["type_acc"] = types
        (tmp_path / name / "test_run_metrics.json").write_text(json.dumps(body, indent=4))
    read = results.read_results(spark, str(tmp_path))
    rows = {r["dataset"]: r for r in read.collect()}
    assert rows["one"]["type_acc"] == {"Geometry": 1.5, "geometry": 2.5}
    assert rows["two"]["type_acc"] is None and rows["two"]["time_use_in_minite"] == "0:01"
    assert results.type_accuracy(read).count() == 2


LOG = """\
[global batch tokens] : 1,048,576
step     10/13952 | loss 1.9777 | lr 1.63e-06 | grad_norm 0.70 | tok/s 279,532
step     20/13952 | loss 1.9648 | selected 0.601 | lr 3.27e-06 | grad_norm 0.60 | tok/s 287,062
step     30/13952 | loss nan | lr 4.90e-06 | grad_norm 0.50 | tok/s 1,286,795
[ckpt] saved -> /a/b/step-6976
[train] done - saving final checkpoint
[ckpt] saved -> /a/b/step-13952
[ckpt] saved -> /a/b/step-13952
"""


def test_run_log(spark, tmp_path):
    (tmp_path / "run_a.out").write_text(LOG)
    lines = runlog.read_log_lines(spark, str(tmp_path / "*.out"))
    steps = runlog.parse_steps(lines)
    first, second, third = steps.orderBy("step").collect()
    assert (first["run"], first["step"], first["max_steps"], first["tok_s"]) == ("run_a", 10, 13952, 279532)
    assert first["selected"] is None and second["selected"] == 0.601 and third["tok_s"] == 1286795
    assert third["loss"] != third["loss"]
    saved = runlog.parse_checkpoints(lines)
    assert saved.count() == 3 and {r["folder"] for r in saved.collect()} == {"/a/b"}
    assert sorted(r["step"] for r in E.checkpoint_steps(saved).collect()) == [6976, 13952]
    printed = {r["line"] for r in runlog.format_steps(steps.filter("step < 30")).collect()}
    assert printed == set(LOG.splitlines()[1:3])
    audited = E.audit_schedule(steps, 490, 10928, 13952, 8e-5, 8e-6).collect()
    assert all(r["lr_matches"] for r in audited)
    wrong = E.audit_schedule(steps, 300, 10928, 13952, 8e-5, 8e-6).collect()
    assert not any(r["lr_matches"] for r in wrong)


def test_hadoop_schemes_become_those_of_arrow():
    assert files.arrow_uri("s3a://bucket/a/b.bin") == "s3://bucket/a/b.bin"
    assert files.arrow_uri("abfss://c@account/x") == "abfs://c@account/x"
    for same in ("hdfs://name:1/x", "file:///tmp/x", "file:/tmp/x", "s3://b/x"):
        assert files.arrow_uri(same) == same


def test_wide_ids_are_refused(spark, tmp_path):
    header = struct.pack(packed.HEADER, b"LITPKDS", 1, 5, 1)
    (tmp_path / "shard-00000_0000000000.bin").write_bytes(header + struct.pack("<q", 1 << 40))
    with pytest.raises(Exception, match="32 bits"):
        packed.import_bin(spark, str(tmp_path)).collect()


def test_results_survive_their_files(spark, tmp_path):
    """A data set without scores keeps its nulls; type names may differ in case only."""
    rows = [("a", 2, 1, 0, 1, 50.0, {"Geometry": 1.5, "geometry": None}), ("b", 1, 0, 0, 1, None, {})]
    schema = """dataset string, num_samples bigint, num_scores bigint, timeout_samples bigint,
        empty_samples bigint, acc double, type_acc map<string, double>"""
    report = spark.createDataFrame(rows, schema)
    assert results.write_results(report, str(tmp_path / "out")).count() == 2
    read = results.read_results(spark, str(tmp_path / "out")).select(*report.columns).orderBy("dataset")
    assert [tuple(r) for r in read.collect()] == rows


def test_log_folders_name_the_runs(spark, tmp_path):
    lines = spark.createDataFrame([("r1", "x"), ("07", "y"), ("r1", "z")], "run string, line string")
    runlog.write_log_lines(lines, str(tmp_path / "logs"))
    read = runlog.read_log_lines(spark, str(tmp_path / "logs"), by_folder=True)
    assert sorted(map(tuple, read.collect())) == [("07", "y"), ("r1", "x"), ("r1", "z")]
