"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import math
import os
import re
import tempfile

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The folder that staged tables go to; it goes when the tests end.
_SHARED = tempfile.TemporaryDirectory(prefix="gristmill-tests-", ignore_cleanup_errors=True)


def local_session(cores: str = "8", shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gristmill")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", _SHARED.name)
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain_type(name: str) -> str:
    """Spark and DuckDB type names on common ground."""
    name = re.sub(r"\(.*\)", "", name.lower())
    names = {"varchar": "string", "integer": "int", "hugeint": "int128"}
    return names.get(name, name)


def _cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def _key(row: tuple) -> str:
    return repr(row)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns, types and rows agree, else what differs."""
    expected = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(expected.columns):
        return f"columns {columns} != {sorted(expected.columns)}"
    theirs = dict(zip(expected.columns, map(str, expected.types)))
    kinds = {c: (plain_type(t), plain_type(theirs[c])) for c, t in df.dtypes}
    typed = {c: k for c, k in kinds.items() if k[0] != k[1]}
    order = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(_cell(r[i]) for i in order) for r in expected.fetchall()), key=_key)
    got = sorted((tuple(_cell(v) for v in r) for r in df.select(*columns).toPandas().astype(object).where(
        lambda f: f.notna(), None).itertuples(index=False, name=None)), key=_key)
    if len(want) != len(got):
        return f"{len(got)} rows, expected {len(want)}"
    for ours, other in zip(got, want):
        if ours != other:
            return f"{columns}: {ours} != {other}"
    return f"types {typed}" if typed else None
