"""Packed shards: the parquet store and the ``.bin`` exchange format (A3, A4).

Parquet, partitioned by shard, is the store of record.  A ``.bin`` file holds
one chunk: a 24-byte little-endian header (magic, version u64, dtype code u8,
chunk size u64), then the values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.audit import HEADER_BYTES, MAGIC, VERSION
from gristmill.operators.reading import chunk_file_name
from gristmill.sources.files import open_uri, write_whole

# Fixed values of the packed file format.
HEADER = "<7sQBQ"
DTYPE_OF_CODE = {
    1: np.uint8,
    2: np.int8,
    3: np.int16,
    4: np.int32,
    5: np.int64,
    6: np.float32,
    7: np.float64,
    8: np.uint16,
}
WIDE_VOCAB = 65500

MANIFEST = "shard int, chunk_no bigint, path string, chunk_size bigint, dtype_code int, length bigint"
CHUNK_FILE = "path string, chunk_size bigint, tokens array<int>"
HEADERS = "path string, magic string, version bigint, dtype_code int, chunk_size bigint, length bigint"


def storage_code(vocab_size: int | None) -> int:
    """Two bytes per id while they suffice, else four."""
    if vocab_size is None:
        raise ValueError("a vocabulary size is needed to choose the width")
    return 8 if vocab_size < WIDE_VOCAB else 4


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The store of record: parquet, one directory per shard."""
    chunks.repartition("shard", "chunk_no").write.partitionBy("shard").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_no bigint, tokens array<int>, shard int").parquet(path)


def export_bin(chunks: DataFrame, folder: str, vocab_size: int | None, prefix: str = "shard") -> DataFrame:
    """A3: write one ``.bin`` per chunk below ``folder`` (a URI all executors reach).

    Returns the manifest, lazily: the files are written when it is materialised.
    Each is moved into place whole.
    """
    code = storage_code(vocab_size)
    dtype = np.dtype(DTYPE_OF_CODE[code])
    low, high = (0, np.iinfo(dtype).max) if code == 8 else (np.iinfo(dtype).min, np.iinfo(dtype).max)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_uri(folder)
        files.create_dir(root, recursive=True)
        for frame in frames:
            rows = []
            for shard, chunk_no, name, tokens in zip(
                frame["shard"], frame["chunk_no"], frame["name"], frame["tokens"]
            ):
                values = np.asarray(tokens, dtype=np.int64)
                if len(values) and (values.min() < low or values.max() > high):
                    raise ValueError(f"{name}: a token id does not fit into {dtype}")
                payload = values.astype(dtype).tobytes()
                target = f"{root}/{name}"
                header = struct.pack(HEADER, MAGIC.encode(), VERSION, code, len(values))
                write_whole(files, target, header, payload)
                length = HEADER_BYTES + len(payload)
                rows.append((shard, chunk_no, target, len(values), code, length))
            yield pd.DataFrame(
                rows, columns=["shard", "chunk_no", "path", "chunk_size", "dtype_code", "length"]
            )

    named = chunks.select("shard", "chunk_no", chunk_file_name(prefix).alias("name"), "tokens")
    return named.mapInPandas(write, MANIFEST)


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)


def import_bin(spark: SparkSession, folder: str) -> DataFrame:
    """A4: ``.bin`` files back to chunk rows; magic, version and dtype are checked.

    Files of floats are refused: token ids are integers of 32 bits at most.
    """
    limit = np.iinfo(np.int32)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                magic, version, code, size = struct.unpack_from(HEADER, content)
                if magic != MAGIC.encode():
                    raise ValueError(f"{path}: not a packed file")
                if version != VERSION:
                    raise ValueError(f"{path}: version {version}, expected {VERSION}")
                if code not in DTYPE_OF_CODE:
                    raise ValueError(f"{path}: unknown dtype code {code}")
                if np.dtype(DTYPE_OF_CODE[code]).kind == "f":
                    raise ValueError(f"{path}: dtype code {code} holds floats, not token ids")
                values = np.frombuffer(content, DTYPE_OF_CODE[code], count=size, offset=HEADER_BYTES)
                if len(values) and (values.min() < limit.min or values.max() > limit.max):
                    raise ValueError(f"{path}: a token id does not fit into 32 bits")
                rows.append((path, size, values.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["path", "chunk_size", "tokens"])

    chunks = _listing(spark, folder).select("path", "content").mapInPandas(read, CHUNK_FILE)
    numbers = r"-(\d+)_(\d+)\.bin$"
    return chunks.withColumn("shard", F.regexp_extract("path", numbers, 1).try_cast("int")).withColumn(
        "chunk_no", F.regexp_extract("path", numbers, 2).try_cast("bigint")
    )


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Input of the shard audit.  Only 24 bytes of each file are read."""

    def peek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, length in zip(frame["path"], frame["length"]):
                files, name = open_uri(path)
                with files.open_input_file(name) as source:
                    head = source.read(HEADER_BYTES)
                if len(head) < HEADER_BYTES:
                    rows.append((path, None, None, None, None, length))
                    continue
                magic, version, code, size = struct.unpack(HEADER, head)
                # A damaged header may hold numbers no BIGINT takes.
                limit = np.iinfo(np.int64).max
                rows.append(
                    (path, magic.decode("latin-1"), min(version, limit), code, min(size, limit), length)
                )
            yield pd.DataFrame(
                rows, columns=["path", "magic", "version", "dtype_code", "chunk_size", "length"]
            ).astype({"version": "Int64", "dtype_code": "Int64", "chunk_size": "Int64"})

    return _listing(spark, folder).select("path", "length").mapInPandas(peek, HEADERS)
