"""``spark.read.format("packed")``: packed shards as a data source (A3, A4).

Reading deals byte ranges of the files to tasks, which read block by block; no file is
held whole unless it is asked for whole.  Writing has two phases: tasks leave their files
in a folder of the job, and the driver moves them into place once all tasks are done.  A
list of the job's files, written last, makes them visible; an aborted job takes its folder
along.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from gristmill.operators.audit import HEADER_BYTES, MAGIC, VERSION
from gristmill.sources.files import open_uri
from gristmill.sources.packed import DTYPE_OF_CODE, HEADER, storage_code

ROWS = "path string, shard int, chunk_no bigint, chunk_size bigint, begin bigint, tokens array<int>"
PARTITION_BYTES = 64 << 20
# Bytes of a file that a task holds at a time.
READ_BYTES = 4 << 20
MOVES = 16
_NUMBERS = re.compile(r"-(\d+)_(\d+)\.bin$")


def _listed(folder: str, every: bool) -> list[tuple[str, int]]:
    """Path and length of each packed file: those of finished writes, if there are lists."""
    from pyarrow import fs

    files, root = open_uri(folder)
    infos = files.get_file_info(fs.FileSelector(root))
    found = {i.base_name: (i.path, i.size) for i in infos if i.type == fs.FileType.File}
    lists = [] if every else [p for name, (p, _) in found.items() if re.fullmatch(r"_manifest-\w+\.jsonl", name)]
    if not lists:
        return sorted(v for name, v in found.items() if name.endswith(".bin") and name[0] not in "._")
    named = set()
    for path in lists:
        with files.open_input_stream(path) as source:
            named.update(json.loads(line)["name"] for line in source.read().decode().splitlines())
    lost = named.difference(found)
    if lost:
        raise ValueError(f"{folder}: {len(lost)} files of a finished write are missing, such as {min(lost)}")
    return sorted(found[name] for name in named)


@dataclass
class Ranges(InputPartition):
    """Stretches (path, length of the file, from, to) that one task reads."""

    stretches: Sequence[tuple[str, int, int, int]]


def plan_ranges(files: Sequence[tuple[str, int]], block_size: int, partition_bytes: int) -> list[Ranges]:
    """Stretches of at most ``partition_bytes``, small files together; whole files where
    rows are whole files."""
    out: list[Ranges] = []
    held: list[tuple[str, int, int, int]] = []
    size = 0
    for path, length in files:
        step = partition_bytes if block_size else max(length, 1)
        for low in range(0, max(length, 1), step):
            high = min(length, low + step)
            if held and size + high - low > partition_bytes:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, length, low, high))
            size += high - low
    return [*out, Ranges(held)] if held else out


class PackedReader(DataSourceReader):
    def __init__(self, folder: str, block_size: int, partition_bytes: int, every: bool) -> None:
        self.folder, self.block_size = folder, block_size
        self.partition_bytes, self.every = partition_bytes, every

    def partitions(self) -> Sequence[InputPartition]:
        found = plan_ranges(_listed(self.folder, self.every), self.block_size, self.partition_bytes)
        return found or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = open_uri(self.folder)
        for path, length, low, high in partition.stretches:
            with files.open_input_file(path) as source:
                yield from self._blocks(source, path, length, low, high)

    def _blocks(self, source, path: str, length: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        head = source.read_at(HEADER_BYTES, 0)
        if len(head) < HEADER_BYTES:
            raise ValueError(f"{path}: shorter than its header")
        magic, version, code, size = struct.unpack(HEADER, head)
        if magic != MAGIC.encode():
            raise ValueError(f"{path}: not a packed file")
        if version != VERSION:
            raise ValueError(f"{path}: version {version}, expected {VERSION}")
        if code not in DTYPE_OF_CODE:
            raise ValueError(f"{path}: unknown dtype code {code}")
        dtype = np.dtype(DTYPE_OF_CODE[code])
        if dtype.kind == "f":
            raise ValueError(f"{path}: dtype code {code} holds floats, not token ids")
        if HEADER_BYTES + size * dtype.itemsize > length:
            raise ValueError(f"{path}: {length} bytes are too few for {size} values")
        block = self.block_size or max(size, 1)
        unit = block * dtype.itemsize
        blocks = -(-size // block) if self.block_size else 1
        # The blocks that start inside the stretch.
        first = max(0, -(-(low - HEADER_BYTES) // unit))
        after = min(blocks, max(0, -(-(high - HEADER_BYTES) // unit))) if high < length else blocks
        step = max(1, READ_BYTES // unit)
        for at in range(first, after, step):
            begin, end = at * block, min(size, min(after, at + step) * block)
            raw = source.read_at((end - begin) * dtype.itemsize, HEADER_BYTES + begin * dtype.itemsize)
            yield self._rows(path, size, begin, np.frombuffer(raw, dtype), block)

    def _rows(self, path: str, size: int, begin: int, values: np.ndarray, block: int) -> pa.RecordBatch:
        limit = np.iinfo(np.int32)
        if len(values) and (values.min() < limit.min or values.max() > limit.max):
            raise ValueError(f"{path}: a token id does not fit into 32 bits")
        numbers = _NUMBERS.search(path)
        shard, chunk = map(int, numbers.groups()) if numbers else (None, None)
        n = max(1, -(-len(values) // block))
        ends = np.minimum(np.arange(n + 1) * block, len(values)).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
        arrays = [
            pa.array([path] * n), pa.array([shard] * n, pa.int32()), pa.array([chunk] * n, pa.int64()),
            pa.array([size] * n, pa.int64()), pa.array(begin + ends[:-1].astype(np.int64)), tokens,
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ROWS.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (scratch path, name, values, bytes)."""

    files: list[tuple[str, str, int, int]]


class PackedWriter(DataSourceArrowWriter):
    """One file for each row (shard, chunk_no, tokens)."""

    def __init__(self, folder: str, vocab_size: int, prefix: str, overwrite: bool) -> None:
        self.folder, self.prefix, self.overwrite = folder, prefix, overwrite
        self.code, self.job = storage_code(vocab_size), uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = open_uri(self.folder)
        folder = self._pending(root)
        files.create_dir(folder, recursive=True)
        dtype = np.dtype(DTYPE_OF_CODE[self.code])
        limit = np.iinfo(dtype)
        out = []
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("shard", "chunk_no", "tokens")]
            for shard, chunk, tokens in zip(*columns):
                values = np.zeros(0, np.int64) if tokens.values is None else tokens.values.to_numpy(zero_copy_only=False)
                name = f"{self.prefix}-{shard.as_py():05d}_{chunk.as_py():010d}.bin"
                if len(values) and (values.min() < limit.min or values.max() > limit.max):
                    raise ValueError(f"{name}: a token id does not fit into {dtype}")
                # A name of its own: a second attempt never meets the first one's file.
                scratch = f"{folder}/{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(scratch) as target:
                    target.write(struct.pack(HEADER, MAGIC.encode(), VERSION, self.code, len(values)))
                    target.write(values.astype(dtype).tobytes())
                out.append((scratch, name, len(values), HEADER_BYTES + len(values) * dtype.itemsize))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = open_uri(self.folder)
        done = [f for m in messages if m is not None for f in m.files]
        names = Counter(name for _, name, _, _ in done)
        twice = [name for name, n in names.items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"{len(twice)} chunks occur more than once, such as {min(twice)}")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(root)):
                if info.base_name.endswith((".bin", ".jsonl")):
                    files.delete_file(info.path)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: files.move(f[0], f"{root}/{f[1]}"), done))
        rows = [{"name": n, "chunk_size": size, "dtype_code": self.code, "length": length} for _, n, size, length in done]
        listing = "".join(json.dumps(r) + "\n" for r in rows).encode()
        # Moved into place whole: from here on the write is visible.
        scratch = f"{root}/_pending-{self.job}.list"
        with files.open_output_stream(scratch) as target:
            target.write(listing)
        files.move(scratch, f"{root}/_manifest-{self.job}.jsonl")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Take away what the job has left."""
        from pyarrow import fs

        files, root = open_uri(self.folder)
        folder = self._pending(root)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class PackedSource(DataSource):
    """Options: ``path``; reading: ``blocksize`` (0: a file is a row), ``partitionbytes``,
    ``files`` (``committed``: those of finished writes where there are lists, else all; or
    ``all``); writing: ``vocabsize``, ``prefix``."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return ROWS

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("the packed format needs a path")
        return self.options["path"]

    def reader(self, schema) -> PackedReader:
        block = int(self.options.get("blocksize", "0"))
        if block < 0:
            raise ValueError(f"blocksize must not be negative, got {block}")
        most = int(self.options.get("partitionbytes", str(PARTITION_BYTES)))
        return PackedReader(self._folder(), block, most, self.options.get("files", "committed") == "all")

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        size = self.options.get("vocabsize")
        return PackedWriter(
            self._folder(), None if size is None else int(size), self.options.get("prefix", "shard"), overwrite
        )


def read_packed(spark: SparkSession, folder: str, block_size: int = 0) -> DataFrame:
    """A4: rows (path, shard, chunk_no, chunk_size, begin, tokens) of ``block_size`` values
    each, the last of a file maybe fewer; 0 reads a file as one row."""
    spark.dataSource.register(PackedSource)
    return spark.read.format("packed").option("blocksize", block_size).load(folder)


def write_packed(chunks: DataFrame, folder: str, vocab_size: int, prefix: str = "shard", overwrite: bool = False) -> None:
    """A3: a file for each row (shard, chunk_no, tokens), all of them or none."""
    chunks.sparkSession.dataSource.register(PackedSource)
    rows = chunks.select("shard", "chunk_no", "tokens").write.format("packed")
    rows.mode("overwrite" if overwrite else "append").option("vocabsize", vocab_size).option("prefix", prefix).save(folder)
