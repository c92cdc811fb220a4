"""Small helpers of the text operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that one step of a Python task holds decoded at a time.
SLICE_BYTES = 8 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_remainder(key: object, modulus: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def byte_spelling() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def add_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[tuple[str, T.DataType]],
    start: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]],
) -> DataFrame:
    """Append columns that Python computes row by row from the text column.

    ``start`` runs once per task and returns the function applied to slices of
    bounded size.  Input columns that share a name with an appended one are
    replaced by it; all others pass through untouched.
    """
    names = {name for name, _ in fields}
    if text in names:
        raise ValueError(f"the text column is called {text!r}, like a column to be added")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, text):
                added = work(part)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *added], names=[*part.schema.names, *(n for n, _ in fields)]
                )

    return kept.mapInArrow(run, schema)
