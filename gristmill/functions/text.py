"""Built-in tokenizer (C1, C2): whitespace words hashed into a fixed vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOS_ID = 1
EOS_ID = 2
VOCAB_SIZE = 32_000
FIRST_WORD_ID = 3
# Spelled out, because \s is not the same class in every regex engine.
WORD_PATTERN = "[^ \t\r\n]+"
IN_WORD = np.array([byte not in b" \t\r\n" for byte in range(256)])
# Bytes of text whose words are told apart at a time.
TEXT_BYTES = 1 << 24


def words(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def word_id(word: Column) -> Column:
    """Vocabulary id of one word: FIRST_WORD_ID .. VOCAB_SIZE - 1."""
    hashed = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    return (F.lit(FIRST_WORD_ID) + hashed % F.lit(VOCAB_SIZE - FIRST_WORD_ID)).cast("int")


def token_ids(text: Column | str, bos: bool = False, eos: bool = True, max_length: int = -1) -> Column:
    """ARRAY<INT>; truncation comes last, so it can cut the EOS off."""
    parts = [F.transform(words(text), word_id)]
    if bos:
        parts.insert(0, F.array(F.lit(BOS_ID)))
    if eos:
        parts.append(F.array(F.lit(EOS_ID)))
    ids = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.slice(ids, 1, max_length) if max_length > 0 else ids


def token_count(text: Column | str, bos: bool = False, eos: bool = True, max_length: int = -1) -> Column:
    """Length of ``token_ids`` without hashing a single word."""
    n = F.size(words(text)) + F.lit(int(bos) + int(eos))
    return (F.least(n, F.lit(max_length)) if max_length > 0 else n).cast("bigint")


def _hashed(texts: pa.Array) -> pa.ListArray:
    """Ids of the words of every text, then EOS_ID; each distinct word is hashed once."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, letters = np.flatnonzero(begins), data[inside]
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - starts)])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    ).dictionary_encode()
    md5 = hashlib.md5
    digests = b"".join([md5(word).digest() for word in found.dictionary.to_pylist()])
    known = FIRST_WORD_ID + np.frombuffer(digests, ">u4")[::4].astype(np.int64) % (VOCAB_SIZE - FIRST_WORD_ID)
    sizes = np.searchsorted(starts, ends) + np.arange(len(ends))
    ids = np.full(sizes[-1], EOS_ID, np.int32)
    words_at = np.ones(len(ids), bool)
    words_at[sizes[1:] - 1] = False
    ids[words_at] = known[found.indices.to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(ids))


def hashed_ids(text: Column | str) -> Column:
    """``token_ids`` of whole texts, worked out for many texts together."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Texts are taken together while their bytes stay within bounds, or one alone.
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch), 0).cast(pa.int64())).to_numpy()
            cuts = np.unique([0, *np.searchsorted(ends, range(TEXT_BYTES, ends[-1] if len(ends) else 0, TEXT_BYTES)), len(batch)])
            parts = [_hashed(batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *parts])

    # Marked so that the size of the result does not work it out again.
    return ids.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
