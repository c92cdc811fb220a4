"""Bound-certified repacking (operator 7).

Documents are tokenized, the longer ones cut into pieces, and the pieces packed into
sequences of fixed capacity.  Each partition packs its pieces by best-fit decreasing
and computes a lower bound on its number of sequences from dual feasible functions.
Where both agree the partition is certified and done.  The others keep their full
sequences, exchange the pieces of the rest among fewer partitions and pack again, until
no sequence is saved.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm.common import byte_spelling, slices
from gristmill.operators.staging import stage

CAPACITY = 2048
SEPARATOR = 0
PARTITION_PIECES = 1 << 16
MAX_ROUNDS = 6
# Words met since the cache was last turned over; as many older ones are kept too.
CACHED_WORDS = 150_000
# Text that is split into words at a time; words and places take many times its size.
SPLIT_BYTES = 2 << 20

# The word pattern of the vocabulary file (fixed value); words never span white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts with these go through the tokenizer whole: marked-up special tokens, characters
# that lower-case by context, and separators that str.split() and the tokenizer see differently.
_ODD = ("<|startoftext|>", "<|endoftext|>", "Σ", "İ", "\x1c", "\x1d", "\x1e", "\x1f")
# What str.split() takes for white space beyond ASCII.
_SPACES = regex.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _is_plain(text: str) -> bool:
    return not any(x in text for x in _ODD) and (text.isascii() or unicodedata.is_normalized("NFC", text))


class CachedEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own.

    Every word is encoded once and remembered, until CACHED_WORDS newer ones have been
    met since its last use.  A lower-case word in normal form is what a byte-level model
    gets of it, spelled in the model's letters for bytes; with other models it takes the
    whole way.
    """

    def __init__(self, serialized: str) -> None:
        self.tokenizer = Tokenizer.from_str(serialized)
        last = (json.loads(serialized).get("pre_tokenizer") or {}).get("pretokenizers", [{}])[-1]
        plain = last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")
        self.spell = byte_spelling() if plain else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts = regex.compile(WORD_PATTERN).findall

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        for w in words:
            if self.spell is None:
                self.words[w] = self._whole(w)
            else:
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.spell)
                self.words[w] = array("I", [x.id for x in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _new(self, words: Iterable[str]) -> set[str]:
        """The words not known yet; those used again count as new ones."""
        out = set(words).difference(self.words)
        again = out.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        return out.difference(again)

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct lower-case pieces of text without white space."""
        fresh = self._new(chunks)
        single = {c for c in fresh if c.isalpha()}
        several = {c: self.parts(c) for c in fresh.difference(single)}
        single.update(w for p in several.values() for w in p if w not in several or p == [w])
        self._learn(self._new(single))
        for c, p in several.items():
            if p != [c]:
                self.words[c] = b"".join([self.words[w] for w in p])
        out = list(map(self.words.__getitem__, chunks))
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; each distinct word of all of them is looked up once."""
        plain = [_is_plain(x) for x in texts]
        spaced = [(x if x.isascii() else _SPACES.sub(" ", x)).lower() if ok else "" for x, ok in zip(texts, plain)]
        split = pc.ascii_split_whitespace(pa.array(spaced, pa.large_string()))
        row, flat = pc.list_parent_indices(split), split.flatten()
        some = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        parts = self._encoded(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        own = coded.indices.to_numpy()
        n = sizes[own]
        # Where each id of each occurrence stands among the ids of the distinct words.
        shift = (np.cumsum(sizes) - sizes)[own] - (np.cumsum(n) - n)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(shift, n) + np.arange(n.sum())]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.add.at(ends, row.filter(some).to_numpy() + 1, n)
        ends = np.cumsum(ends)
        return [
            ids[a:b].tobytes() if ok else self._whole(x) for x, ok, a, b in zip(texts, plain, ends, ends[1:])
        ]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text and a closing id 0.

    Only documents that are longer are cut; ``start`` counts the document's ids before
    the piece.  ``keep_ids`` adds the ids themselves.  Null and empty texts are the
    closing id alone; repeated rows and ids each give their own pieces.  The tokenizer
    file is read on the driver.
    """
    if capacity < 1:
        raise ValueError(f"capacity must be positive, got {capacity}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    serialized = Tokenizer.from_file(tokenizer).to_str()
    close = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder(serialized)
        for batch in batches:
            for part in slices(batch, "text", SPLIT_BYTES):
                ids, columns, bodies = part.column("doc_id").to_pylist(), ([], [], [], [], []), []
                texts = [x or "" for x in part.column("text").to_pylist()]
                for name, raw in zip(ids, encoder.encode(texts)):
                    raw += close
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        for c, v in zip(columns, (name, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                            c.append(v)
                        if keep_ids:
                            bodies.append(np.frombuffer(own, "<u4").astype(np.int32))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(bodies, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of sequences for these lengths, by dual feasible functions.

    u_e: lengths over capacity - e count 1, those from e to capacity - e their share,
    shorter ones nothing.  f_k: (k+1) x / capacity rounded down to a k-th, unless whole.
    Sums are taken in integers.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    upto, mass = np.cumsum(n), np.cumsum(n * size)
    e = np.arange(1, capacity // 2 + 1)
    whole = upto[-1] - upto[capacity - e]
    share = mass[capacity - e] - mass[e - 1]
    best = int((whole + -(-share // capacity)).max(initial=-(-int(mass[-1]) // capacity)))
    for k in range(1, 21):
        exact = (k + 1) * size % capacity == 0
        # In units of 1 / (k * capacity).
        worth = np.where(exact, k * size, ((k + 1) * size // capacity) * capacity)
        best = max(best, -(-int((n * worth).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, taken in the given (falling) order; fill of each bin."""
    bins, offsets, fill = [], [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += n
        if room > n:
            by_room[room - n].append(at)
            rooms |= 1 << (room - n)
    return bins, offsets, fill


PLACED = PIECES + ", part long, bin long, offset long, fill long, certified boolean"


def _pack_parts(pieces: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` partitions, with the certificate."""
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(salt)), F.lit(parts)).alias("part")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((n, "ascending") for n in names if n != "length")])
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths.tolist(), capacity)
        certified = len(fill) == lower_bound(lengths, capacity)
        table = table.append_column("bin", pa.array(bins, pa.int64()))
        table = table.append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("fill", pa.array(np.array(fill, np.int64)[np.array(bins, np.int64)]))
        return table.append_column("certified", pa.array([certified] * len(bins), pa.bool_()))

    return pieces.select(*names, part).groupBy("part").applyInArrow(pack, PLACED)


def _bins(placed: DataFrame) -> int:
    return placed.filter("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece (columns of ``token_pieces``).

    Sequences hold at most ``capacity`` ids without gaps.  A partition sees about
    ``partition_pieces`` pieces, chosen by a hash of id, piece and contents, so copies
    and repeated rows spread by what differs in them.  A round that would need more
    sequences than it replaces is not taken.  Ties in length go by id, piece, start and
    checksum.  An empty table stays empty; null ids are kept.
    """
    if "ids" in pieces.columns:
        raise ValueError("pack the narrow pieces and join the ids to the result")
    pending, done, before = stage(pieces, "pieces"), None, None
    for turn in range(MAX_ROUNDS):
        n = pending.count()
        if not n and done is not None:
            break
        parts = max(1, -(-n // partition_pieces))
        placed = stage(_pack_parts(pending, parts, turn, capacity), f"packed{turn}")
        numbered = placed.withColumn(
            "sequence_id", F.lit(turn << 56) + F.shiftleft("part", 28) + F.col("bin")
        ).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "certified")
        if before is not None and _bins(placed) >= _bins(before):
            done = done.unionByName(before)
            break
        final = F.col("certified") | (F.col("fill") == capacity)
        closed = numbered.filter(final)
        before = numbered.filter(~final)
        done = closed if done is None else done.unionByName(closed)
        if parts == 1 or turn == MAX_ROUNDS - 1 or before.isEmpty():
            done = done.unionByName(before)
            break
        pending = before
    return done.drop("fill", "certified")
