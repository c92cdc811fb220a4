"""Ranked lexical search with range maxima (operator 11).

Documents are indexed in shards: the ids and lengths of some thousand documents, in id
order, and a posting list for every term.  A query's documents are found by intervals:
sparse tables over the posting lists answer which document of an interval has a term's
highest impact, and the sum of these maxima bounds every score in the interval.  The
intervals with the highest bounds are split first, at the document with the largest
single impact, until no bound reaches the k-th best score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gristmill.llm.common import raw_bytes, slices
from gristmill.llm.vectors import best_of
from gristmill.operators.staging import small_batches, stage

# Bytes that are no part of a term become spaces, A-Z lower case (fixed classes).
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
SHARD_BYTES = 4 << 20
WORD_BYTES = 4 << 20
# What a row counts for beside its text, so that rows without any close a shard too.
ROW_BYTES = 8
# Bytes of rows that cross to a Python worker at a time.
ARROW_BYTES = 4 << 20
# Bytes of query text that one pass over the index takes along.
BLOCK_BYTES = 4 << 20
# Intervals that are split in one step, and cells of a table of ranks.
WIDTH = 256
CELLS = 1 << 23


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term, a bounded piece of the text at a time."""
    shown, found, begin = text.translate(_BYTES), Counter(), 0
    while begin < len(shown):
        end = begin + WORD_BYTES
        end = len(shown) if end >= len(shown) else shown.find(b" ", end)
        end = len(shown) if end < 0 else end
        found.update(shown[begin:end].split())
        begin = end
    return found


SHARD = (
    "doc_ids array<long>, lengths array<long>, terms array<string>, starts array<int>, docs array<int>, "
    "tfs array<int>, n_docs long, n_terms long"
)


def _occurrences(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and for every occurrence the term's number and the row."""
    sizes = pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy()
    body = b"".join(raw_bytes(rows["text"])).translate(_BYTES)
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(sizes), ends, pa.py_buffer(body)))
    row, flat = pc.list_parent_indices(words), words.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), row.filter(some).to_numpy()


def _one_long(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    found = term_counts(raw_bytes(rows["text"])[0])
    n = len(found)
    terms = pa.array(list(found), pa.binary()).cast(pa.string())
    return terms, np.arange(n), np.zeros(n, np.int64), np.fromiter(found.values(), np.int64, n)


def _shard(rows: pa.Table) -> pa.RecordBatch | None:
    """Posting lists of some rows, in the order of their ids, null ids last."""
    rows = rows.sort_by("doc_id")
    n = len(rows)
    if n == 1 and (rows.nbytes > SHARD_BYTES):
        terms, term, doc, tfs = _one_long(rows)
        lengths = np.array([tfs.sum()])
    else:
        terms, own, row = _occurrences(rows)
        lengths = np.bincount(row, minlength=n)
        # Documents without a term have no place; the keys sort by term, then document.
        place = np.cumsum(lengths > 0) - 1
        key, tfs = np.unique(own.astype(np.int64) * n + place[row], return_counts=True)
        term, doc = key // n, key % n
    if not len(terms):
        return None
    held = lengths > 0
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    columns = (
        rows["doc_id"].combine_chunks().filter(pa.array(held)),
        pa.array(lengths[held], pa.int64()),
        terms,
        pa.array(starts.astype(np.int32)),
        pa.array(doc.astype(np.int32)),
        pa.array(tfs.astype(np.int32)),
    )
    arrays = [pa.ListArray.from_arrays([0, len(a)], a) for a in columns]
    arrays += [pa.array([int(held.sum())]), pa.array([int(lengths.sum())])]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SHARD.split(", ")])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard of documents that hold a term.

    Every document is in one shard; nothing is shuffled.  Shards close at SHARD_BYTES of
    text and at the end of a partition; a longer text is a shard of its own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            shard = _shard(pa.Table.from_batches(held)) if held else None
            held.clear()
            if shard is not None:
                yield shard

        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                n = part.num_rows * ROW_BYTES + (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if size + n > SHARD_BYTES:
                    yield from closed()
                    size = 0
                held.append(part)
                size += n
        yield from closed()

    return rows.mapInArrow(run, SHARD)


def write_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``build_index``, written with a row group for each shard: whoever writes or reads it
    holds one shard, however many a partition has."""
    with small_batches(docs.sparkSession, ARROW_BYTES):
        return stage(build_index(docs, doc_id, text), "index", row_group=1)


@dataclass(frozen=True)
class Totals:
    """Documents with a term, terms with repeats, and the documents of each asked term."""

    documents: int
    terms: int
    holders: dict[str, int]

    def weight(self, term: str) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holders[term] + 1)))


def totals(index: DataFrame, asked: list[str]) -> Totals:
    """Counts over the whole index; only the asked terms reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(asked, pa.string())
        found = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                at = pc.fill_null(pc.index_in(terms.values, words), -1).to_numpy()
                found[at[at >= 0]] += np.diff(starts.values.to_numpy())[at >= 0]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["term", "n"])

    n, size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n"))
    return Totals(n, size, {asked[r[0]]: r[1] for r in held.collect()})


class Postings:
    """Posting lists of some terms of one shard, with their sparse tables.

    ``peaks[j][p]`` is the place of the highest impact among the 2^j postings from p on.
    """

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.docs, self.impact, self.n_docs = docs.astype(np.int64), impact, n_docs
        levels = int(sizes.max()).bit_length()
        self.log = np.zeros(n_docs + 2, np.int64)
        for i in range(1, levels + 1):
            self.log[1 << i :] = i
        here = np.arange(len(self.docs), dtype=np.int32)
        table = [here]
        for j in range(1, levels):
            half, last = 1 << (j - 1), table[-1]
            ahead = np.concatenate([last[half:], here[-half:]])[: len(last)]
            table.append(np.where(self.impact[last] >= self.impact[ahead], last, ahead).astype(np.int32))
        self.peaks = np.concatenate(table)

    def ranks(self, lists: np.ndarray):
        """How many of a list's postings stand before a document, as places."""
        n = self.n_docs
        sizes = self.begin[lists + 1] - self.begin[lists]
        key = np.concatenate([i * n + self.docs[self.begin[t] : self.begin[t + 1]] for i, t in enumerate(lists)])
        first = self.begin[lists] - np.concatenate([[0], np.cumsum(sizes)[:-1]])
        row = np.arange(len(lists)) * n
        if len(lists) * n <= CELLS:
            upto = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(lists) * n))])
            return lambda doc: upto[row + doc[:, None]] + first
        return lambda doc: np.searchsorted(key, row + doc[:, None]) + first

    def bounds(self, ranks, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval: the sum of the lists' maxima, and the document with the
        largest single impact.  The sum is exact for one document."""
        a, b = ranks(low), ranks(high)
        size = b - a
        some = size > 0
        level = self.log[size]
        base = level * len(self.docs)
        a = np.where(some, a, 0)
        p = self.peaks[base + a]
        q = self.peaks[base + np.where(some, b - (1 << level), 0)]
        v, w = self.impact[p], self.impact[q]
        top = np.where(v >= w, p, q)
        most = np.where(some, np.maximum(v, w), 0)
        at = most.argmax(1)
        return most.sum(1), self.docs[top[np.arange(len(at)), at]]


class Ranking:
    """The best ``k`` documents of one query: score, then id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.none, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = (np.concatenate(x) for x in ((self.score, score), (self.none, none), (self.ids, ids)))
        first = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.ids = score[first], none[first], ids[first]

    def bar(self, none: np.ndarray, ids: np.ndarray) -> tuple[int, int]:
        """What a document must reach: a score, and at that score a place before this
        one among the shard's documents."""
        if len(self.score) < self.k:
            return 1, len(ids)
        known = len(ids) - int(none.sum())
        last = len(ids) if self.none[-1] else int(np.searchsorted(ids[:known], self.ids[-1]))
        return max(1, int(self.score[-1])), last


def best_first(postings: Postings, lists: np.ndarray, none: np.ndarray, ids: np.ndarray, into: Ranking) -> int:
    """Rank one shard's documents for one query; returns how many intervals were bounded."""
    ranks = postings.ranks(lists)
    low, high = np.zeros(1, np.int64), np.full(1, postings.n_docs, np.int64)
    bound, split = postings.bounds(ranks, low, high)
    seen = 1
    while len(low):
        least, last = into.bar(none, ids)
        on = (bound > least) | ((bound == least) & (low < last))
        low, high, bound, split = low[on], high[on], bound[on], split[on]
        if not len(low):
            break
        width = max(1, min(WIDTH, CELLS // len(lists)))
        first = np.arange(len(low))
        if len(low) > width:
            first = np.argpartition(-bound, width)[:width]
        rest = np.ones(len(low), bool)
        rest[first] = False
        a, b, d = low[first], high[first], split[first]
        a, b = np.concatenate([d, a, d + 1]), np.concatenate([d + 1, d, b])
        a, b = a[a < b], b[a < b]
        score, at = postings.bounds(ranks, a, b)
        seen += len(a)
        one = b - a == 1
        into.add(*(x[one & (score > 0)] if x is score else x[a[one & (score > 0)]] for x in (score, none, ids)))
        low, high = np.concatenate([low[rest], a[~one]]), np.concatenate([high[rest], b[~one]])
        bound, split = np.concatenate([bound[rest], score[~one]]), np.concatenate([split[rest], at[~one]])
    return seen


def _load(row: dict[str, pa.Array], words: pa.Array, weights: np.ndarray, found: Totals):
    """The asked posting lists of a shard, and for each asked word its list or -1."""
    n, size = found.documents, found.terms
    m = np.array([50 + (50 * x * n) // size for x in row["lengths"].to_pylist()], np.int64)
    word = pc.fill_null(pc.index_in(row["terms"], words), -1).to_numpy()
    lists = np.flatnonzero(word >= 0)
    word = word[lists]
    at = np.full(len(words), -1, np.int64)
    at[word] = np.arange(len(lists))
    if not len(lists):
        return None, at
    starts = row["starts"].to_numpy().astype(np.int64)
    sizes = starts[lists + 1] - starts[lists]
    before = np.cumsum(sizes) - sizes
    own = np.repeat(starts[lists] - before, sizes) + np.arange(sizes.sum())
    docs, tf = row["docs"].to_numpy()[own], row["tfs"].to_numpy()[own].astype(np.int64)
    impact = np.repeat(weights[word], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
    return Postings(sizes, docs, impact, len(m)), at


def _blocks(queries: DataFrame) -> Iterator[list[tuple[object, set[str]]]]:
    """Items with their terms, a bounded amount of text at a time."""
    block, held = [], 0
    for r in queries.toLocalIterator():
        body = (r[1] or "").encode()
        if block and held + len(body) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r[0], {t.decode() for t in term_counts(body)}))
        held += len(body)
    if block:
        yield block


def search(
    index: DataFrame, queries: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    ``index`` is the table of ``build_index``, best written before (``write_index``), since it
    is read twice for each BLOCK_BYTES of query text, a shard at a time.  A score sums the item's terms once each; only
    documents with a score above 0 count.  Equal scores rank by id, null ids last;
    repeated documents are each ranked, repeated items each answered.  Null and empty
    items and documents have no terms; empty tables give no rows.  Other columns are not read.
    """
    if k < 1:
        raise ValueError(f"k must be positive, got {k}")
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = to_arrow_type(asked.schema["item_id"].dataType)
    fields = asked.select("item_id").schema
    done = None
    for block in _blocks(stage(asked, "items")):
        words = sorted(set().union(*(terms for _, terms in block)))
        with small_batches(index.sparkSession, ARROW_BYTES):
            found = totals(index, words)
        held = [w for w in words if w in found.holders]
        numbers = {w: i for i, w in enumerate(held)}
        weights = np.array([found.weight(w) for w in held], np.int64)
        own = [np.array(sorted(numbers[t] for t in terms if t in numbers), np.int64) for _, terms in block]

        def run(batches, block=block, held=held, weights=weights, own=own, found=found):
            rankings = [Ranking(k) for _ in block]
            words = pa.array(held, pa.string())
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].values for c in batch.schema.names}
                    none = row["doc_ids"].is_null().to_numpy(zero_copy_only=False)
                    ids = row["doc_ids"].fill_null(0).to_numpy()
                    postings, at = _load(row, words, weights, found)
                    for terms, ranking in zip(own, rankings):
                        lists = at[terms]
                        lists = lists[lists >= 0]
                        if len(lists):
                            best_first(postings, lists, none, ids, ranking)
            for number, ((name, _), r) in enumerate(zip(block, rankings)):
                if len(r.ids):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(r.ids), kind),
                            pa.array([number] * len(r.ids), pa.int64()),
                            pa.array(r.ids, mask=r.none),
                            pa.array(r.score),
                        ],
                        names=["item_id", "item", "doc_id", "score"],
                    )

        schema = T.StructType(list(fields.fields)).add("item", "long").add("doc_id", "long").add("score", "long")
        shards = index.select("doc_ids", "lengths", "terms", "starts", "docs", "tfs")
        scored = shards.mapInArrow(run, schema)
        best = best_of(scored, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k, ["doc_id", "score"])
        # Written before the next block is read, so the driver holds one block.
        with small_batches(index.sparkSession, ARROW_BYTES):
            ranked = stage(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        done = ranked if done is None else done.unionByName(ranked)
    if done is None:
        schema = T.StructType(list(fields.fields)).add("rank", "integer").add("doc_id", "long").add("score", "long")
        return index.sparkSession.createDataFrame([], schema)
    return done
