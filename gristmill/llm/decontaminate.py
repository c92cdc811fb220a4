"""Benchmark decontamination (operator 6): an FM-index per shard of the training text.

A shard is a slice of bounded size of a task's documents.  Words that no test phrase
has cannot be part of a match, so a shard's index holds the runs of phrase words that
are long enough, with a separator after each.  The suffix array of that sequence gives
its Burrows-Wheeler transform; ranks come from a wavelet tree of bit vectors with
cumulative counts; all phrases are searched backwards at once; occurrences are located
by walking back to sampled suffix positions; and their spans are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import add_columns, raw_bytes
from gristmill.operators.staging import stage

WINDOW = 10
SAMPLE_RATE = 8
# Test text handled in one pass over the documents; more goes into further passes.
BLOCK_BYTES = 16 << 20

# ASCII word bytes are digits and lower-cased letters; every other ASCII byte parts words.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    # Only the space is left of ASCII white space, so split() cuts at spaces alone.
    return text.translate(_WORD_BYTES).split()


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(max(int(top).bit_length(), 1) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = symbols[np.argsort(bit, kind="stable")]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(upto), upto
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the unique smallest."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key)
        own = key[order]
        fresh = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of symbols >= 1."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        """``top``: the largest symbol that is ever searched or indexed."""
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_order(text)
        self.last = text[order - 1]
        self.wavelet = Wavelet(self.last, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = order % SAMPLE_RATE == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]
        self.n = len(text)

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase; rows are right-aligned symbol arrays."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((back <= lengths) & (low < high))
            if not len(live):
                break
            s = phrases[live, -back].astype(np.int64)
            low[live], high[live] = self._step(s, low[live]), self._step(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            at[live] = self._step(self.last[at[live]], at[live])
            walked[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.places[self.before[at]] + walked


class Phrases:
    """Windows of a block of test items: ids of their words, items that have them."""

    def __init__(self, items: Sequence[tuple[object, bytes]], window: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            own = words_of(text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add("" if item is None else str(item))
        keys = sorted(owners)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for k in keys for w in k}), 2)}
        self.items = [sorted(owners[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), max([window, *map(len, keys)])), np.int32)
        for row, k in enumerate(keys):
            self.symbols[row, -len(k) :] = [self.vocabulary[w] for w in k]
        self.shortest = int(self.lengths.min()) if keys else 0


def _runs(known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - begin >= least
    return begin[long], end[long]


def _shard_matches(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list, list]:
    """Of each text: its words, merged word spans that are hit, items found."""
    counts = np.zeros(len(texts), np.int64)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    symbols, owner, place = [], [], []
    for row, text in enumerate(texts):
        own = words_of(text)
        counts[row] = len(own)
        if not phrases.shortest or len(own) < phrases.shortest:
            continue
        ids = np.fromiter((phrases.vocabulary.get(w, 0) for w in own), np.int64, len(own))
        for a, b in zip(*_runs(ids > 0, phrases.shortest)):
            # A separator behind each run; no phrase has it.
            symbols.append(np.append(ids[a:b], 1))
            owner.append(np.full(b - a + 1, row))
            place.append(np.arange(a, b + 1))
    if not symbols:
        return counts, spans, items
    index = FMIndex(np.concatenate(symbols), len(phrases.vocabulary) + 1)
    owners, places = np.concatenate(owner), np.concatenate(place)
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(low < high)
    if not len(found):
        return counts, spans, items
    each = high[found] - low[found]
    phrase = np.repeat(found, each)
    rows = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[found], each)
    at = index.locate(rows)
    doc, begin = owners[at], places[at]
    end = begin + phrases.lengths[phrase]
    order = np.lexsort((end, begin, doc))
    for d, a, b, p in zip(doc[order].tolist(), begin[order].tolist(), end[order].tolist(), phrase[order].tolist()):
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1][1] = max(spans[d][-1][1], b)
        else:
            spans[d].append([a, b])
        items[d].update(phrases.items[p])
    return counts, spans, items


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The test items in blocks of bounded size, streamed through the driver."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        body = r.text.encode()
        if block and held + len(body) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r.item, body))
        held += len(body)
    if block:
        yield block


SPANS = T.ArrayType(T.ArrayType(T.LongType()))
FIELDS = [("n_words", T.LongType()), ("hit_spans", SPANS), ("hit_items", T.ArrayType(T.StringType()))]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (merged [begin, end) word spans covered by any
    window that occurs) and ``hit_items`` (ids as sorted strings) to every document.

    Words are lower-cased runs of letters and digits; a window is ``window``
    consecutive words of an item, or all of an item that has fewer.  Null and empty
    texts have no words; items without words, or null ones, no windows; a null
    item id is written as the empty string; an empty benchmark finds nothing.  Items that share an id or a window are each found;
    repeated documents each get their own result.  Input columns of the three names
    are replaced.  Test items are handled in blocks of BLOCK_BYTES, a pass over the
    documents for each, so their number is not limited; with several blocks the
    documents and what was found so far are written in between.
    """
    def one_pass(df: DataFrame, phrases: Phrases, held: bool) -> DataFrame:
        before = ["__spans", "__items"] if held else []
        for old, new in zip(("hit_spans", "hit_items"), before):
            df = df.withColumnRenamed(old, new)

        def start():
            def work(part: pa.RecordBatch) -> list[pa.Array]:
                counts, spans, items = _shard_matches(raw_bytes(part.column(text)), phrases)
                if held:
                    spans = [_merged(a + b) for a, b in zip(spans, part.column("__spans").to_pylist())]
                    items = [a | set(b) for a, b in zip(items, part.column("__items").to_pylist())]
                return [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]

            return work

        return add_columns(df, text, FIELDS, start).drop(*before)

    done = None
    for block in _blocks(benchmark, item_id, item_text):
        if done is not None:
            # Written before the next block's pass, so that the driver and a task hold one block.
            done = stage(done, "hits")
        done = one_pass(docs if done is None else done, Phrases(block, window), done is not None)
    return one_pass(docs, Phrases([], window), False) if done is None else done


def n_hit(spans: str = "hit_spans"):
    """Words under the merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def remove_hits(text: bytes, spans: Sequence[Sequence[int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    if not spans:
        return text
    places, at = [], 0
    shown = text.translate(_WORD_BYTES)
    for w in shown.split():
        at = shown.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, begin = [], 0
    for a, b in spans:
        out.append(text[begin : places[a][0]])
        begin = places[b - 1][1]
    return b"".join([*out, text[begin:]])


def remove_contamination(found: DataFrame, text: str = "text", spans: str = "hit_spans") -> DataFrame:
    """Cut the hit spans out of the text; other texts stay byte for byte (null stays null)."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, cuts = batch.column(text).to_pylist(), batch.column(spans).to_pylist()
            clean = [
                x if x is None or not s else remove_hits(x.encode(), s).decode() for x, s in zip(bodies, cuts)
            ]
            columns = [pa.array(clean, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, found.schema)
