"""Context-tree weighting over bytes (operator 1).

A text is a sequence of bytes, each decided by eight binary choices.  For every choice
(a node of the byte's binary decomposition) there is a tree of contexts: the 0 to DEPTH
bytes before.  A node holds the counts of both outcomes in the training texts and their
Krichevsky-Trofimov block probability; weighting gives it half of that and half of the
product of its children's weighted probabilities.  The posterior weights then mix the
estimates of all depths into one probability for each choice.

The counts grow with the corpus, so they are never gathered in one place.  They live in
slices, by a hash of the two bytes before; a slice builds the tree from depth 2 down, and
only depths 0 and 1 (at most 256 x 255 nodes) are joined on the driver.  To score, texts
are grouped into blocks of bounded size; a block asks the slices for the probabilities of
its distinct contexts and gets them back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import crc_remainder, raw_bytes, remainder, slices
from gristmill.operators.staging import stage

DEPTH = 5
TOP = 2  # depths below this are joined over all slices
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
MIN_SLICES, MAX_SLICES = 32, 1 << 16
# Stands before and behind a text; never part of UTF-8.
EDGE = b"\xff"
FOLDS, HELD_OUT = 5, 1

_MASK = np.uint64((1 << 48) - 1)


def context_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the texts and their closing edges, and the end of each text's.

    A key is c1 c2 c3 c4 c5 b from high to low: the bytes before, nearest first, and the
    byte itself.
    """
    before = EDGE * DEPTH
    joined = b"".join([before + t + EDGE for t in texts])
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    n = len(joined) - DEPTH
    window = np.ndarray((n,), "<u8", buffer=raw, strides=(1,)) & _MASK
    keys = ((window << np.uint64(8)) & _MASK) | (window >> np.uint64(40))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    if len(texts) > 1:
        # The edges that stand before the next text are not part of any.
        keep = np.ones(n, bool)
        starts = ends[:-1] + DEPTH * np.arange(len(texts) - 1)
        for i in range(DEPTH):
            keep[starts + i] = False
        keys = keys[keep]
    return keys, ends


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.diff(np.append(begin, len(keys)))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    if not len(all_keys):
        return all_keys, all_counts
    order = np.argsort(all_keys)
    all_keys, all_counts = all_keys[order], all_counts[order]
    begin = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[begin], np.add.reduceat(all_counts, begin)


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _slice_of(keys: np.ndarray, n: int) -> np.ndarray:
    pair = (keys >> np.uint64(32)).astype(np.uint64)
    return ((pair * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(n)).astype(np.int64)


class Counted:
    """Distinct contexts and words of some texts."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: dict[bytes, int] = {}
        self.texts = 0
        self.bytes = 0

    def add(self, texts: list[bytes], count_words: bool = True) -> None:
        """Lower-cased texts."""
        self.texts += len(texts)
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= CHUNK_BYTES):
                held += len(texts[end])
                end += 1
            keys, counts = _distinct(context_keys(texts[begin:end])[0])
            self.keys.append(keys)
            self.counts.append(counts)
            self.bytes += held
            begin = end
            if sum(map(len, self.keys)) > 4 * len(self.keys[0]) + (1 << 20):
                self.keys, self.counts = ([x] for x in _merged(self.keys, self.counts))
        words = self.words
        for text in texts:
            if count_words:
                for w in text.split():
                    words[w] = words.get(w, 0) + 1
            else:
                words.update(dict.fromkeys(text.split(), 0))

    def payloads(self, n: int, counted: bool) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """slice, keys, counts, words, word counts; counts are left out of questions."""
        keys, counts = _merged(self.keys, self.counts)
        home = _slice_of(keys, n)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(n + 1))
        words: list[list[bytes]] = [[] for _ in range(n)]
        for w in self.words:
            words[zlib.crc32(w) % n].append(w)
        for s in range(n):
            own = order[cuts[s] : cuts[s + 1]]
            own_words = sorted(words[s])
            yield (
                s,
                _packed_keys(keys[own]),
                _packed(counts[own]) if counted else b"",
                zlib.compress(b" ".join(own_words), 1),
                _packed(np.array([self.words[w] for w in own_words], np.uint64)) if counted else b"",
            )


_SMALL = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(8194)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Of positive multiples of a half."""
    twice = np.rint(2 * x).astype(np.int64)
    large = x + 0.0
    series = (large - 0.5) * np.log(large) - large + 0.5 * math.log(2 * math.pi) + 1 / (12 * large) - 1 / (360 * large**3)
    return np.where(twice < len(_SMALL), _SMALL[np.minimum(twice, len(_SMALL) - 1)], series)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _nodes(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes of bit ``k`` of sorted (context, byte) keys: ids and both counts."""
    ids = keys >> np.uint64(8 - k)
    one = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total = np.add.reduceat(counts, begin)
    ones = np.add.reduceat(np.where(one, counts, 0), begin)
    return ids[begin], total - ones, ones


class SliceTree:
    """Nodes of depth TOP to DEPTH of one slice."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct keys with positive counts."""
        self.keys = keys
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.top: list[tuple[np.ndarray, ...]] = []
        if not len(keys):
            return
        below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(DEPTH, TOP - 1, -1):
            if d < DEPTH:
                keys, counts = _merged([self._at_depth(self.keys, d), np.zeros(0, np.uint64)], [self._counts, np.zeros(0, np.int64)])
            else:
                self._counts = counts
            here = {}
            for k in range(8):
                ids, a, b = _nodes(keys, counts, k)
                estimate = log_kt(a, b)
                if d == DEPTH:
                    weighted, weight = estimate, np.ones(len(ids))
                else:
                    children = self._sum_to_parents(*below[k], k, ids)
                    weighted = np.logaddexp(estimate, children) - math.log(2)
                    weight = np.exp(estimate - weighted - math.log(2))
                here[k] = (ids, weighted)
                self.nodes[d, k] = (ids, a, b, weight)
                if d == TOP:
                    # What depth 1 needs of this slice.
                    parents = ((ids >> np.uint64(k + 8)) << np.uint64(k)) | (ids & np.uint64((1 << k) - 1))
                    own, at = np.unique(parents, return_inverse=True)
                    name = ((own >> np.uint64(k)) << np.uint64(8)) | np.uint64(1 << k) | (own & np.uint64((1 << k) - 1))
                    self.top.append((name, *(np.bincount(at, x, len(own)) for x in (a, b, weighted))))
            below = here

    @staticmethod
    def _at_depth(keys: np.ndarray, d: int) -> np.ndarray:
        context = keys >> np.uint64(8 + 8 * (DEPTH - d))
        return (context << np.uint64(8)) | (keys & np.uint64(255))

    @staticmethod
    def _sum_to_parents(child: np.ndarray, weighted: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
        parent = ((child >> np.uint64(k + 8)) << np.uint64(k)) | (child & np.uint64((1 << k) - 1))
        return np.bincount(np.searchsorted(ids, parent), weighted, len(ids))

    def log10(self, keys: np.ndarray, top: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 probability of each key's byte after its context."""
        weight1, kt1, weight0, kt0 = top
        out = np.zeros(len(keys))
        near = (keys >> np.uint64(40)).astype(np.int64)
        for k in range(8):
            one = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            # Deeper nodes that were never met predict one half.
            p = np.full(len(keys), 0.5)
            for d in range(DEPTH, TOP - 1, -1):
                if (d, k) not in self.nodes:
                    continue
                ids, a, b, weight = self.nodes[d, k]
                wanted = self._at_depth(keys, d) >> np.uint64(8 - k)
                at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                estimate = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1.0)
                p = np.where(ids[at] == wanted, weight[at] * estimate + (1 - weight[at]) * p, 0.5)
            prefix = (1 << k) | ((keys & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
            for weight, kt, node in ((weight1, kt1, near * 256 + prefix), (weight0, kt0, prefix)):
                estimate = np.where(one, kt[node], 1 - kt[node])
                p = weight[node] * estimate + (1 - weight[node]) * p
            out += np.log10(p)
        return out


def _top(nodes: pa.Table) -> tuple[np.ndarray, ...]:
    """Weights and estimates of depths 1 and 0 from the sums over all slices."""
    a, b, children = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    at = nodes["node"].to_numpy()
    a[at], b[at], children[at] = (nodes[c].to_numpy() for c in ("a", "b", "w"))

    def settle(a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, ...]:
        estimate = log_kt(a, b)
        weighted = np.logaddexp(estimate, children) - math.log(2)
        # A node that was never met predicts one half.
        weight = np.where(a + b > 0, np.exp(estimate - weighted - math.log(2)), 1.0)
        return weight, (b + 0.5) / (a + b + 1.0), weighted

    weight1, kt1, weighted = settle(a, b, children)
    met = np.where(a + b > 0, weighted, 0.0)
    weight0, kt0, _ = settle(*(x.reshape(256, 256).sum(axis=0) for x in (a, b, met)))
    return weight1, kt1, weight0, kt0


PAYLOAD = "slice int, keys binary, counts binary, words binary, word_counts binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _count(training: DataFrame, n_slices: int) -> DataFrame:
    """Counts of the training texts: a row for each slice and about BLOCK_BYTES of text."""
    names = ["slice", "keys", "counts", "words", "word_counts", "texts"]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counted) -> pa.RecordBatch:
            rows = [(*p, held.texts if p[0] == 0 else 0) for p in held.payloads(n_slices, True)]
            return _batch(rows, names, kinds)

        held = Counted()
        for batch in batches:
            for part in slices(batch, "text"):
                held.add([x.lower() for x in raw_bytes(part.column("text"))])
                if held.bytes >= BLOCK_BYTES:
                    yield out(held)
                    held = Counted()
        if held.texts:
            yield out(held)

    return training.mapInArrow(run, PAYLOAD + ", texts long")


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def train(docs: DataFrame, text: str = "text", n_slices: int = MIN_SLICES) -> tuple[DataFrame, tuple, int, int, int]:
    """The model of all rows: slice table (written), top of the tree, tokens, distinct tokens, texts."""
    parts = _count(docs.select(F.col(text).alias("text")), n_slices)
    names = ["slice", "keys", "counts", "words", "word_counts", "texts", "tokens", "distinct", "node", "a", "b", "w"]
    doubles = pa.list_(pa.float64())
    kinds = [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3, pa.list_(pa.int64()), doubles, doubles, doubles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(s: int, keys: list, counts: list, words: dict, texts: int) -> pa.RecordBatch:
            merged, n = _merged(keys, counts)
            tree = SliceTree(merged, n)
            top = [np.concatenate(c) for c in zip(*tree.top)] if tree.top else [np.zeros(0)] * 4
            ordered = sorted(words)
            numbers = np.array([words[w] for w in ordered], np.uint64)
            row = (
                s, _packed_keys(merged), _packed(n), zlib.compress(b" ".join(ordered), 1), _packed(numbers),
                texts, int(numbers.sum()), len(ordered), top[0].astype(np.int64), *top[1:],
            )
            return _batch([row], names, kinds)

        now, keys, counts, words, texts = None, [], [], {}, 0
        for row in _by_slice(batches):
            if row["slice"] != now:
                if now is not None:
                    yield out(now, keys, counts, words, texts)
                now, keys, counts, words, texts = row["slice"], [], [], {}, 0
            keys.append(_unpacked_keys(row["keys"]))
            counts.append(_unpacked(row["counts"]).astype(np.int64))
            if sum(map(len, keys)) > 4 * len(keys[0]) + (1 << 20):
                keys, counts = ([x] for x in _merged(keys, counts))
            for w, c in zip(zlib.decompress(row["words"]).split(b" "), _unpacked(row["word_counts"]).tolist()):
                words[w] = words.get(w, 0) + c
            texts += row["texts"]
        if now is not None:
            yield out(now, keys, counts, words, texts)

    schema = PAYLOAD + (
        ", texts long, tokens long, distinct long, node array<long>, a array<double>, b array<double>, w array<double>"
    )
    ordered = parts.repartition(n_slices, "slice").sortWithinPartitions("slice")
    model = stage(ordered.mapInArrow(run, schema), "ctw")
    sums = model.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "texts")]).first()
    nodes = model.select(F.inline(F.arrays_zip("node", "a", "b", "w")))
    # At most 256 x 255 rows reach the driver.
    top = _top(nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("a", "b", "w")]).toArrow())
    return model, top, *sums


def _questions(blocks: DataFrame, n_slices: int) -> DataFrame:
    """The distinct contexts and words of each block, a row for each slice."""
    names = ["block", "slice", "keys", "words"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        held = Counted()
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                held.add([x.lower() for x in raw_bytes(part.column("text"))], count_words=False)
        rows = [(key[0].as_py(), s, k, w) for s, k, _, w, _ in held.payloads(n_slices, False)]
        return pa.Table.from_batches([_batch(rows, names, kinds)])

    return blocks.groupBy("block").applyInArrow(ask, "block long, slice int, keys binary, words binary")


def _answers(questions: DataFrame, model: DataFrame, top: tuple, n_slices: int) -> DataFrame:
    """Log-probabilities and word counts for each question, next to its keys and words."""
    blank = F.lit(None).cast("binary")
    asked = questions.select("slice", "block", "keys", "words", blank.alias("counts"), blank.alias("word_counts"))
    known = model.select("slice", F.lit(None).cast("long").alias("block"), "keys", "words", "counts", "word_counts")
    # The model's row of a slice sorts before its questions.
    rows = known.unionByName(asked).repartition(n_slices, "slice").sortWithinPartitions("slice", F.asc_nulls_first("block"))
    names = ["block", "keys", "values", "words", "word_counts"]
    kinds = [pa.int64(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, values, words = None, SliceTree(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(0), {}
        for row in _by_slice(batches):
            keys = _unpacked_keys(row["keys"])
            own = zlib.decompress(row["words"]).split(b" ")
            if row["slice"] != now:
                now, tree, words = row["slice"], SliceTree(np.zeros(0, np.uint64), np.zeros(0, np.int64)), {}
            if row["block"] is None:
                tree = SliceTree(keys, _unpacked(row["counts"]).astype(np.int64))
                values = tree.log10(keys, top)
                words = dict(zip(own, _unpacked(row["word_counts"]).tolist()))
                continue
            if len(tree.keys):
                at = np.minimum(np.searchsorted(tree.keys, keys), len(tree.keys) - 1)
                found, new = values[at], tree.keys[at] != keys
            else:
                found, new = np.zeros(len(keys)), np.ones(len(keys), bool)
            if new.any():
                found[new] = tree.log10(keys[new], top)
            counts = np.fromiter((words.get(w, 0) for w in own), np.uint64, len(own))
            yield _batch([(row["block"], row["keys"], found.astype("<f4").tobytes(), row["words"], _packed(counts))], names, kinds)

    return rows.mapInArrow(run, "block long, keys binary, values binary, words binary, word_counts binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _score(blocks: DataFrame, answers: DataFrame, tokens: int, distinct: int, texts: int) -> DataFrame:
    scale = math.log10(tokens + 0.5 * (distinct + 1))
    names = [c.split()[0] for c in SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    end = math.log10(texts + 0.5) - scale

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(_unpacked_keys(x) for x in right["keys"].to_pylist())])
        values = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(x, "<f4") for x in right["values"].to_pylist())])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        known: dict[bytes, int] = {}
        for w, c in zip(right["words"].to_pylist(), right["word_counts"].to_pylist()):
            known.update(zip(zlib.decompress(w).split(b" "), _unpacked(c).tolist()))
        batches = []
        for batch in left.to_batches():
            for part in slices(batch, "text", CHUNK_BYTES):
                bodies = [x.lower() for x in raw_bytes(part.column("text"))]
                ids, ends = context_keys(bodies)
                upto = np.concatenate([[0.0], np.cumsum(values[np.searchsorted(keys, ids)], dtype=np.float64)])
                scores = np.diff(upto[np.concatenate([[0], ends])])
                rows = []
                for name, body, total in zip(part.column("doc_id").to_pylist(), bodies, scores.tolist()):
                    own = body.split()
                    c = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                    base = float(np.log10(c + 0.5).sum()) - len(own) * scale + end
                    seen = int(np.count_nonzero(c)) + (texts > 0)
                    held = crc_remainder(name, FOLDS) == HELD_OUT
                    rows.append((name, held, len(own) + 1, seen, base, total, len(body)))
                batches.append(_batch(rows, names, kinds))
        return pa.Table.from_batches(batches or [_batch([], names, kinds)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every whole text by the model of the rows that are not held out.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte):
    ``score`` is log10 of the tree's probability of the lower-cased (A-Z) bytes and the
    closing edge; ``base_score`` that of a smoothed unigram model of the words;
    ``bits_per_byte`` the code length by byte, the edge counted as one.  Null texts are
    empty: an edge alone.  Ids are integers or null; repeated rows each count and each
    come out.  With nothing to learn from, every choice is one half.  An empty table
    gives an empty one.  Probabilities of contexts travel as 32-bit floats.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_slices = min(MAX_SLICES, max(MIN_SLICES, n_blocks))
    model, top, words, distinct, texts = train(rows.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT), "text", n_slices)
    tokens, distinct = words + texts, distinct + (texts > 0)
    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block")
    blocks = rows.select(home, "doc_id", "text").repartition(n_blocks, "block")
    answers = _answers(_questions(blocks, n_slices), model, top, n_slices)
    scored = _score(blocks, answers, tokens, distinct, texts)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
