"""Token scores: loss, reference loss and reference entropy.

Two scorers fill the same table.  The count model is a smoothed bigram model
fitted with Spark aggregates; a plug-in scorer runs a caller's model over
batches of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.losses import excess_loss, logit_state, merged_state, state_entropy, state_normaliser
from gristmill.operators.joins import ROWS_PER_KEY, bounded, copies_for, salted_lookup
from gristmill.operators.staging import stage

SCORE_DIGITS = 9
LOW_BITS = 15
# Scores of a measure that a plug-in's worker gathers before it hands them on.
SCORED_CELLS = 1 << 18


@dataclass(frozen=True)
class BigramModel:
    """Add-alpha bigram counts: ``pairs(prev, label, n)`` and, per ``prev``, ``contexts``.

    ``lists`` has the same counts as packed lists for each of ``buckets``, if they are at hand."""

    pairs: DataFrame
    vocab_size: int
    alpha: float
    lists: DataFrame | None = None
    buckets: int | None = None

    @property
    def contexts(self) -> DataFrame:
        """``prev, total, entropy``; the entropy has a closed form because all
        labels that never followed ``prev`` share one probability."""
        alpha, vocab = F.lit(self.alpha), F.lit(float(self.vocab_size))
        totals = self.pairs.groupBy("prev").agg(
            F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("seen"),
            F.max("n").alias("heaviest"),
            F.sum((F.col("n") + alpha) * F.log(F.col("n") + alpha)).alias("__plogp"),
        )
        mass = F.col("total") + alpha * vocab
        rest = (vocab - F.col("seen")) * alpha * F.log(alpha)
        entropy = F.log(mass) - (F.col("__plogp") + rest) / mass
        return totals.select("prev", "total", entropy.alias("entropy"), "heaviest")

    def loss(self, n: Column, total: Column) -> Column:
        """Of a pair seen ``n`` times after a context seen ``total`` times; null means never."""
        p = (F.coalesce(n, F.lit(0)) + F.lit(self.alpha)) / (
            F.coalesce(total, F.lit(0)) + F.lit(self.alpha) * F.lit(float(self.vocab_size))
        )
        return _rounded(-F.log(p))

    def entropy(self, known: Column) -> Column:
        return _rounded(F.coalesce(known, F.log(F.lit(float(self.vocab_size)))))


def _rounded(score: Column) -> Column:
    """To SCORE_DIGITS, halves away from zero, in doubles: ``round`` would write out and
    parse every score as a decimal."""
    scale = F.lit(10.0**SCORE_DIGITS)
    return F.signum(score) * (F.floor(F.abs(score) * scale + F.lit(0.5)) / scale)


def shortened(score: Column, digits: int) -> Column:
    """``round(score, digits)`` for a score of SCORE_DIGITS: its last digit is whole in these
    doubles, so halves are seen as they are written."""
    last = F.floor(F.abs(score) * F.lit(10.0**SCORE_DIGITS) + F.lit(0.5))
    step = 10 ** (SCORE_DIGITS - digits)
    kept = F.floor((last + F.lit(step // 2)) / F.lit(float(step)))
    return F.signum(score) * (kept / F.lit(10.0**digits))


def _known_id(token: Column, vocab_size: int) -> Column:
    """The id itself; one outside the vocabulary is an error."""
    message = F.concat(F.lit(f"not an id of a vocabulary of {vocab_size}: "), token.cast("string"))
    return F.when((token >= 0) & (token < vocab_size), token).otherwise(F.raise_error(message))


def fit_bigram(sequences: DataFrame, vocab_size: int, alpha: float = 0.1) -> BigramModel:
    """Count neighbouring tokens of every ``tokens`` array; ids must be below ``vocab_size``.

    Pairs are combined on the map side, so a pair that makes up a third of the
    corpus reaches the shuffle as one row per task.
    """
    following = F.get("tokens", F.col("at") + 1)
    pairs = (
        sequences.select("tokens", F.posexplode_outer("tokens").alias("at", "token"))
        .filter(F.col("at") + 1 < F.size("tokens"))
        .select(_known_id(F.col("token"), vocab_size).alias("prev"), _known_id(following, vocab_size).alias("label"))
        .groupBy("prev", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return BigramModel(pairs, vocab_size, alpha)


def score_with_bigrams(
    positions: DataFrame, base: BigramModel, reference: BigramModel, rows_per_key: int = ROWS_PER_KEY
) -> DataFrame:
    """Add ``loss``, ``ref_loss``, ``ref_entropy`` and ``excess`` to positions.

    Scores are worked out once per distinct pair, and for pairs neither model has seen
    once per context.  The context table is bounded by the vocabulary.  Positions meet
    the pair table in one shuffle by (prev, label), whatever its size; contexts whose
    heaviest pair has more than ``rows_per_key`` rows in the base counts are divided.
    A window by batch that follows shuffles them back.
    """
    if base.vocab_size != reference.vocab_size:
        raise ValueError("the two models must share a vocabulary")
    vocab = base.vocab_size
    copies = copies_for(F.col("heaviest"), rows_per_key).alias("__copies")
    contexts = base.contexts.select("prev", F.col("total").alias("t_base"), "heaviest").join(
        reference.contexts.select("prev", F.col("total").alias("t_ref"), "entropy"), "prev", "full_outer"
    )
    pairs = base.pairs.withColumnRenamed("n", "n_base").join(
        reference.pairs.withColumnRenamed("n", "n_ref"), ["prev", "label"], "full_outer"
    )
    never = F.lit(None).cast("bigint")
    unseen = contexts.select(
        "prev",
        base.loss(never, F.col("t_base")).alias("__loss"),
        reference.loss(never, F.col("t_ref")).alias("__ref_loss"),
        reference.entropy(F.col("entropy")).alias("ref_entropy"),
        copies,
    ).withColumn("__excess", _rounded_excess("__loss", "__ref_loss"))
    seen = (
        pairs.join(bounded(contexts, vocab), "prev")
        .select(
            "prev",
            "label",
            base.loss(F.col("n_base"), F.col("t_base")).alias("loss"),
            reference.loss(F.col("n_ref"), F.col("t_ref")).alias("ref_loss"),
            copies,
        )
        .withColumn("excess", _rounded_excess("loss", "ref_loss"))
    )
    rows = positions.withColumn("prev", _known_id(F.col("prev"), vocab))
    rows = rows.withColumn("label", _known_id(F.col("label"), vocab))
    # A context that neither model knows matches no pair; its rows may go anywhere.
    parts = unseen.select("prev", "__copies")
    found = rows.join(bounded(parts, vocab), "prev", "left").fillna(1, ["__copies"])
    found = salted_lookup(found, seen, ["prev", "label"], "__copies", positions.columns)
    found = found.join(bounded(unseen.drop("__copies"), vocab), "prev", "left")
    uniform = base.entropy(never.cast("double"))
    return found.select(
        *positions.columns,
        F.coalesce("loss", "__loss", uniform).alias("loss"),
        F.coalesce("ref_loss", "__ref_loss", uniform).alias("ref_loss"),
        F.coalesce("ref_entropy", uniform).alias("ref_entropy"),
        F.coalesce("excess", "__excess", F.lit(0.0)).alias("excess"),
    )


def _pair_codes(tokens: pa.ChunkedArray, vocab_size: int) -> tuple[np.ndarray, np.ndarray]:
    """``prev * vocab_size + label`` of all positions of the lists, and how many each list has."""
    lists = tokens.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    at = np.flatnonzero(inner)
    prev, label = flat[at], flat[at + 1]
    for ids in (prev, label):
        wrong = ids[(ids < 0) | (ids >= vocab_size)]
        if len(wrong):
            raise ValueError(f"not an id of a vocabulary of {vocab_size}: {wrong[0]}")
    return prev * vocab_size + label, np.maximum(sizes - 1, 0)


def _schema(rows: DataFrame, columns: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    own = [T.StructField(c, rows.schema[c].dataType) for c in columns]
    return T.StructType([*own, *[T.StructField(*m) for m in more]])


def count_columns(rows: DataFrame) -> list[str]:
    return [c for n in ("n_base", "n_ref") for c in (f"{n}_low", f"{n}_high") if c in rows.columns]


PAIR_LISTS = [("pairs", T.BinaryType()), ("n", T.BinaryType())]
# Positions whose pairs are counted at a time where there are no regions.
LISTED_POSITIONS = 1 << 21


def pair_buckets(parts: int, vocab_size: int) -> int:
    """At least ``parts``, and without a common factor with the vocabulary, so that the pairs
    of a frequent token fall into all buckets ``pair % buckets``."""
    while math.gcd(parts, vocab_size) > 1:
        parts += 1
    return parts


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 64 bits as compressed planes of their bytes: the high ones are mostly zeros."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=8 * n, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view(kind).ravel()


def _joined(parts: Sequence[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


@dataclass
class _Counted:
    """The distinct pairs of some positions, ascending, then the contexts of them
    as ``vocab_size ** 2 + prev``: how often each occurs, and where they stand."""

    pairs: np.ndarray  # both, pairs first
    n: np.ndarray
    distinct: int  # how many are pairs
    at: np.ndarray  # of every position, its pair
    context: np.ndarray  # of every pair, its context among the contexts

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by bucket, the buckets that have entries and where each begins."""
        of = self.pairs % buckets
        order = np.argsort(of, kind="stable")
        return order, *np.unique(of[order], return_index=True)


def _counted(codes: np.ndarray, vocab_size: int) -> _Counted:
    """By hash, then sorted."""
    found = pa.array(codes).dictionary_encode()
    distinct, at = found.dictionary.to_numpy(), found.indices.to_numpy()
    n = np.bincount(at, minlength=len(distinct))
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, n = distinct[order].astype(np.int64), n[order].astype(np.int64)
    prev = pairs // vocab_size
    first = np.diff(prev, prepend=-1) > 0
    totals = np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n
    both = np.concatenate([pairs, vocab_size**2 + prev[first]])
    return _Counted(both, np.concatenate([n, totals]), len(pairs), rank[at], np.cumsum(first) - 1)


def _bucket_rows(counted: _Counted, buckets: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Buckets with their packed lists: steps of ``pair // buckets``, and counts."""
    order, found, first = counted.dealt(buckets)
    pairs = [_packed(np.diff(x // buckets, prepend=0)) for x in np.split(counted.pairs[order], first[1:])]
    return found, pairs[: len(found)], [_packed(x) for x in np.split(counted.n[order], first[1:])][: len(found)]


def _of_bucket(table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and counts of all lists of one bucket, and the length of each list."""
    pairs = [np.cumsum(_unpacked(x)) for x in table["pairs"].to_pylist()]
    sizes = np.array([len(x) for x in pairs], np.int64)
    own = table["bucket"][0].as_py() if len(table) else 0
    return _joined(pairs) * buckets + own, _joined([_unpacked(x) for x in table["n"].to_pylist()]), sizes


def count_pairs(blocks: DataFrame, near: Sequence[str], vocab_size: int, buckets: int) -> DataFrame:
    """``near, bucket, pairs, n``: how often each pair of neighbours occurs in the blocks of
    one ``near``, a region of bounded size, as packed lists for each bucket of pairs;
    a pair is ``prev * vocab_size + label``.  The totals of each ``prev``
    are counted too, as ``vocab_size ** 2 + prev``."""
    schema = _schema(blocks, near, ("bucket", T.LongType()), *PAIR_LISTS)

    def count(table: pa.Table) -> pa.Table:
        found, pairs, n = _bucket_rows(_counted(_pair_codes(table["tokens"], vocab_size)[0], vocab_size), buckets)
        own = [table[c].combine_chunks().take(pa.array(np.zeros(len(found), np.int64))) for c in near]
        return pa.table([*own, pa.array(found, pa.int64()), pa.array(pairs, pa.binary()), pa.array(n, pa.binary())], names=schema.names)

    # All columns are read, as by the step that looks counts up, so that both share a shuffle.
    return blocks.groupBy(*near).applyInArrow(count, schema)


def fit_listed(sequences: DataFrame, vocab_size: int, alpha: float, buckets: int) -> BigramModel:
    """``fit_bigram`` by lists: a task's pairs are counted many sequences at a time and go to
    their buckets packed.  The model is written once."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(*f) for f in PAIR_LISTS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch["tokens"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            turns = np.unique(ends // LISTED_POSITIONS, return_index=True)[1]
            for begin, end in zip(turns, [*turns[1:], len(batch)]):
                tokens = pa.chunked_array([batch["tokens"].slice(begin, end - begin)])
                found, pairs, n = _bucket_rows(_counted(_pair_codes(tokens, vocab_size)[0], vocab_size), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(pairs, pa.binary()), pa.array(n, pa.binary())], names=schema.names)

    lists = stage(_summed_lists(sequences.select("tokens").mapInArrow(count, schema), buckets), "pairs")
    return BigramModel(listed_pairs(lists, vocab_size, buckets), vocab_size, alpha, lists, buckets)


def _summed_lists(lists: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket."""
    schema = _schema(lists, ["bucket", "pairs", "n"])

    def total(left: pa.Table) -> pa.Table:
        pairs, _, sums, _ = _summed(left, buckets)
        order = np.argsort(pairs)
        packed = [[_packed(np.diff(pairs[order] // buckets, prepend=0))], [_packed(sums[order])]]
        return pa.table([left["bucket"].slice(0, 1), *[pa.array(x, pa.binary()) for x in packed]], names=schema.names)

    return lists.groupBy("bucket").applyInArrow(total, schema)


def listed_pairs(lists: DataFrame, vocab_size: int, buckets: int) -> DataFrame:
    """``prev, label, n`` of lists that have each pair once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pairs, n, _ = _of_bucket(pa.Table.from_batches([batch.slice(i, 1)]), buckets)
                pair = pairs < vocab_size**2
                ids = [pa.array(x.astype(np.int32)) for x in np.divmod(pairs[pair], vocab_size)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n[pair])], names=["prev", "label", "n"])

    return lists.select("bucket", "pairs", "n").mapInArrow(rows, "prev int, label int, n long")


def own_model(counted: DataFrame, vocab_size: int, alpha: float, buckets: int) -> BigramModel:
    """The model of the blocks of ``count_pairs``."""
    lists = _summed_lists(counted.select("bucket", "pairs", "n"), buckets)
    return BigramModel(listed_pairs(lists, vocab_size, buckets), vocab_size, alpha, lists, buckets)


def listed_totals(counted: DataFrame, vocab_size: int, buckets: int) -> DataFrame:
    """``context_totals`` of the blocks of ``count_pairs``."""

    def total(left: pa.Table) -> pa.Table:
        pairs, _, sums, _ = _summed(left, buckets)
        prev = pairs >= vocab_size**2
        return pa.table([pa.array((pairs[prev] - vocab_size**2).astype(np.int32)), pa.array(sums[prev])], names=["prev", "t_base"])

    return counted.groupBy("bucket").applyInArrow(total, "prev int, t_base long")


def _known_lists(model: BigramModel, buckets: int) -> DataFrame:
    """``bucket, pairs, n`` of a model that may have been counted without lists."""
    if model.lists is not None and model.buckets == buckets:
        return model.lists
    vocab = model.vocab_size
    context = model.pairs.groupBy("prev").agg(F.sum("n").alias("n"))
    rows = model.pairs.select((F.col("prev").cast("bigint") * vocab + F.col("label")).alias("pair"), "n").unionByName(
        context.select((F.col("prev").cast("bigint") + vocab**2).alias("pair"), "n")
    )
    schema = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(*f) for f in PAIR_LISTS]])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair")
        steps = np.diff(table["pair"].to_numpy() // buckets, prepend=0)
        lists = [pa.array([_packed(x)], pa.binary()) for x in (steps, table["n"].to_numpy())]
        return pa.table([table["bucket"].slice(0, 1), *lists], names=schema.names)

    return rows.withColumn("bucket", F.col("pair") % buckets).groupBy("bucket").applyInArrow(pack, schema)


def _summed(table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of the lists of a bucket, where each entry stands among them, their
    sums, and the length of each list."""
    entries, n, sizes = _of_bucket(table, buckets)
    found = pa.array(entries).dictionary_encode()
    pairs, inverse = found.dictionary.to_numpy(), found.indices.to_numpy()
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, inverse, n)
    return pairs, inverse, sums, sizes


def _matched(pairs: np.ndarray, theirs: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    """The value that ``theirs`` has for each of the pairs."""
    at = pc.index_in(pa.array(pairs), value_set=pa.array(theirs))
    return pc.fill_null(pa.array(values).take(at), missing).to_numpy(zero_copy_only=False)


def total_pairs(
    counted: DataFrame, reference: BigramModel | None, near: Sequence[str], vocab_size: int, buckets: int,
    entropy: bool = False,
) -> DataFrame:
    """For each list of ``count_pairs``, entry by entry, packed: ``n_base``, the count over all
    regions, and ``n_ref``, that of the reference model, if there is one; the
    pairs themselves are known where the list comes from.  With ``entropy`` that of the
    reference model for the contexts of the list, NaN where it has none."""
    names = ["n_base"] if reference is None else ["n_base", "n_ref"]
    names += ["entropy"] if entropy else []
    schema = _schema(counted, [*near, "bucket"], *[(name, T.BinaryType()) for name in names])

    def total(left: pa.Table, known: pa.Table | None) -> pa.Table:
        pairs, inverse, sums, sizes = _summed(left, buckets)
        ends = np.cumsum(sizes)
        found = [(sums[inverse], ends)]
        if known is not None:
            listed = known.filter(pc.is_valid(known["pairs"]))
            theirs, n, _ = _of_bucket(listed, buckets)
            found.append((_matched(pairs, theirs, n, 0)[inverse], ends))
        if entropy:
            contexts = known.filter(pc.is_valid(known["code"]))
            values = _matched(pairs, contexts["code"].to_numpy(), contexts["entropy"].to_numpy(), np.nan)
            own = (pairs >= vocab_size**2)[inverse]
            found.append((values[inverse][own], np.concatenate([[0], np.cumsum(own)])[ends]))
        lists = [pa.array([_packed(x) for x in np.split(v, e)[: len(e)]], pa.binary()) for v, e in found]
        return pa.table([*[left[c] for c in [*near, "bucket"]], *lists], names=schema.names)

    if reference is None:
        return counted.groupBy("bucket").applyInArrow(lambda left: total(left, None), schema)
    known = _known_lists(reference, buckets)
    if entropy:
        context = F.col("prev").cast("bigint") + vocab_size**2
        rows = reference.contexts.select((context % buckets).alias("bucket"), context.alias("code"), "entropy")
        known = known.unionByName(rows, allowMissingColumns=True)
    return counted.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(total, schema)


def _returned(totals: pa.Table, name: str, order: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Values of the lists that came back to a region, by bucket, for its pairs as they were counted."""
    values = np.empty(len(order), kind)
    values[order] = _joined([_unpacked(x, kind) for x in totals[name].to_pylist()], kind)
    return values


BATCH_SCORES = ("loss", "ref_loss", "ref_entropy", "excess")


def score_batches(
    blocks: DataFrame, base: BigramModel, reference: BigramModel, near: Sequence[str], batch: Sequence[str],
    keep: Sequence[str], parts: int, columns: Sequence[str] | None = None,
) -> DataFrame:
    """``score_with_bigrams`` for the positions of blocks that are placed by ``near``, regions of
    whole micro-batches: a row per ``batch``, which has a fixed size, with a list per
    column, ``keep`` of the blocks, ``pos``, ``prev``, ``label`` and the scores, entry by entry.

    ``base`` is the model of these very blocks; its counts and context totals are taken
    here, with those of the reference model beside, and return to the regions as packed lists.  A
    score is worked out once for each distinct pair of a region, and no position is shuffled.
    ``columns`` names the lists to return, all if not given; ``pos`` is always one of them.
    """
    vocab, alpha = base.vocab_size, base.alpha
    if vocab != reference.vocab_size:
        raise ValueError("the two models must share a vocabulary")
    buckets = pair_buckets(parts, vocab)
    counted = count_pairs(blocks, near, vocab, buckets)
    if reference is base:
        reference = own_model(counted, vocab, alpha, buckets)
    totals = total_pairs(counted, reference, near, vocab, buckets, entropy=True).repartition(parts, *near)
    doubles = T.ArrayType(T.DoubleType())
    ints = T.ArrayType(T.IntegerType())
    kinds = {c: T.ArrayType(blocks.schema[c].dataType) for c in keep}
    kinds |= {c: ints for c in ("pos", "prev", "label")} | {c: doubles for c in BATCH_SCORES}
    asked = [c for c in kinds if columns is None or c == "pos" or c in columns]
    schema = _schema(blocks, batch, *[(c, kinds[c]) for c in asked])

    def rounded(score: np.ndarray) -> np.ndarray:
        scale = 10.0**SCORE_DIGITS
        return np.sign(score) * (np.floor(np.abs(score) * scale + 0.5) / scale)

    def scores(mine: _Counted, right: pa.Table) -> list[np.ndarray]:
        """Of each of the region's pairs."""
        right = right.sort_by("bucket")
        order = mine.dealt(buckets)[0]
        found = []
        for name in ("n_base", "n_ref"):
            n = _returned(right, name, order)
            p = (n[: mine.distinct] + alpha) / (n[mine.distinct :][mine.context] + alpha * vocab)
            found.append(rounded(-np.log(p)))
        known = order[order >= mine.distinct]
        entropy = _returned(right, "entropy", known - mine.distinct, np.float64)
        entropy = rounded(np.where(np.isnan(entropy), math.log(vocab), entropy))
        return [*found, entropy[mine.context], rounded(found[0] - found[1])]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = pa.table([left[c] for c in batch], names=[f"k{i}" for i in range(len(batch))])
        order = keys.append_column("at", pa.array(np.arange(len(left)))).sort_by([(c, "ascending") for c in keys.column_names])
        left = left.take(order["at"])
        codes, sizes = _pair_codes(left["tokens"], vocab)
        mine = _counted(codes, vocab)
        found, at = scores(mine, right), mine.at
        # Where the blocks of each batch begin and end among the rows, and their positions.
        same = np.ones(max(0, len(left) - 1), bool)
        for c in batch:
            column = left[c].combine_chunks()
            same &= pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False) | (
                pc.is_null(column[1:]).to_numpy(zero_copy_only=False) & pc.is_null(column[:-1]).to_numpy(zero_copy_only=False)
            )
        first = np.concatenate([[0], np.flatnonzero(~same) + 1])
        cells = np.add.reduceat(sizes, first)
        block = np.repeat(np.arange(len(left)), sizes)
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        offsets = pa.array(np.concatenate([[0], np.cumsum(cells)]).astype(np.int32))
        measures = dict(zip(BATCH_SCORES, found))

        def values(name: str) -> pa.Array:
            if name in keep:
                return left[name].combine_chunks().take(pa.array(block))
            if name in measures:
                return pa.array(measures[name][at])
            return pa.array((pos if name == "pos" else codes // vocab if name == "prev" else codes % vocab).astype(np.int32))

        own = [left[c].take(pa.array(first)) for c in batch]
        own += [pa.ListArray.from_arrays(offsets, values(c)) for c in asked]
        return pa.table(own, names=schema.names).filter(pa.array(cells > 0))

    return blocks.groupBy(*near).cogroup(totals.groupBy(*near)).applyInArrow(score, schema)


def batch_positions(batches: DataFrame) -> DataFrame:
    """One row per position of the rows of ``score_batches``; single values are repeated."""
    lists = [f.name for f in batches.schema.fields if isinstance(f.dataType, T.ArrayType)]
    single = [c for c in batches.columns if c not in lists]
    at = batches.select("*", F.posexplode_outer("pos").alias("__at", "__pos")).filter("__pos is not null")
    return at.select(*single, *[F.col("__pos").alias(c) if c == "pos" else F.get(c, F.col("__at")).alias(c) for c in lists])


def with_pair_counts(
    blocks: DataFrame, reference: BigramModel | None, near: Sequence[str], vocab_size: int, parts: int,
    visits: DataFrame | None = None, key: str = "shard_block", counted: DataFrame | None = None,
) -> DataFrame:
    """Add the counts of ``n_base`` to blocks, how often the pair of every position occurs in
    all blocks, and of ``n_ref``, how often in the reference model, if there is one.

    A count is two columns, ``_low`` of LOW_BITS bits and ``_high``, which is mostly zeros,
    and ids are SMALLINT where the vocabulary allows: what moves later is small.

    The blocks, placed by ``near`` in ``parts`` partitions, stay where they are.  What is
    shuffled are packed lists of the distinct pairs of each region, to their totals and back, so
    a frequent pair has no more entries than there are regions.

    With ``visits``, rows of ``near``, ``key`` and more columns, a block gets a list of the
    latter, ``visits``: both meet in the region, without a join.
    ``counted`` are the rows of ``count_pairs``, if they are at hand.
    """
    buckets = pair_buckets(parts, vocab_size)
    counted = count_pairs(blocks, near, vocab_size, buckets) if counted is None else counted
    totals = total_pairs(counted, reference, near, vocab_size, buckets)
    columns, names = blocks.columns, [c for c in ("n_base", "n_ref") if c in totals.columns]
    by_visit = visits is not None
    more = [c for c in visits.columns if c not in columns] if by_visit else []
    if by_visit:
        totals = totals.unionByName(visits.select(*near, key, *more), allowMissingColumns=True)
    totals = totals.repartition(parts, *near)
    halves = [(f"{c}_low", T.ArrayType(T.ShortType())) for c in names]
    halves += [(f"{c}_high", T.ArrayType(T.LongType())) for c in names]
    listed = [("visits", T.ArrayType(_schema(visits, more)))] if by_visit else []
    schema = _schema(blocks, columns, *halves, *listed)
    narrow = vocab_size <= 1 << LOW_BITS
    if narrow:
        schema["tokens"].dataType = T.ArrayType(T.ShortType())

    def visited(left: pa.Table, right: pa.Table) -> pa.Array:
        """The visits of each block."""
        theirs, keys = right[key].to_numpy(), left[key].to_numpy()
        order = np.argsort(theirs, kind="stable")
        low, high = (np.searchsorted(theirs, keys, side, sorter=order) for side in ("left", "right"))
        sizes = high - low
        index = order[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        rows = right.select(more).take(pa.array(index, pa.int64()))
        visit = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in more], fields=list(rows.schema))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), visit)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, sizes = _pair_codes(left["tokens"], vocab_size)
        mine = _counted(codes, vocab_size)
        order = mine.dealt(buckets)[0]
        lists = right.filter(pc.is_valid(right["bucket"])).sort_by("bucket")
        counts = [_returned(lists, c, order)[mine.at] for c in names]
        found = [_lists((n & ((1 << LOW_BITS) - 1)).astype(np.int16), sizes) for n in counts]
        found += [_lists(n >> LOW_BITS, sizes) for n in counts]
        ids = left["tokens"].cast(pa.list_(pa.int16())) if narrow else left["tokens"]
        own = [ids if c == "tokens" else left[c] for c in columns]
        if by_visit:
            found.append(visited(left, right.filter(pc.is_null(right["bucket"]))))
        return pa.table([*own, *found], names=schema.names)

    return blocks.groupBy(*near).cogroup(totals.groupBy(*near)).applyInArrow(look_up, schema)


def score_counted(
    positions: DataFrame, totals: DataFrame, base: BigramModel, reference: BigramModel
) -> DataFrame:
    """``score_with_bigrams`` for positions that carry the halves of ``n_base`` and, unless
    the reference is the base model, of ``n_ref``.

    ``totals`` has ``prev, t_base``, the contexts of the base counts.  All that is looked
    up is a context, in a table bounded by the vocabulary.
    """
    if base.vocab_size != reference.vocab_size:
        raise ValueError("the two models must share a vocabulary")
    contexts = totals.join(
        reference.contexts.select("prev", F.col("total").alias("t_ref"), "entropy"), "prev", "left"
    )
    halves = count_columns(positions)
    keep = [c for c in positions.columns if c not in halves]
    wide = positions.withColumns({name: F.col(name).cast("int") for name in ("prev", "label")})
    found = wide.join(bounded(contexts, base.vocab_size), "prev", "left")

    def count(name: str) -> Column:
        return F.shiftleft(f"{name}_high", LOW_BITS) + F.col(f"{name}_low")

    scored = found.select(
        *keep,
        base.loss(count("n_base"), F.col("t_base")).alias("loss"),
        reference.loss(count("n_ref" if "n_ref_low" in halves else "n_base"), F.col("t_ref")).alias("ref_loss"),
        reference.entropy(F.col("entropy")).alias("ref_entropy"),
    )
    return scored.withColumn("excess", _rounded_excess("loss", "ref_loss"))


def context_totals(blocks: DataFrame) -> DataFrame:
    """``prev, t_base``: how often each token of the blocks has a successor."""
    inputs = F.slice("tokens", F.lit(1), F.size("tokens") - 1)
    prev = F.explode_outer(F.when(F.size("tokens") > 1, inputs)).alias("prev")
    return blocks.select(prev).filter("prev is not null").groupBy("prev").agg(F.count(F.lit(1)).alias("t_base"))


def _rounded_excess(loss: str, ref_loss: str) -> Column:
    return _rounded(excess_loss(loss, ref_loss))


def score_logit_slices(
    slices: DataFrame, keys: Sequence[str], label: str = "label", first_id: str = "first_id", logits: str = "logits"
) -> DataFrame:
    """``loss`` and ``entropy`` of every position from slices of its logits.

    A row holds the logits of the ids from ``first_id`` on; a position's rows, one for
    each part of the vocabulary, share ``keys`` and ``label``.  Logits are reduced where
    they are read: only three sums, and the label's logit, of each slice are shuffled.
    A position without logits has neither; one whose label is null or in no slice has no loss.
    """
    place = F.col(label) - F.col(first_id)
    narrow = slices.select(
        *keys,
        logit_state(logits).alias("state"),
        F.get(logits, F.when(place >= 0, place).cast("int")).cast("double").alias("own"),
    )
    # A position has as many slices as the vocabulary was cut into.
    gathered = narrow.groupBy(*keys).agg(F.collect_list("state").alias("states"), F.max("own").alias("own"))
    merged = gathered.withColumn("state", merged_state("states"))
    return merged.select(
        *keys, (state_normaliser("state") - F.col("own")).alias("loss"), state_entropy("state").alias("entropy")
    )


# tokens [batch, length + 1] -> loss, ref_loss, ref_entropy, each [batch, length]
BlockScorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def score_blocks(
    blocks: DataFrame,
    scorer: Callable[[], BlockScorer],
    keep: Sequence[str],
    batch_rows: int = 16,
    place: Sequence[str] = (),
) -> DataFrame:
    """Run a caller's model over blocks, ``batch_rows`` at a time.

    Returns ``keep`` plus one row per position.  Scores cross from Python as one
    array per block and are exploded in the JVM.  With ``place``, columns of ``keep``,
    blocks that agree on them are put together before, as arrays, so that a selection
    by them moves no positions.
    """
    names = ["loss", "ref_loss", "ref_entropy"]
    kept = [f for f in blocks.schema.fields if f.name in keep]
    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    ints = T.StructField("tokens", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*kept, ints, *arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()

        def scored(rows: pa.RecordBatch) -> list[np.ndarray]:
            lists = rows["tokens"]
            lengths = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(lengths) > 1:
                raise ValueError("blocks that are scored together must have one length")
            tokens = lists.flatten().to_numpy().reshape(len(lists), -1)
            return [np.asarray(values, dtype=np.float64) for values in score(tokens)]

        for batch in batches:
            at = 0
            while at < len(batch):
                # Several calls of the model make one batch of scores of a bounded size.
                parts, begin, cells = [], at, 0
                while at < len(batch) and cells < SCORED_CELLS:
                    parts.append(scored(batch.slice(at, batch_rows)))
                    cells += parts[-1][0].size
                    at += batch_rows
                columns = []
                for values in zip(*parts):
                    sizes = np.concatenate([np.full(len(v), v.shape[1]) for v in values])
                    columns.append(_lists(np.concatenate([v.ravel() for v in values]), sizes))
                rows = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=schema.names)

    ran = blocks.select(*[f.name for f in kept], "tokens").mapInArrow(run, schema)
    if place:
        ran = ran.repartition(*place).sortWithinPartitions(*place)
    n = F.size("tokens") - 1
    zipped = F.arrays_zip(
        F.slice("tokens", F.lit(1), n).alias("prev"),
        F.slice("tokens", F.lit(2), n).alias("label"),
        *[F.col(name) for name in names],
    )
    keys = [f.name for f in kept]
    flat = ran.select(*keys, F.posexplode_outer(zipped).alias("pos", "__s"))
    return flat.select(*keys, "pos", "__s.*").withColumn("excess", excess_loss("loss", "ref_loss"))
