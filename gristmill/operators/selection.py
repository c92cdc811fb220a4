"""Token selection by top ratio within a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gristmill.functions.losses import excess_loss
from gristmill.operators.joins import bounded
from gristmill.operators.scoring import batch_positions
from gristmill.operators.staging import stage

# Default ratios.
EXCESS_RATIO = 0.6
LOW_LOSS_RATIO = 0.7
LOW_ENTROPY_RATIO = 0.7
HIGH_LOSS_RATIO = 0.6
HIGH_ENTROPY_RATIO = 0.6

METHODS = ("self_reference_intersection", "excess_loss", "high_intersection")


def finite(score: Column) -> Column:
    """NaN would outrank every number, so a score that is not finite is an error."""
    sound = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return F.when(sound, score).otherwise(F.raise_error(F.lit("a token score is not finite")))


Ranked = Sequence[tuple[Column | str, float]]


def _score(measure: Column | str) -> Column:
    """A measure is a column, its name, or with a minus its name for the lowest first."""
    if not isinstance(measure, str):
        return measure
    return -F.col(measure[1:]) if measure.startswith("-") else F.col(measure)


def _checked(ratio: float) -> float:
    if not 0.0 < ratio <= 1.0:
        raise ValueError(f"cannot keep a share of {ratio}: give a number above 0 and at most 1")
    return float(ratio)


def by_batch(scores: DataFrame, ranked: Ranked) -> bool:
    """Whether ``scores`` has the rows of ``score_batches``, whose measures are lists."""
    names = [m.lstrip("-") for m, _ in ranked if isinstance(m, str)]
    lists = [n for n in names if isinstance(scores.schema[n].dataType, ArrayType)]
    if lists and len(lists) < len(ranked):
        raise ValueError("name the measures of scores that have a row per batch")
    return bool(lists)


def _marked_batches(scores: DataFrame, ranked: Ranked, out: str) -> DataFrame:
    """Of a batch in one row the k-th highest is an entry of the sorted list, so the
    positions are made with the thresholds beside them."""
    marks, least = [], []
    for i, (name, ratio) in enumerate(ranked):
        low, column = name.startswith("-"), name.lstrip("-")
        k = F.greatest(F.lit(1), F.ceil(F.size(column) * F.lit(_checked(ratio)))).cast("int")
        scores = scores.withColumn(f"__least{i}", F.get(F.sort_array(column, asc=low), k - 1))
        least.append(f"__least{i}")
        score = finite(F.col(column))
        marks.append(score <= F.col(least[i]) if low else score >= F.col(least[i]))
    return batch_positions(scores).withColumn(out, reduce(and_, marks)).drop(*least)


def with_top_ratio(
    scores: DataFrame, ranked: Ranked, batch: Sequence[str], out: str = "selected"
) -> DataFrame:
    """Mark the positions that are among the highest by *every* (score, ratio).

    ``scores`` has a row per position, or one per batch (``score_batches``); then measures
    are given by name.  The result has a row per position.

    Of a batch of n, the ``max(1, ceil(n * ratio))`` highest scores count, ties
    included: those that reach the k-th highest, which is what ``percentile_disc``
    over the descending scores returns.  The product is taken in doubles; as a
    decimal, ``ceil(100 * 0.07)`` would be 7 and not 8.  All thresholds come from
    one window without an order, and a batch has a fixed size.
    """
    if by_batch(scores, ranked):
        return _marked_batches(scores, ranked, out)
    over = ", ".join(f"`{name}`" for name in batch)
    tests = []
    for i, (score, ratio) in enumerate(ranked):
        scores = scores.withColumn(f"__score{i}", finite(_score(score)))
        tests.append(
            f"__score{i} >= percentile_disc({_checked(ratio)!r}D) WITHIN GROUP (ORDER BY __score{i} DESC) "
            f"OVER (PARTITION BY {over})"
        )
    marked = scores.withColumn(out, F.expr(" AND ".join(tests)))
    return marked.drop(*[f"__score{i}" for i in range(len(ranked))])


# Bits of a score that one round of counting settles, from the highest down.
SHIFTS = (52, 40, 28, 16, 4, 0)


def ordered_bits(score: Column) -> Column:
    """The 64 bits of a DOUBLE as a BIGINT in the order of the numbers; 0.0 and -0.0 agree."""

    @F.arrow_udf("bigint")
    def bits(column: pa.Array) -> pa.Array:
        return pa.array(_bits(column.to_numpy(zero_copy_only=False)))

    return bits(score.cast("double"))


def _bits(scores: np.ndarray) -> np.ndarray:
    raw = (scores.astype(np.float64) + 0.0).view(np.int64)
    return raw ^ ((raw >> 63) & np.int64((1 << 63) - 1))


def _rank(n: Column, ratio: float | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(ratio))).cast("bigint")


def _kth_highest(rows: DataFrame, ratio: float) -> DataFrame:
    """(__batch, prefix): bits of the k-th highest score of each batch.

    Each round counts, among the rows that share the bits settled so far, those with
    each value of the next 12 bits, and goes on in the one that holds the k-th.
    """
    sizes = rows.groupBy("__batch").agg(F.count(F.lit(1)).alias("n"))
    state = stage(sizes.select("__batch", _rank(F.col("n"), float(ratio)).alias("k")), "kth")
    return _settled(rows.withColumn("n", F.lit(1).cast("bigint")), state, None, SHIFTS)


def _settled(rows: DataFrame, state: DataFrame, above: int | None, shifts: Sequence[int]) -> DataFrame:
    """The rounds of ``_kth_highest`` over (__batch, bits, n), with n rows of equal bits."""
    batches = state.count()
    for shift in shifts:
        near = rows.join(bounded(state, batches), "__batch")
        if above is not None:
            near = near.filter(F.shiftright("bits", above) == F.col("prefix"))
        counted = near.groupBy("__batch", F.shiftright("bits", shift).alias("prefix")).agg(
            F.sum("n").alias("n"), F.first("k").alias("k")
        )
        state = stage(_holding_kth(counted), "kth")
        above = shift
    return state.select("__batch", "prefix")


def _holding_kth(counted: DataFrame) -> DataFrame:
    """Of each batch's counts by prefix, at most 65,536, the prefix that holds the k-th
    highest, and its rank there."""
    upto = F.sum("n").over(Window.partitionBy("__batch").orderBy(F.desc("prefix")))
    found = counted.withColumn("upto", upto).filter("upto >= k and upto - n < k")
    return found.select("__batch", "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))


# Of the bits of a score, those below the ones that the first pass over lists settles.
LOW = 48
# Scores whose bits are worked out at a time.
SCORES_AT_ONCE = 1 << 22


def _bit_counts(rows: DataFrame, names: Sequence[str], near: Sequence[str] = ()) -> DataFrame:
    """(__batch, measure, bits, n): how often the lists of a measure have each value of the bits
    from LOW up; with ``near``, columns of such a value for each measure, how often
    they have each whole value that begins with it."""
    kind = rows.schema["__batch"].dataType
    schema = StructType([StructField("__batch", kind), *[StructField(n, LongType()) for n in ("measure", "bits", "n")]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells = whole[names[0]].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            turns = np.unique(np.cumsum(cells, dtype=np.int64) // SCORES_AT_ONCE, return_index=True)[1]
            for begin, end in zip(turns, [*turns[1:], len(whole)]):
                rows_now = whole.slice(begin, end - begin)
                keys = rows_now["__batch"].to_pylist()
                # Rows of one batch are told by where its first one is.
                firsts = {}
                own = np.array([firsts.setdefault(repr(key), i) for i, key in enumerate(keys)])
                group = np.repeat(own, cells[begin:end])
                for measure, name in enumerate(names):
                    bits, at = _bits(rows_now[name].flatten().to_numpy(zero_copy_only=False)), group
                    if near:
                        wanted = rows_now[near[measure]].to_numpy(zero_copy_only=False)
                        same = (bits >> LOW) == np.repeat(wanted, cells[begin:end])
                        bits, at = bits[same], at[same]
                    else:
                        bits = bits >> LOW
                    if not len(bits):
                        continue
                    order = np.lexsort((bits, at)) if len(firsts) > 1 else np.argsort(bits)
                    bits, at = bits[order], at[order]
                    start = np.flatnonzero(np.concatenate([[True], (bits[1:] != bits[:-1]) | (at[1:] != at[:-1])]))
                    n = np.diff(start, append=len(bits))
                    columns = [pa.array(c.astype(np.int64)) for c in (np.full(len(start), measure), bits[start], n)]
                    own_key = rows_now["__batch"].take(pa.array(at[start].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([own_key, *columns], names=schema.names)

    counted = rows.select("__batch", *names, *near).mapInArrow(count, schema)
    return counted.groupBy("__batch", "measure", "bits").agg(F.sum("n").alias("n"))


def _marked_batches_spread(keyed: DataFrame, ranked: Ranked, out: str) -> DataFrame:
    """Two passes over the lists: the first counts by the high bits of the scores, the second
    the scores near the k-th; those are few, and further rounds settle them."""
    names = [name.lstrip("-") for name, _ in ranked]
    shares = F.array(*[F.lit(_checked(ratio)) for _, ratio in ranked])
    # The k-th lowest of n is the (n + 1 - k)-th highest.
    lowest = F.array(*[F.lit(name.startswith("-")) for name, _ in ranked])
    high = stage(_bit_counts(keyed, names), "bits").withColumnRenamed("bits", "prefix")
    keyed_by = F.struct("__batch", "measure").alias("__batch")
    high = high.select(keyed_by, "prefix", "n")
    sizes = high.groupBy("__batch").agg(F.sum("n").alias("size"))
    at = F.col("__batch.measure").cast("int")
    k = _rank(F.col("size"), F.get(shares, at))
    k = F.when(F.get(lowest, at), F.col("size") + 1 - k).otherwise(k)
    state = stage(_holding_kth(high.join(sizes.select("__batch", k.alias("k")), "__batch")), "kth")
    one = F.col("__batch.__batch").alias("__batch")
    near = [f"__near{i}" for i in range(len(names))]
    prefixes = state.groupBy(one).pivot("__batch.measure", list(range(len(names)))).agg(F.first("prefix")).toDF("__batch", *near)
    batches = prefixes.count()
    rows = _bit_counts(keyed.join(bounded(prefixes, batches), "__batch"), names, near)
    rows = stage(rows.select(keyed_by, "bits", "n"), "bits")
    least = _settled(rows, state, LOW, (32, 16, 0))
    found = least.groupBy(one).pivot("__batch.measure", list(range(len(names)))).agg(F.first("prefix"))
    found = found.toDF("__batch", *[f"__least{i}" for i in range(len(names))])
    for i in range(len(names)):
        found = found.withColumn(f"__least{i}", score_of_bits(F.col(f"__least{i}")))
    positions = batch_positions(keyed.join(bounded(stage(found, "least"), batches), "__batch"))
    marks = []
    for i, (name, _) in enumerate(ranked):
        score, bar = finite(F.col(names[i])), F.col(f"__least{i}")
        marks.append(score <= bar if name.startswith("-") else score >= bar)
    return positions.withColumn(out, reduce(and_, marks)).drop("__batch", *[f"__least{i}" for i in range(len(names))])


def score_of_bits(bits: Column) -> Column:
    """The DOUBLE that ``ordered_bits`` gives these bits."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        raw = column.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((raw ^ ((raw >> 63) & np.int64((1 << 63) - 1))).view(np.float64))

    return score(bits)


def with_top_ratio_spread(
    scores: DataFrame, ranked: Ranked, batch: Sequence[str], out: str = "selected"
) -> DataFrame:
    """The mask of ``with_top_ratio`` for batches of any size, such as all positions.

    No task gets a whole batch: thresholds come from counts over the bits of the scores,
    exact and with ties, and meet the rows by batch.  ``scores`` is read twice, so write
    it before.  Null batch keys are a batch; no ``batch`` at all is one of everything.
    """
    key = F.struct(*batch) if batch else F.struct(F.lit(0).alias("all"))
    keyed = scores.withColumn("__batch", key)
    if by_batch(scores, ranked):
        return _marked_batches_spread(keyed, ranked, out)
    marks = []
    for i, (score, ratio) in enumerate(ranked):
        _checked(ratio)
        keyed = keyed.withColumn(f"__bits{i}", ordered_bits(finite(_score(score))))
        marks.append(F.col(f"__bits{i}") >= F.col(f"__least{i}"))
    for i, (_, ratio) in enumerate(ranked):
        narrow = stage(keyed.select("__batch", F.col(f"__bits{i}").alias("bits")), "bits")
        least = _kth_highest(narrow, ratio).withColumnRenamed("prefix", f"__least{i}")
        keyed = keyed.join(bounded(least, least.count()), "__batch")
    chosen = marks[0]
    for mark in marks[1:]:
        chosen = chosen & mark
    return keyed.select(*[c for c in scores.columns if c != out], chosen.alias(out))


def select_tokens(
    scores: DataFrame,
    method: str = "self_reference_intersection",
    batch: Sequence[str] = ("shard", "batch_no"),
    loss_ratio: float | None = None,
    entropy_ratio: float | None = None,
    excess_ratio: float = EXCESS_RATIO,
    out: str = "selected",
) -> DataFrame:
    """Add the BOOLEAN mask of a method.

    ``self_reference_intersection``: low reference loss and low reference entropy.
    ``high_intersection``: high reference loss and high reference entropy.
    ``excess_loss``: high loss minus reference loss.
    """
    if method == "excess_loss":
        known = "excess" in scores.columns
        ranked = [("excess" if known else excess_loss("loss", "ref_loss"), excess_ratio)]
    elif method == "self_reference_intersection":
        ratios = _default(loss_ratio, LOW_LOSS_RATIO), _default(entropy_ratio, LOW_ENTROPY_RATIO)
        ranked = [("-ref_loss", ratios[0]), ("-ref_entropy", ratios[1])]
    elif method == "high_intersection":
        ratios = _default(loss_ratio, HIGH_LOSS_RATIO), _default(entropy_ratio, HIGH_ENTROPY_RATIO)
        ranked = [("ref_loss", ratios[0]), ("ref_entropy", ratios[1])]
    else:
        raise ValueError(f"unknown selection method {method!r}; known: {', '.join(METHODS)}")
    return with_top_ratio(scores, ranked, batch, out)


def _default(ratio: float | None, default: float) -> float:
    return default if ratio is None else ratio
