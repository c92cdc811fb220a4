"""Per-position losses as column expressions.

A position's logits are read once, into the state (top, mass, weighted): the largest
logit, sum(exp(x - top)) and sum((x - top) * exp(x - top)).  Loss and entropy follow from
it, and the states of slices of the vocabulary add up to that of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("top", "mass", "weighted")])
# Logits that are shifted and exponentiated at a time.
CELLS = 1 << 22


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _states(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """State of each stretch of ``x``; stretches are not empty."""
    top = np.maximum.reduceat(x, starts)
    with np.errstate(invalid="ignore"):
        off = x - np.repeat(np.where(top == -np.inf, 0.0, top), sizes)
        share = np.exp(off)
        # A logit of minus infinity has no mass, hence no weight.
        weight = np.where(share > 0, off, 0.0) * share
        return [top, np.add.reduceat(share, starts), np.add.reduceat(weight, starts)]


def logit_state(logits: Column | str) -> Column:
    """The state of an ARRAY of logits; null for null and empty arrays.

    Null logits count as minus infinity; logits that all are have no mass, and neither
    loss nor entropy.  One that is not a number or plus infinity makes both not a number.
    """

    @F.arrow_udf(STATE)
    def states(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.cast(column.flatten(), pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[some])
        found = np.zeros((3, len(sizes)))
        begin = 0
        while begin < len(some):
            low = ends[begin] - sizes[some[begin]]
            end = max(begin + 1, int(np.searchsorted(ends, low + CELLS, "right")))
            own = sizes[some[begin:end]]
            found[:, some[begin:end]] = _states(flat[low : ends[end - 1]], np.cumsum(own) - own, own)
            begin = end
        none = pa.array(sizes == 0)
        return pa.StructArray.from_arrays([pa.array(c) for c in found], STATE.names, mask=none)

    return states(_c(logits))


def merged_state(states: Column | str) -> Column:
    """The state of a position from an ARRAY of the states of its slices."""
    tops = F.transform(states, lambda s: s["top"])
    first = F.struct(
        F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("weighted")
    )

    def add(a: Column, s: Column) -> Column:
        """Both sums moved to the larger of the two tops."""
        top = F.greatest(a["top"], s["top"])

        def moved(x: Column) -> tuple[Column, Column]:
            by = F.when(x["top"] == float("-inf"), float("-inf")).otherwise(x["top"] - top)
            mass = x["mass"] * F.exp(by)
            # A side without mass, whose top may be minus infinity, adds nothing.
            return F.when(mass == 0, 0.0).otherwise(mass), F.when(mass == 0, 0.0).otherwise(
                x["weighted"] * F.exp(by) + mass * by
            )

        (m, u), (n, v) = moved(a), moved(s)
        return F.struct(top.alias("top"), (m + n).alias("mass"), (u + v).alias("weighted"))

    known = F.filter(states, lambda s: s.isNotNull())
    return F.when(F.size(F.filter(tops, lambda t: t.isNotNull())) > 0, F.aggregate(known, first, add))


def state_normaliser(state: Column | str) -> Column:
    """ln(sum(exp(x))) of the position."""
    s = _c(state)
    return s["top"] + F.log(s["mass"])


def state_entropy(state: Column | str) -> Column:
    """-sum(p ln p) of the position's distribution."""
    s = _c(state)
    return F.log(s["mass"]) - s["weighted"] / s["mass"]


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """Unreduced loss of one position from its ARRAY of logits; labels count from 0.

    Null without logits, and for a label that is null or has none.
    """
    scores = _c(logits)
    return state_normaliser(logit_state(scores)) - F.get(scores, _c(label).cast("int")).cast("double")


def predictive_entropy(logits: Column | str) -> Column:
    """-sum(p ln p) of the distribution an ARRAY of logits stands for; null without logits."""
    return state_entropy(logit_state(logits))


def excess_loss(loss: Column | str, ref_loss: Column | str) -> Column:
    return _c(loss) - _c(ref_loss)


def perplexity(mean_loss: Column | str) -> Column:
    return F.exp(_c(mean_loss))
