"""Language identification (operator 3): multinomial naive Bayes over hashed character n-grams.

Learning is one pass that counts hashed n-grams per language and a grouped sum.
The log-probability matrix (buckets x languages, a bounded size) then travels to the
tasks, which score batches of texts: the n-grams of a batch are hashed with numpy,
their matrix rows gathered and summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import add_columns, raw_bytes, slices
from gristmill.operators.staging import stage

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 512
SMOOTHING = 0.02
UNKNOWN = "und"
# n-grams scored together; a long text is scored in such pieces.
CHUNK = 1 << 20


def _letters(text: bytes) -> np.ndarray:
    """Code points of the lower-cased text; every run of non-letters is one space."""
    lowered = text.decode("utf-8", "replace").lower()
    points = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    if lowered.isascii():
        letter = (points >= 97) & (points <= 122)
    else:
        distinct, at = np.unique(points, return_inverse=True)
        letter = np.fromiter((chr(p).isalpha() for p in distinct.tolist()), bool, len(distinct))[at]
    if not letter.any():
        return np.zeros(0, np.uint32)
    shown = np.where(letter, points, 32).astype(np.uint32)
    keep = letter | np.concatenate([[True], letter[:-1]])
    return np.concatenate([[np.uint32(32)], shown[keep], [np.uint32(32)]])


def _hashed(points: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Bucket numbers of the n-grams, an array for each order; the order enters the hash."""
    out = []
    state = np.zeros(len(points), np.uint64)
    for i in range(max(ORDERS)):
        if len(points) <= i:
            break
        state = (state[: len(points) - i] * np.uint64(0x100000001B3)) ^ (points[i:].astype(np.uint64) + np.uint64(1))
        if i + 1 in ORDERS:
            mixed = (state + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
    return out


def _pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that together have each of its n-grams once or a few twice."""
    reach = max(ORDERS) - 1
    for i in range(0, max(len(points), 1), CHUNK):
        yield points[max(0, i - reach) : i + CHUNK]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """Counts (lang, bucket, n) of the hashed n-grams of all rows with a language.

    Null texts and null languages teach nothing.  A task emits at most buckets x
    languages rows, whatever it reads.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for name, body in zip(part.column("lang").to_pylist(), raw_bytes(part.column("text"))):
                    counts = held.setdefault(name, np.zeros(buckets, np.int64))
                    for piece in _pieces(_letters(body)):
                        for h in _hashed(piece, buckets):
                            counts += np.bincount(h, minlength=buckets)
        for name, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen)), pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    parts = rows.mapInArrow(count, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def matrix(counts: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Sorted languages and their log-probabilities, buckets x languages.

    At most buckets x MAX_LANGUAGES numbers reach the driver; more languages are an error.
    """
    counts = stage(counts, "ngrams")
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((buckets, len(names)))
    found = counts.toArrow()
    column = {name: i for i, name in enumerate(names)}
    at = np.array([column[x] for x in found["lang"].to_pylist()], np.int64)
    table[found["bucket"].to_numpy(), at] = found["n"].to_numpy()
    table += SMOOTHING
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
    out: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """Add the most probable language of each whole text and a score from 0 to 1.

    The score is the share of the language in the posterior of the mean n-gram, so
    it doesn't saturate with length: exp of the mean log-probability, normalized over
    languages with an exponent of 8.  Languages have equal priors: how often one was
    labelled says nothing of a text.  Equal languages: the first by name.  Null, empty
    and letterless texts, and any text if nothing was learned, get ``und`` and 0.
    Only the text is looked at.  Input columns of the two names are replaced.
    """
    names, table = model
    buckets = len(table)

    def start():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found, scores = [], []
            for body in raw_bytes(part.column(text)):
                total, n = np.zeros(len(names)), 0
                points = _letters(body)
                if len(points) and names:
                    for piece in _pieces(points):
                        for h in _hashed(piece, buckets):
                            # Sparse row times matrix: distinct buckets once each.
                            if len(h) > buckets // 4:
                                weight = np.bincount(h, minlength=buckets)
                                total += weight.astype(np.float64) @ table
                            else:
                                total += table[h].sum(axis=0, dtype=np.float64)
                            n += len(h)
                if not n:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                share = np.exp(8.0 * (total - total[best]) / n)
                found.append(names[best])
                scores.append(float(1.0 / share.sum()))
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return work

    return add_columns(docs, text, [(out, T.StringType()), (score, T.DoubleType())], start)


def accepted(pred: Column, score: Column, least: float) -> Column:
    """A text whose language is known with at least this score."""
    return (pred != F.lit(UNKNOWN)) & (score >= F.lit(least))
