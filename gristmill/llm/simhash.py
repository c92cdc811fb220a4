"""SimHash near-duplicates by pivot distance tables (operator 9).

Fingerprints within a few bits of each other are linked; the links' components are
the duplicate groups.  Only distinct fingerprints are compared.  Two that differ in
at most d bits agree on m - d of any m blocks of bits, so rows meet in a bucket for
each such choice of blocks.  Inside a bucket a table of Hamming distances to fixed
reference fingerprints is computed once per row; a pair whose coordinates differ by
more than d anywhere is discarded (triangle inequality), and the survivors are
verified.  A bucket gives a spanning forest of its links, not its pairs, and one with
too many rows is divided again by the bits it doesn't agree on yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import add_columns, raw_bytes
from gristmill.llm.components import connected_components
from gristmill.operators.joins import weighted_lookup
from gristmill.operators.staging import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCKS = 7
PIVOTS = 16
# A bucket of more rows than this is divided further.
BUCKET_ROWS = 4096
FULL = (1 << 64) - 1


def simhash_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the words of a text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    reach = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - reach
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[reach:].tolist())), np.uint64, n
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a signed long; texts without words have 0."""

    def start():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = np.array([simhash_of(x, shingle) for x in raw_bytes(part.column(text))], np.uint64)
            return [pa.array(found.view(np.int64), pa.int64())]

        return work

    return add_columns(docs, text, [(out, T.LongType())], start)


def _pivots() -> np.ndarray:
    """Reference fingerprints by a rule: odd multiples of the golden ratio, mixed."""
    x = (np.arange(1, 2 * PIVOTS, 2, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _masks(agreed: int, distance: int) -> list[int]:
    """Bits that rows must share to meet: every choice of all but ``distance`` blocks
    of the bits not agreed on yet, with the agreed ones."""
    free = [1 << i for i in range(64) if not agreed >> i & 1]
    n = min(max(BLOCKS, distance + 3), len(free))
    if n <= distance:
        return [agreed]
    blocks = [sum(free[i * len(free) // n : (i + 1) * len(free) // n]) for i in range(n)]
    return [agreed | sum(pick) for pick in combinations(blocks, n - distance)]


def _spread(rows: DataFrame, distance: int) -> DataFrame:
    """(agreed, key, fp) rows, one for each bucket that a fingerprint visits next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            agreed = batch.column("agreed").to_numpy().view(np.uint64)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for value in np.unique(agreed).tolist():
                masks = known.get(value)
                if masks is None:
                    masks = known[value] = np.array(_masks(value, distance), np.uint64)
                own = fp[agreed == np.uint64(value)]
                for mask in masks:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(own), mask).view(np.int64)),
                            pa.array((own & mask).view(np.int64)),
                            pa.array(own.view(np.int64)),
                        ],
                        names=["agreed", "key", "fp"],
                    )

    return rows.mapInArrow(run, "agreed long, key long, fp long")


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang the roots of linked rows under the smaller root until no link crosses trees."""
    while len(a):
        la, lb = label[a], label[b]
        cross = la != lb
        a, b, la, lb = a[cross], b[cross], la[cross], lb[cross]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _bucket_links(agreed: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among sorted rows whose (agreed, key) are equal."""
    values, at = np.unique(fp, return_inverse=True)
    pivots = _pivots()
    table = np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.int8)
    label = np.arange(len(values))
    left = np.arange(len(fp))
    step = 1
    while True:
        left = left[left + step < len(fp)]
        right = left + step
        same = (key[left] == key[right]) & (agreed[left] == agreed[right])
        left = left[same]
        if not len(left):
            break
        a, b = at[left], at[left + step]
        apart = (label[a] != label[b]) & (a != b)
        a, b = a[apart], b[apart]
        near = np.ones(len(a), bool)
        for p in range(PIVOTS):  # discard by the largest difference of coordinates
            still = np.flatnonzero(near)
            near[still] = np.abs(table[a[still], p] - table[b[still], p]) <= distance
        a, b = a[near], b[near]
        verified = np.bitwise_count(values[a] ^ values[b]) <= distance
        _union(label, a[verified], b[verified])
        step += 1
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def _links(rows: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """(u, v, agreed): links of small buckets, and rows of large ones (v null) to be spread again."""
    sorted_rows = rows.repartition("agreed", "key").sortWithinPartitions("agreed", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, v: np.ndarray | None, agreed: np.ndarray) -> pa.RecordBatch:
            other = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), other, pa.array(agreed.view(np.int64))], names=["u", "v", "agreed"]
            )

        def settle(agreed: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (agreed[1:] != agreed[:-1])]))
            sizes = np.diff(np.append(starts, len(key)))
            # Blocks of at most 12 bits hold no more distinct rows than the limit.
            large = np.repeat(sizes > bucket_rows, sizes) & (np.bitwise_count(~agreed) > 12)
            if large.any():
                yield out(fp[large], None, agreed[large])
            small = np.repeat(sizes > 1, sizes) & ~large
            if small.any():
                u, v = _bucket_links(agreed[small], key[small], fp[small], distance)
                if len(u):
                    yield out(u, v, np.zeros(len(u), np.uint64))

        held = [np.zeros(0, np.uint64)] * 3
        flushed: tuple[int, int] | None = None
        for batch in batches:
            new = [batch.column(n).to_numpy().view(np.uint64) for n in ("agreed", "key", "fp")]
            held = [np.concatenate([h, x]) for h, x in zip(held, new)]
            if flushed:  # the rest of a bucket known to be large
                more = (held[0] == flushed[0]) & (held[1] == flushed[1])
                if more.any():
                    yield out(held[2][more], None, held[0][more])
                    held = [h[~more] for h in held]
                if not len(held[0]):
                    continue
                flushed = None
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            done = [h[~last] for h in held]
            if len(done[0]):
                yield from settle(*done)
            held = [h[last] for h in held]
            if len(held[0]) > bucket_rows and np.bitwise_count(~held[0][:1])[0] > 12:
                flushed = (held[0][0], held[1][0])
                yield out(held[2], None, held[0])
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from settle(*held)

    return sorted_rows.mapInArrow(run, "u long, v long, agreed long")


def link_fingerprints(distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that join every two fingerprints ``fp`` within ``distance`` bits.

    A spanning set: what they connect is what all links connect.  Buckets of more than
    ``bucket_rows`` rows come back and are divided by further bits, until none is left.
    """
    pending = distinct.select(F.lit(0).cast("long").alias("agreed"), "fp")
    found = None
    while True:
        step = stage(_links(_spread(pending, distance), distance, bucket_rows), "links")
        links = step.filter("v is not null").select("u", "v")
        found = links if found is None else found.unionByName(links)
        pending = step.filter("v is null").select("agreed", F.col("u").alias("fp")).distinct()
        if pending.isEmpty():
            return found


def _rooted(nodes: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """A table with distinct fingerprints ``fp``, and their ``root``."""
    roots = connected_components(link_fingerprints(nodes.select("fp"), distance, bucket_rows))
    return nodes.join(roots, nodes.fp == roots.node, "left").select(
        *nodes.columns, F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(doc_id, simhash, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of at most ``distance``
    bits, the own one included.  Null, empty and white-space texts have fingerprint 0
    and are linked like any other.  Repeated rows each come out, in one group; a null
    id never is the smallest, and a group of null ids has a null component.  An empty
    table gives an empty one.  Other columns are not looked at.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stage(fingerprints(plain, "text", "simhash", shingle).select("doc_id", "simhash"), "simhash")
    total = marked.count()
    nodes = marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    # Written once: the roots are counted, looked up and looked up by.
    rooted = stage(_rooted(nodes, distance, bucket_rows), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = weighted_lookup(rooted, least, "root", "n", total, ["fp"])
    named = named.select(F.col("fp").alias("simhash"), "component_id", "rows")
    # Texts that many rows share, the empty one too, are divided as large components are.
    return weighted_lookup(marked, named, "simhash", "rows", total, ["doc_id"]).select("doc_id", "simhash", "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, null ids
    last; of rows that share it, the one with the least digest of the whole row.

    A row is known by that digest, not by its id, so a repeated or null id neither keeps
    nor loses another component's row, and the choice is the same in every run.
    """
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    keyed = docs.withColumn("__key", F.sha2(F.concat_ws("\n", others, F.sha2(F.col(text), 256)), 256))
    plain = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "__key")
    marked = stage(fingerprints(plain, "text", "simhash", shingle).select("doc_id", "__key", "simhash"), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key")
    nodes = marked.groupBy(F.col("simhash").alias("fp")).agg(F.min(order).alias("first"))
    least = _rooted(nodes, distance, bucket_rows).groupBy("root").agg(F.min("first").alias("first"))
    kept = keyed.join(least.select("first.__key"), "__key", "left_semi")
    # Rows that are equal in every column have one key.
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
