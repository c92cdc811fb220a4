"""Document fingerprints (operator 2): a Merkle tree over sections and paragraphs.

Built-in expressions only.  Sections are parted by an empty line, paragraphs by a line
break, runs of a few words are the leaves; a node's hash covers its children's, so the
root determines the text.  Equal roots mean equal texts, and the branches whose hashes
differ locate an edit.  The share of leaves that two trees have in common is their
likeness: equal branches are counted whole, leaves are compared in differing ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.running import range_splits, with_bucket

SECTION_BREAK = "\n\n"
PARAGRAPH_BREAK = "\n"
# Up to four words with the white space before them, or white space alone; very long
# words are cut.  Every character is in one leaf, and no leaf goes on behind a line break.
LEAF_PATTERN = r"(?:[ \t\x0B\f\r]*[^ \t\n\x0B\f\r]{1,64}){1,4}|[ \t\n\x0B\f\r]+"
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 8192


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def leaves(text: Column) -> Column:
    """Hashes of the runs of words, by section and paragraph."""
    runs = lambda p: F.regexp_extract_all(p, F.lit(LEAF_PATTERN), F.lit(0))
    hashed = lambda p: F.transform(runs(p), lambda x: F.md5(x))
    return F.transform(
        F.split(text, SECTION_BREAK, -1), lambda s: F.transform(F.split(s, PARAGRAPH_BREAK, -1), hashed)
    )


def _over(children: Column) -> Column:
    """Hash of a node; its children's hashes have one width."""
    return F.sha2(F.concat_ws("", children), 256)


def tree(text: Column) -> Column:
    """All nodes: root, section hashes, paragraph hashes of each section, leaves of each paragraph."""
    paragraphs = lambda own: F.transform(own, lambda s: F.transform(s, _over))
    nodes = lambda own, par, sec: F.struct(
        _over(sec).alias("root"), sec.alias("sections"), par.alias("paragraphs"), own.alias("leaves")
    )
    return _with(
        leaves(text),
        lambda own: _with(paragraphs(own), lambda par: _with(F.transform(par, _over), lambda sec: nodes(own, par, sec))),
    )


def _n_leaves(one: Column) -> Column:
    """Of a tree."""
    return F.aggregate(F.flatten(one["leaves"]), F.lit(0), lambda n, p: n + F.size(p))


def differing(one: Column, other: Column) -> Column:
    """Leaves of those paragraphs of a tree that the other doesn't have at the same place.

    Only sections whose hashes differ are entered.
    """
    def of_section(own: Column, i: Column) -> Column:
        theirs = F.try_element_at(other["paragraphs"], i + 1)
        mine = F.element_at(one["paragraphs"], i + 1)
        entered = F.flatten(F.transform(
            own, lambda p, j: F.when(F.try_element_at(theirs, j + 1).eqNullSafe(F.element_at(mine, j + 1)), _no_leaves()).otherwise(p)
        ))
        same = F.try_element_at(other["sections"], i + 1).eqNullSafe(F.element_at(one["sections"], i + 1))
        return F.when(same, _no_leaves()).otherwise(entered)

    return F.flatten(F.transform(one["leaves"], of_section))


def _no_leaves() -> Column:
    return F.array().cast("array<string>")


def _repeats(values: Column) -> Column:
    """Sorted elements without the first of each value."""
    def of_sorted(x: Column) -> Column:
        later = F.slice(x, 2, F.greatest(F.lit(0), F.size(x) - 1))
        return F.filter(later, lambda v, i: v == F.element_at(x, i + 1))

    return F.when(F.size(F.array_distinct(values)) == F.size(values), _no_leaves()).otherwise(
        _with(F.sort_array(values), of_sorted)
    )


def _in_common(one: Column, other: Column) -> Column:
    """How many elements two arrays share, each as often as both have it: their distinct
    values, and one walk through what repeats on either side."""
    begun = lambda r: F.struct(
        r["x"].alias("x"), r["y"].alias("y"), F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("n")
    )

    def step(held: Column, _: Column) -> Column:
        x, y = F.try_element_at(held["x"], held["i"]), F.try_element_at(held["y"], held["j"])
        on = lambda moved: F.coalesce(moved.cast("int"), F.lit(0))  # noqa: E731  # null behind the end of either
        return F.struct(
            held["x"].alias("x"), held["y"].alias("y"), (held["i"] + on(x <= y)).alias("i"),
            (held["j"] + on(y <= x)).alias("j"), (held["n"] + on(x == y)).alias("n"),
        )

    def walk(r: Column) -> Column:
        through = F.sequence(F.lit(1), F.size(r["x"]) + F.size(r["y"]))
        steps = F.aggregate(through, begun(r), step, lambda held: held["n"])
        return F.when((F.size(r["x"]) == 0) | (F.size(r["y"]) == 0), F.lit(0)).otherwise(steps)

    repeated = F.struct(_repeats(one).alias("x"), _repeats(other).alias("y"))
    return F.size(F.array_intersect(one, other)) + _with(repeated, walk)


def likeness(one: Column, other: Column) -> Column:
    """Twice the leaves that two trees share by the leaves of both, repeats included; two
    trees without leaves are alike.

    A branch that both have at the same place is shared whole and isn't entered, which
    changes nothing: equal leaves go from both sides.
    """
    def of_rest(rest: Column) -> Column:
        mine, theirs = rest["mine"], rest["theirs"]
        total = rest["n"] + rest["m"]
        shared = rest["n"] - F.size(mine) + _in_common(mine, theirs)
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared / total)

    rest = F.struct(
        differing(one, other).alias("mine"), differing(other, one).alias("theirs"),
        _n_leaves(one).alias("n"), _n_leaves(other).alias("m"),
    )
    return F.when(one["root"] == other["root"], F.lit(1.0)).otherwise(_with(rest, of_rest))


def edits(one: Column, other: Column) -> Column:
    """Where two trees differ: (section, paragraph) numbers in ``one`` whose hashes the
    branch of the same section in ``other`` lacks.  Only differing branches are entered."""
    def of_section(hashes: Column, i: Column) -> Column:
        theirs = F.coalesce(F.try_element_at(other["paragraphs"], i + 1), F.array().cast("array<string>"))
        missing = F.transform(
            hashes, lambda h, j: F.when(~F.array_contains(theirs, h), F.struct(i.alias("section"), j.alias("paragraph")))
        )
        same = F.try_element_at(other["sections"], i + 1).eqNullSafe(F.element_at(one["sections"], i + 1))
        return F.when(same, F.filter(missing, lambda x: F.lit(False))).otherwise(F.filter(missing, lambda x: x.isNotNull()))

    return F.flatten(F.transform(one["paragraphs"], of_section))


def fingerprint_trees(docs: DataFrame, text: str = "text", out: str = "merkle_tree") -> DataFrame:
    """Add the tree of every text; null counts as empty.  A column called ``out`` is replaced."""
    return docs.withColumn(out, tree(F.coalesce(F.col(text), F.lit(""))))


def with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by falling id, the first
    row's after the last.  Null texts become empty.  Null ids come last; rows with the
    same id go by a hash of their text.  One row follows itself; an empty table stays so.

    Ids are cut into ranges of about ``rows_per_bucket`` rows; the text is shuffled once
    by range.  Each range's first row, found with a map-side combine, follows the range
    before.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = range_splits(plain, "doc_id", rows_per_bucket, MAX_BUCKETS)
    rows = with_bucket(plain, "doc_id", cuts).withColumn("__place", F.struct("doc_id", F.xxhash64("text").alias("h")))
    # One row for each bucket, at most MAX_BUCKETS; their order is found without texts.
    heads = rows.groupBy(F.col("bucket").alias("__next")).agg(F.max_by("text", "__place").alias("__after"))
    numbers = with_bucket(plain.select("doc_id"), "doc_id", cuts).select("bucket").distinct()
    falling = Window.orderBy(F.desc("bucket"))
    following = F.coalesce(F.lead("bucket").over(falling), F.first("bucket").over(falling))
    after = numbers.select("bucket", following.alias("__next")).join(heads, "__next").drop("__next")
    inside = Window.partitionBy("bucket").orderBy(F.desc("__place"))
    led = rows.withColumn("__lead", F.lead("text").over(inside))
    # Rows are dealt by range already, so only the heads move to meet them.
    joined = led.join(after, "bucket")
    return joined.select("doc_id", "text", F.coalesce("__lead", "__after").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last third of the characters replaced by as many of the following text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))
