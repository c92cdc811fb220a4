"""Operators that relate rows, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import ctw, merkle, packing, simhash, warc
from gristmill.llm.components import connected_components


# --- context tree ---------------------------------------------------------------


def _log_pw(texts, k, prefix, context):
    """log weighted probability of one node, from all its children, by definition."""
    a = b = 0
    older = set()
    for t in texts:
        stream = b"\xff" * ctw.DEPTH + t + b"\xff"
        for i in range(ctw.DEPTH, len(stream)):
            if stream[i] >> (8 - k) == prefix and stream[i - len(context) : i][::-1] == context:
                if stream[i] >> (7 - k) & 1:
                    b += 1
                else:
                    a += 1
                older.add(stream[i - len(context) - 1])
    estimate = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    if len(context) == ctw.DEPTH or a + b == 0:
        return (0.0 if a + b == 0 else estimate), (a, b)
    children = sum(_log_pw(texts, k, prefix, context + bytes([c]))[0] for c in older)
    return float(np.logaddexp(math.log(0.5) + estimate, math.log(0.5) + children)), (a, b)


def test_context_tree_by_definition(spark):
    """The predictive probability of a bit is the ratio of weighted probabilities after and
    before it, which needs no posterior weights."""
    rows = [(0, "ab abba"), (2, "abab"), (3, None), (4, "ba b")]
    training = [(t or "").lower().encode() for i, t in rows if ctw.crc_remainder(i, 5) != 1]
    probe = b"abc"
    docs = spark.createDataFrame([*rows, (11, "x")], "doc_id long, text string")
    docs = docs.filter("doc_id <> 11")
    held = next(i for i in range(100, 400) if ctw.crc_remainder(i, 5) == 1)
    both = docs.unionByName(spark.createDataFrame([(held, "aBc")], "doc_id long, text string"))
    got = {r.doc_id: r for r in ctw.score_documents(both).collect()}[held]
    assert got.held_out
    stream = b"\xff" * ctw.DEPTH + probe + b"\xff"
    total = 0.0
    for i in range(ctw.DEPTH, len(stream)):
        for k in range(8):
            prefix, bit = stream[i] >> (8 - k), stream[i] >> (7 - k) & 1
            # Chain of nodes on the path; the new bit changes these alone.
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                context = stream[i - d : i][::-1] if d else b""
                lpw, (a, b) = _log_pw(training, k, prefix, context)
                if a + b == 0:
                    p = 0.5
                    continue
                kt = ((b if bit else a) + 0.5) / (a + b + 1)
                if d == ctw.DEPTH:
                    p = kt
                    continue
                estimate = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                w = math.exp(math.log(0.5) + estimate - lpw)
                p = w * kt + (1 - w) * p
            total += math.log10(p)
    assert got.score == pytest.approx(total, abs=1e-4)


def test_base_score_and_edges(spark, edge, empty):
    rows = ctw.score_documents(edge).collect()
    assert len(rows) == 9
    texts = [(r.doc_id, (r.text or "").lower()) for r in edge.select("doc_id", "text").collect()]
    train = [t for i, t in texts if ctw.crc_remainder(i, 5) != 1]
    counts = {}
    for t in train:
        for w in t.encode().split():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in texts:
        c = [counts.get(w, 0) for w in t.encode().split()] + [len(train)]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        r = next(r for r in rows if r.doc_id == i)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert ctw.score_documents(empty).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if ctw.crc_remainder(i, 5) == 1), "ab")], "doc_id long, text string")
    untaught = ctw.score_documents(only).first()
    assert untaught.score == pytest.approx(24 * math.log10(0.5), rel=1e-6) and untaught.train_tokens == 0


def test_probabilities_of_a_context_sum_to_one():
    keys, counts = ctw._distinct(ctw.context_keys([b"hello world", b"help", b""])[0])
    tree = ctw.SliceTree(keys, counts)
    top = ctw._top(
        __import__("pyarrow").table(
            {n: np.concatenate([t[i] for t in tree.top]) for i, n in enumerate(("node", "a", "b", "w"))}
        ).set_column(0, "node", [np.concatenate([t[0] for t in tree.top]).astype(np.int64)])
    )
    context = np.uint64(int.from_bytes(b"leh\xff\xff", "big") << 8)
    every = np.sort(context | np.arange(256, dtype=np.uint64))
    assert (10 ** tree.log10(every, top)).sum() == pytest.approx(1.0)


# --- Merkle trees ---------------------------------------------------------------


def test_merkle_neighbours_in_many_ranges(spark):
    ids = random.Random(3).sample(range(10_000), 300)
    docs = spark.createDataFrame([(i, f"t{i}\nx") for i in ids], "doc_id long, text string")
    rows = {r.doc_id: r.next_text for r in merkle.with_next(docs, rows_per_bucket=7).collect()}
    falling = sorted(ids, reverse=True)
    assert rows == {i: f"t{j}\nx" for i, j in zip(falling, [*falling[1:], falling[0]])}


def test_merkle_edits_and_edges(spark, edge, empty):
    rows = merkle.with_next(edge).collect()
    assert len(rows) == 9 and merkle.with_next(empty).count() == 0
    one = spark.createDataFrame([("a b\n\nc\nd\n\ne", "a b\n\nc\nD\n\ne"), ("", ""), ("x", "x\n\ny")], "a string, b string")
    trees = one.select("a", "b", merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    got = {r.a: ([tuple(e) for e in r.e], r.s) for r in trees.select("a", merkle.edits(F.col("x"), F.col("y")).alias("e"), (F.col("x.root") == F.col("y.root")).alias("s")).collect()}
    assert got == {"a b\n\nc\nd\n\ne": ([(1, 1)], False), "": ([], True), "x": ([], False)}
    near = {r[0]: r[1] for r in trees.select("a", merkle.likeness(F.col("x"), F.col("y"))).collect()}
    assert near == {"a b\n\nc\nd\n\ne": 0.75, "": 1.0, "x": 2 / 3}
    assert "merkle_tree" in merkle.fingerprint_trees(edge).columns


def _slow_tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    runs = [[re.findall(merkle.LEAF_PATTERN, p) for p in s.split("\n")] for s in text.split("\n\n")]
    sections = [sha("".join(sha("".join(hashlib.md5(x.encode()).hexdigest() for x in p)) for p in s)) for s in runs]
    return sha("".join(sections)), Counter(x for s in runs for p in s for x in p)


def test_merkle_likeness_counts_repeats(spark):
    """Against the leaves of whole trees as multisets, which entering only differing branches must equal."""
    rng = random.Random(7)

    def text():
        words = lambda: " ".join(rng.choice(["a", "bb", "c"]) for _ in range(rng.randint(0, 9)))
        return rng.choice(["", " ", "\t"]) + rng.choice(["\n", "\n\n", "\n\n\n"]).join(words() for _ in range(rng.randint(0, 6)))

    pairs = [(text(), text()) for _ in range(150)] + [("same line\n" * 1000, "same line\n"), ("", "a"), ("", "")]
    pairs += [(a, a[: len(a) // 2] + b) for a, b in pairs[:60]] + [("x " * 40_000, "x " * 30_000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    trees = rows.select("i", merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    got = trees.select("i", "x.root", merkle.likeness(F.col("x"), F.col("y")).alias("near")).collect()
    assert len(got) == len(pairs)
    for r in got:
        (root, one), (_, other) = (_slow_tree(t) for t in pairs[r.i])
        total = one.total() + other.total()
        assert r.root == root and r.near == pytest.approx(2 * (one & other).total() / total if total else 1.0)


# --- SimHash --------------------------------------------------------------------


def _slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_groups(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_equal_all_pairs(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.link_fingerprints(table, bucket_rows=bucket_rows)
    for r in links.collect():
        assert bin((r.u ^ r.v) & simhash.FULL).count("1") >= 1
    roots = {r.node: r.root for r in connected_components(links).collect()}
    slow = _slow_groups(prints)
    groups = lambda labels: {frozenset(x for x, y in zip(signed, labels) if y == k) for k in labels}
    assert groups([roots.get(x, x) for x in signed]) == groups(slow)


def test_near_duplicates(spark, edge, empty):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:-1], "z"]), "a b c", "A  b\tc", "other text of some words", None, "", " "]
    docs = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [_slow_simhash(t) for t in texts]
    assert [rows[10 - i].simhash & simhash.FULL for i in range(len(texts))] == prints
    slow = _slow_groups(prints)
    for i in range(len(texts)):
        assert rows[10 - i].component_id == min(10 - j for j in range(len(texts)) if slow[j] == slow[i])
    assert simhash.near_duplicates(edge).count() == 9 and simhash.near_duplicates(empty).count() == 0


def test_hot_nodes_are_divided(spark):
    """A star and texts that most rows share: the same groups, in any number of parts."""
    star = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5301)}
    docs = spark.createDataFrame([(i, "same words in all of them" if i % 3 else f"text {i} of its own {i * i}") for i in range(2000)], "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(None, "same words in all of them")] * 300, docs.schema))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 2300
    assert {r.component_id for r in rows if r.doc_id is None or r.doc_id % 3} == {1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, 299), (5, 5), (300, 298)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 299: 298, 300: 298}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- packing --------------------------------------------------------------------


def test_pieces_equal_the_tokenizer(spark, edge):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a ΑΣ b", "a\x1cb", "İstanbul don't ½", "é x", "naïve\xa0x 'S", "ﬁ ​ z", None, ""]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(edge.select("doc_id", "text").filter("doc_id > 0"))
    texts = docs.collect()
    got = packing.token_pieces(docs, path, capacity=50, keep_ids=True).collect()
    joined = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        joined.setdefault(r.doc_id, []).append(r)
    for i, t in ((0, odd[0]),):  # the other ids are the edge table's too
        assert [x for r in joined[i] for x in r.ids] == [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    encoder = packing.CachedEncoder(plain.to_str())
    every = [t.text or "" for t in texts]
    for t, raw in zip(every, encoder.encode(every)):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("partition_pieces", [1 << 16, 20])
def test_packing_is_whole_and_gapless(spark, edge, empty, partition_pieces):
    rng = random.Random(partition_pieces)
    rows = [(i, 0, 0, rng.randint(1, 64), i * 7) for i in range(300)] + [(None, 0, 0, 64, 1), (5, 0, 0, 3, 9), (5, 0, 0, 3, 9)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    placed = packing.pack(pieces, capacity=64, partition_pieces=partition_pieces).collect()
    assert sorted((r[:5] for r in placed), key=repr) == sorted(rows, key=repr)
    bins = {}
    for r in sorted(placed, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64
    least = packing.lower_bound(np.array([r[3] for r in rows]), 64)
    assert least <= len(bins) <= least + (1 if partition_pieces > 300 else 16)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0
    whole = packing.pack(packing.token_pieces(edge, path)).collect()
    assert len({r.doc_id for r in whole}) == 8 and sum(r.doc_id == 6 for r in whole) == 2


def test_bound_never_exceeds_the_best_packing():
    rng = random.Random(1)
    for _ in range(300):
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 8))), reverse=True)

        def fewest(i, rooms):
            if i == len(sizes):
                return len(rooms)
            best = fewest(i + 1, [*rooms, 12 - sizes[i]])
            for j in {rooms.index(r) for r in rooms if r >= sizes[i]}:
                best = min(best, fewest(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]]))
            return best

        exact = fewest(0, [])
        assert packing.lower_bound(np.array(sizes), 12) <= exact <= len(packing.best_fit(sizes, 12)[2])


# --- WARC -----------------------------------------------------------------------


class _Reader(HTMLParser):
    """Links, and text without references, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.links, self.text = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = [v for k, v in attrs if k == "href"]
        if tag == "a" and named:
            self.links.append((named[0] or "").strip())

    def handle_data(self, data):
        self.text.append(data)


def test_warc_references_and_links_equal_a_parser(spark):
    rng = random.Random(6)
    names = ["amp", "copy", "middot", "eacute", "mdash", "nbsp", "hellip", "lt", "quot", "NotEqualTilde"]
    refs = [f"&{n};" for n in names] + ["&#8217;", "&#x2019;", "&#233;", "&#x1F600;", "&copy", "&eacute", "&amp;copy;", "& ", "&unknown;"]
    pages = []
    for i in range(60):
        words = [rng.choice(["plain", "été", *refs]) for _ in range(20)]
        value = "/p?q=" + "&".join(rng.choice(["a=1", "c=2", "amp;b=3", "#38;c", "x&eacute;y", "lt"]) for _ in range(4))
        quote = rng.choice(['"', "'", ""])
        gap = rng.choice(["", " "])
        extra = rng.choice(["", ' class="x"', " rel=nofollow data-href='/no'", "\n id=k"])
        tag = f"<{rng.choice('aA')}{extra} {rng.choice(['href', 'HREF'])}{gap}={gap}{quote}{value}{quote}>"
        pages.append((i, f"<p>{' '.join(words)} {tag}more</a> <a name=top>x</a><abbr href='/no'>y</abbr></p>"))
    table = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    got = warc.derive(warc.responses_of(table)).collect()
    blocks = {(r.page_id, r.warc_type): r.block for r in got}
    for i, page in pages:
        read = _Reader(page)
        links = [x[9:] for x in blocks[i, "metadata"].split("\r\n") if x.startswith("outlink: ")]
        assert links == read.links, page
        assert blocks[i, "conversion"].split() == "".join(read.text).split(), page


def test_warc_names_without_a_semicolon_in_targets():
    """The standard's rule for attributes, which the library's parser does not follow."""
    assert warc.target('"?a=1&copy=2&copyx=3&copy"') == "?a=1&copy=2&copyx=3\u00a9"
    assert warc.target("' /x&amp;y&#47;&unknown; '") == "/x&y/&unknown;"
    assert warc.target("bare") == "bare" and warc.target('""') == ""


def test_warc_given_pages_keep_no_reference(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = warc.derive(warc.responses_of(pages)).filter("warc_type = 'conversion'")
    raw = pages.filter(F.col("html").rlike("&(copy|middot);")).count()
    assert raw > 200 and got.filter(F.col("block").rlike("&(copy|middot|quot|nbsp|lt|gt);")).count() == 0


def test_warc_records(spark):
    html = '<html><head><title> A &amp; B </title></head><body><p>x&lt;y<script>no</script><br>z <a class="q" href="/u">l</a></p><!-- c --></body>'
    rows = [(1, "http://a/", html), (2, None, None), (2, None, None), (3, "http://b/", ""), (4, "u", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("x")).withColumn("title", F.lit("x"))
    responses = warc.responses_of(pages)
    got = warc.serialized(warc.derive(responses)).collect()
    assert len(got) == 10
    source = {r.page_id: r.record_id for r in responses.collect()}
    for r in got:
        assert r.refers_to == source[r.page_id] != r.record_id and f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers
        assert f"WARC-Block-Digest: sha256:{hashlib.sha256(r.block.encode()).hexdigest()}\r\n" in r.headers
        assert r.headers.endswith(f"Content-Length: {len(r.block.encode())}")
        assert r.record == f"{r.headers}\r\n\r\n{r.block}\r\n\r\n"
    first = {r.warc_type: r.block for r in got if r.page_id == 1}
    assert first["conversion"] == "x<y\nz l"
    assert first["metadata"].split("\r\n")[:3] == ["title: A & B", "outlink: /u", "source-header: HTTP/1.1 200 OK"]
    assert {r.block for r in got if r.page_id in (2, 3) and r.warc_type == "conversion"} == {""}
    assert warc.derive(warc.responses_of(pages.limit(0))).count() == 0
