"""WARC derivatives (operator 5): metadata and conversion records of responses.

Every response gives two records that refer to it: a metadata record with what its page
and its headers say, and a conversion record with its plain text.  Identifiers derive
from the response's, so a retried task writes the same records.  Built-in expressions,
but for character references, whose table the standard library has; nothing is shuffled.
"""

from __future__ import annotations

import html as markup
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The HTML elements that end a line of text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
    "header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"
)
UNSEEN = (
    r"(?is)<!--.*?-->|<head[ \t\r\n>].*?</head>|<script[ \t\r\n>].*?</script>|<style[ \t\r\n>].*?</style>"
    r"|<noscript[ \t\r\n>].*?</noscript>|<template[ \t\r\n>].*?</template>"
)
BLOCK_TAG = rf"(?i)</?(?:{BLOCK_TAGS})(?:[ \t\r\n/][^<>]*)?>"
OTHER_TAG = r"<[A-Za-z/!?][^<>]*>"
# A link's target as it stands in its tag, with the quotes.
LINK = (
    r"(?i)<a[ \t\r\n\f/](?:[^<>]*?[ \t\r\n\f\"'/])?href[ \t\r\n\f]*=[ \t\r\n\f]*"
    r"(\"[^\"]*\"|'[^']*'|[^ \t\r\n\f>\"'][^ \t\r\n\f>]*)"
)
CRLF = "\r\n"
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


def target(value: str) -> str:
    """A link's target without quotes and white space around, references resolved.

    In an attribute a name without its semicolon is no reference if a letter, a digit or
    an equals sign follows: ``?a=1&copy=2`` stays.
    """
    if value[:1] in ("'", '"'):
        value = value[1:-1]

    def shown(found: re.Match) -> str:
        name = found.group()[1:]
        if name[0] == "#":
            return markup.unescape(found.group())
        follows = value[found.end() : found.end() + 1]
        known = name.endswith(";") or follows != "="
        return html5.get(name, found.group()) if known else found.group()

    return _REFERENCE.sub(shown, value).strip(" \t\r\n\f")


def _resolved(title: Column, body: Column, links: Column) -> Column:
    """The three with their character references resolved, named and numeric ones."""

    @F.arrow_udf("struct<title:string,body:string,links:array<string>>")
    def resolve(titles: pa.Array, bodies: pa.Array, targets: pa.Array) -> pa.Array:
        def plain(texts: pa.Array) -> pa.Array:
            return pa.array([x if x is None or "&" not in x else markup.unescape(x) for x in texts.to_pylist()], pa.string())

        found = [None if x is None else [target(t) for t in x] for x in targets.to_pylist()]
        arrays = [plain(titles), plain(bodies), pa.array(found, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(arrays, ["title", "body", "links"])

    # Marked so that the three fields do not run it three times.
    return resolve.asNondeterministic()(title, body, links)


def raw_text(html: Column) -> Column:
    """What a reader sees: no head, scripts, styles or comments; a line for each block.
    Character references stand as written."""
    seen = F.regexp_replace(html, UNSEEN, "")
    lines = F.regexp_replace(seen, BLOCK_TAG, "\n")
    return F.regexp_replace(lines, OTHER_TAG, "")


def _lines(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[ \t\r\f\u00a0]+", " ")
    return F.btrim(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n\f\u00a0]+", " "), F.lit(" "))


def record_id(seed: Column) -> Column:
    h = F.md5(seed)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_of(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Response records of a page table: (page_id, record_id, target_uri, warc_date,
    http_headers, payload).  Null pages are empty, null addresses empty strings; rows
    that repeat an id and a page repeat the record."""
    plain = pages.select(
        F.col(page_id).alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("target_uri"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    )
    seed = F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), "target_uri", F.sha2("payload", 256))
    length = F.octet_length("payload").cast("string")
    headers = F.array(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit("Content-Length: "), length),
    )
    return plain.select(
        "page_id", record_id(seed).alias("record_id"), "target_uri", F.lit(date).alias("warc_date"),
        headers.alias("http_headers"), "payload",
    )


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response, without its payload:
    (key, warc_type, record_id, refers_to, headers, block).

    The metadata block lists title, outlinks, each source header and the source's
    payload digest; the conversion block is the plain text.  Both records carry
    WARC-Refers-To, the response's address and date, and digests of their own block and
    of the source.  All HTML character references are resolved; outlinks are the href
    values of a elements in page order, repeats included, quoted or bare, found by
    pattern, so a tag ends at its first < or >.  An empty payload gives an empty text; null columns count as empty;
    other input columns are not looked at.  An empty table gives an empty one.
    """
    html = F.coalesce(F.col("payload"), F.lit(""))
    none = F.array().cast("array<string>")
    prepared = responses.select(
        F.col(key).alias(key),
        F.coalesce("record_id", F.lit("")).alias("source_id"),
        F.coalesce("target_uri", F.lit("")).alias("uri"),
        F.coalesce("warc_date", F.lit("")).alias("date"),
        F.coalesce("http_headers", none).alias("source_headers"),
        digest(html).alias("source_digest"),
        _resolved(
            F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), raw_text(html),
            F.regexp_extract_all(html, F.lit(LINK), F.lit(1)),
        ).alias("page"),
    )
    prepared = prepared.select(
        key, "source_id", "uri", "date", "source_headers", "source_digest", F.col("page.links").alias("links"),
        _one_line(F.col("page.title")).alias("title"), _lines(F.col("page.body")).alias("body"),
    )
    fields = F.concat(
        F.array(F.concat(F.lit("title: "), "title")),
        F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)),
        F.transform("source_headers", lambda x: F.concat(F.lit("source-header: "), x)),
        F.array(F.concat(F.lit("source-payload-digest: "), "source_digest")),
    )
    metadata = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))

    def record(kind: str, media: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), F.lit(media).alias("media"),
            record_id(F.concat_ws("\n", F.lit(kind), "source_id")).alias("record_id"), block.alias("block"),
        )

    both = F.array(
        record("metadata", "application/warc-fields", metadata),
        record("conversion", "text/plain; charset=UTF-8", F.col("body")),
    )
    rows = prepared.select(key, "source_id", "uri", "date", "source_digest", F.inline(both))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    headers = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("source_id")),
        line("WARC-Refers-To-Target-URI", F.col("uri")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", digest(F.col("block"))),
        line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("Content-Type", F.col("media")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.select(
        key, "warc_type", "record_id", F.col("source_id").alias("refers_to"), headers.alias("headers"), "block"
    )


def serialized(records: DataFrame, out: str = "record") -> DataFrame:
    """Add the record as it stands in a WARC file."""
    return records.withColumn(out, F.concat("headers", F.lit(CRLF + CRLF), "block", F.lit(CRLF + CRLF)))
