"""SQL that the text queries must equal, where SQL can express them."""

from __future__ import annotations

# Nothing is taken from the operators: what SQL needs is written out once more.
WINDOW = 10
LEAF_SQL = r"(?:[ \t\v\f\r]*[^ \t\n\v\f\r]{1,64}){1,4}|[ \t\n\v\f\r]+"
UNSEEN = "(?is)" + "|".join(
    ["<!--.*?-->"] + [f"<{t}[ \\t\\r\\n>].*?</{t}>" for t in ("head", "script", "style", "noscript", "template")]
)
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3"
    r"|h4|h5|h6|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)(?:[ \t\r\n/][^<>]*)?>"
)
OTHER_TAG = r"<[A-Za-z/!?][^<>]*>"
CRLF = "\r\n"
# SQL has no table of references; these are the ones that the pages have, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _text(value: str) -> str:
    """A string literal; control characters by number."""
    escaped = value.replace("'", "''")
    for c in "\r\n\t":
        escaped = escaped.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{escaped}')"


def _root(text: str) -> str:
    runs = f"regexp_extract_all(par, {_text(LEAF_SQL)})"
    leaves = f"list_transform({runs}, lambda run: md5(run))"
    paragraphs = f"list_transform(string_split(sec, chr(10)), lambda par: sha256(array_to_string({leaves}, '')))"
    sections = (
        f"list_transform(string_split({text}, chr(10) || chr(10)), lambda sec: sha256(array_to_string({paragraphs}, '')))"
    )
    return f"sha256(array_to_string({sections}, ''))"


def _leaves(text: str) -> str:
    """All runs of words of all lines, in order."""
    return f"flatten(list_transform(string_split({text}, chr(10)), lambda par: regexp_extract_all(par, {_text(LEAF_SQL)})))"


def _numbered(runs: str) -> str:
    """Elements of a sorted list with how many equal ones stand before each."""
    return f"list_transform({runs}, lambda x, i: x || chr(10) || (i - list_position({runs}, x)))"


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(
    lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM d
),
e AS (
  SELECT *, length(text) AS n, length(text) // 3 AS third FROM n
),
f AS (
  SELECT *, substr(text, 1, n - third) || substr(next_text, 1, third) AS edited FROM e
),
g AS (
  SELECT *, list_sort({_leaves("text")}) AS own, list_sort({_leaves("edited")}) AS changed,
    list_sort({_leaves("next_text")}) AS following
  FROM f
),
h AS (
  SELECT *, len(list_intersect({_numbered("own")}, {_numbered("changed")})) AS with_changed,
    len(list_intersect({_numbered("own")}, {_numbered("following")})) AS with_following
  FROM g
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  {_root("text")} AS fingerprint, {_root("edited")} AS edited_fingerprint,
  CASE WHEN len(own) + len(changed) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * with_changed / (len(own) + len(changed)) END AS near_edited,
  CASE WHEN len(own) + len(following) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * with_following / (len(own) + len(following)) END AS near_next
FROM h
"""


def _resolved(text: str) -> str:
    for name, shown in REFERENCES:
        text = f"replace({text}, {_text(name)}, {_text(shown)})"
    return text


def _uuid(seed: str) -> str:
    h = f"md5({seed})"
    parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


def _replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_text(pattern)}, {_text(by)}, 'g')"


_BARE = _resolved(_replaced(_replaced(_replaced("payload", UNSEEN, ""), BLOCK_TAG, "\n"), OTHER_TAG, ""))
_LINES = _replaced(_replaced(_BARE, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
_TITLE = _replaced(_resolved(r"regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1)"), r"[ \t\r\n\f]+", " ")
_EOL = _text(CRLF)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload FROM pages),
s AS (
  SELECT *, {_uuid("'response' || chr(10) || page_id::VARCHAR || chr(10) || uri || chr(10) || sha256(payload)")} AS source_id,
    'sha256:' || sha256(payload) AS source_digest,
    strlen(payload)::VARCHAR AS source_length,
    trim({_TITLE}, ' ') AS title,
    list_transform(
      regexp_extract_all(payload, '(?i)<a[ \\t\\r\\n][^<>]*?href="([^"]*)"', 1), lambda x: {_resolved("x")}) AS links,
    trim({_LINES}, ' ' || chr(10)) AS body
  FROM p
),
r AS (
  SELECT page_id, uri, source_id, source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS media,
    array_to_string(list_concat(
      ['title: ' || title], list_transform(links, lambda x: 'outlink: ' || x),
      ['source-header: HTTP/1.1 200 OK', 'source-header: Content-Type: text/html; charset=UTF-8',
       'source-header: Content-Length: ' || source_length, 'source-payload-digest: ' || source_digest]), {_EOL}) || {_EOL} AS block
  FROM s
  UNION ALL
  SELECT page_id, uri, source_id, source_digest, 'conversion', 'text/plain; charset=UTF-8', body FROM s
),
i AS (SELECT *, {_uuid("warc_type || chr(10) || source_id")} AS record_id FROM r)
SELECT page_id, warc_type, record_id, source_id AS refers_to,
  array_to_string(['WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || source_id,
    'WARC-Refers-To-Target-URI: ' || uri, 'WARC-Target-URI: ' || uri, 'WARC-Date: 2024-01-01T00:00:00Z',
    'WARC-Block-Digest: sha256:' || sha256(block), 'WARC-Source-Payload-Digest: ' || source_digest,
    'Content-Type: ' || media, 'Content-Length: ' || strlen(block)::VARCHAR], {_EOL}) AS headers,
  block
FROM i
"""

_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

FM = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS win, least(len(ws), {WINDOW}) AS n
  FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - {WINDOW - 1}))) AS i FROM b WHERE len(ws) > 0)
),
lens AS (SELECT DISTINCT n FROM w),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
g AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)
),
h AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w ON g.win = w.win AND g.n = w.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)

RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM l)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), total
),
s AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v ON q.vec_id <> v.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle": MERKLE, "op5_warc_derivatives": WARC, "op6_fm_decontaminate": FM, "op11_interval_search": RANKED, "op13_segment_search": NEAREST}
