"""Personal data by a skip-chain conditional random field (operator 4).

Patterns give the base spans.  Tokens with a digit, an @ or a + are the field's
variables; all others are outside any entity.  Neighbouring variables share a chain
potential, repeated or similar ones, however distant, a skip potential.  Tokens under
base spans are observed; loopy message passing carries their labels along the links
until the messages settle, for ROUNDS rounds at most,
and tokens that come out with an entity label add spans.  A text with nothing observed
takes the same inference.

Potentials are learned from the corpus in one pass of counts: labels by token shape,
labels of neighbours, agreement of similar tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import add_columns, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is outside
DAMPING = 0.5
# A text's messages have settled when none moves by more than this.  Where they still
# move after so many rounds, as they may on loops, the last ones count.
SETTLED = 1e-6
ROUNDS = 1000
THRESHOLD = 0.5
SMOOTHING = 0.5
# Similar values have a key in common: this many digits at least, an IP address without
# its port, or a name before @.  Phones have the last digits too: without the country,
# without the area.
KEY_DIGITS = 6
PHONE_DIGITS = 15
PHONE_TAILS = (10, 7)
# No entity in several tokens has more digits.
RUN_DIGITS = 19

# The base patterns.  Atomic groups and look-behinds only save time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@+]")
# A word is entered at its first character only, and never walked back.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+")
_DIGITS = re.compile(r"[0-9]+")
# What stands around a token without belonging to it.
_AROUND = ".,;:!?\"'<>[]{}"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            after = domain.end()
            yield begin, after
        else:
            after = max(after, at + 1)
        at = text.find("@", max(after, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    if not _HINT.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 4 and (not p or int(p) <= 255) for p in parts):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def _name(body: str) -> str:
    """What stands before the first @ that has a name before it."""
    at = body.find("@")
    while at >= 0:
        begin = at
        while begin and body[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            return body[begin:at]
        at = body.find("@", at + 1)
    return ""


def value_keys(body: str, kind: int | None = None) -> list[str]:
    """Keys of one value, the longest first; ``kind`` if a base pattern says what it is."""
    name = _name(body) if kind in (None, 0) else ""
    if name:
        return ["@" + name.lower()]
    groups = _DIGITS.findall(body)
    digits = "".join(groups)
    keys = [digits] if len(digits) >= KEY_DIGITS else []
    if kind == 3 or kind is None and len(digits) <= PHONE_DIGITS:
        keys += [digits[-n:] for n in PHONE_TAILS if n < len(digits)]
    if kind == 1 or kind is None and len(groups) >= 4:
        parts = [g.lstrip("0") or "0" for g in groups[:4]]
        if all(len(g) < 4 and int(g) <= 255 for g in parts):
            keys.append(".".join(parts))
    return keys


class Variables:
    """Field variables of one text: places, shapes, values with keys, observed labels."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        self.places: list[tuple[int, int]] = []
        self.shapes: list[int] = []
        self.ordinals: list[int] = []
        last = 0
        for m in _TOKEN.finditer(text):
            begin, end = m.span()
            while begin < end and text[begin] in _AROUND:
                begin += 1
            while end > begin and text[end - 1] in _AROUND:
                end -= 1
            if begin == end:
                continue
            body = text[begin:end]
            # Neighbours in the chain stand next to each other, one space apart.
            close = bool(self.places) and begin - last <= 1
            self.ordinals.append(self.ordinals[-1] + 1 if close else (self.ordinals[-1] + 2 if self.places else 0))
            last = end
            self.places.append((begin, end))
            self.shapes.append(shape(body))
        self.labels = np.zeros(len(self.places), np.int64)
        # Values: (first variable, the one after the last, keys).
        self.values: list[tuple[int, int, list[str]]] = []
        spans = sorted((a, b, k) for k, a, b in base)
        i = 0
        for j, (begin, end) in enumerate(self.places):
            while i < len(spans) and spans[i][1] <= begin:
                i += 1
            if i < len(spans) and spans[i][0] < end:
                self.labels[j] = spans[i][2] + 1
        j = 0
        for begin, end, k in spans:
            while j < len(self.places) and self.places[j][1] <= begin:
                j += 1
            after = j
            while after < len(self.places) and self.places[after][0] < end:
                after += 1
            if j < after:
                self.values.append((j, after, value_keys(text[begin:end], k)))
        self._candidates(text)

    def _candidates(self, text: str) -> None:
        """Values of tokens outside base spans, and of runs of neighbours among them.

        Runs begin and end with digits: a longer one with the same digits would lose to
        the shorter one wherever both have a key.
        """
        bodies = [text[a:b] for a, b in self.places]
        digits = ["".join(_DIGITS.findall(x)) for x in bodies]
        free = self.labels == 0
        joins = [bool(f) and not any(c.isalpha() or c == "@" for c in x) for f, x in zip(free, bodies)]
        # The next token with digits that a run can go on to, or -1.
        ahead, upcoming = [-1] * len(bodies), -1
        for i in range(len(bodies) - 1, -1, -1):
            if i + 1 < len(bodies) and joins[i] and joins[i + 1] and self.ordinals[i + 1] == self.ordinals[i] + 1:
                upcoming = i + 1 if digits[i + 1] else upcoming
            else:
                upcoming = -1
            ahead[i] = upcoming
        for i, body in enumerate(bodies):
            if not free[i]:
                continue
            self.values.append((i, i + 1, value_keys(body)))
            run, j = digits[i], ahead[i]
            while run and j >= 0:
                run += digits[j]
                if len(run) > RUN_DIGITS:
                    break
                keys = [run] if len(run) >= KEY_DIGITS else []
                if len(run) <= PHONE_DIGITS:
                    # A cut between tokens is a shorter run of its own.
                    keys += [run[-n:] for n in PHONE_TAILS if len(run) - len(digits[i]) < n < len(run)]
                if keys:
                    self.values.append((i, j + 1, keys))
                j = ahead[j]

    def chain(self) -> list[int]:
        """Variables whose right neighbour is the next variable."""
        o = self.ordinals
        return [i for i in range(len(o) - 1) if o[i + 1] == o[i] + 1]

    def skips(self) -> list[tuple[int, int]]:
        """Links of values that share a key: each with the one before, and with the first
        that is observed.

        Of values at one place that share a key the observed one counts, else the shortest.
        A variable outside base spans has one link to a place: by the longest key.
        """
        by_key: dict[str, list[tuple[int, int]]] = {}
        for first, after, keys in self.values:
            for key in keys:
                by_key.setdefault(key, []).append((first, after))
        site, sites = 0, []
        for i, o in enumerate(self.ordinals):
            site = i if not i or o != self.ordinals[i - 1] + 1 else site
            sites.append(site)
        linked: set[tuple[int, int, int]] = set()
        out: dict[tuple[int, int], None] = {}

        def observed(value: tuple[int, int]) -> bool:
            return self.labels[value[0]] > 0

        def join(a: tuple[int, int], b: tuple[int, int]) -> None:
            for one, other in ((a, b), (b, a)):
                n, m = one[1] - one[0], other[1] - other[0]
                for i in range(n):
                    u, v = one[0] + i, other[0] + i * m // n
                    # The other side links what this side knows to variables that don't.
                    if self.labels[u] and not self.labels[v]:
                        continue
                    # One link a place and direction, apart from values in one stretch.
                    seen = (u, sites[v], v if sites[u] == sites[v] else -1)
                    if seen not in linked:
                        linked.add(seen)
                        out[min(u, v), max(u, v)] = None

        for key in sorted((k for k, v in by_key.items() if len(v) > 1), key=lambda k: (-len(k), k)):
            apart: list[tuple[int, int]] = []
            for value in sorted(set(by_key[key])):
                if not apart or value[0] >= apart[-1][1]:
                    apart.append(value)
                elif not observed(apart[-1]) and (observed(value) or value[1] - value[0] < apart[-1][1] - apart[-1][0]):
                    apart[-1] = value
            known = next((v for v in apart if observed(v)), None)
            for before, value in zip(apart, apart[1:]):
                join(before, value)
            for value in apart if known else ():
                if not observed(value):
                    join(known, value)
        return list(out)


def shape(body: str) -> int:
    """One of 8 * 5 * 4 * 2 * 2 * 2 classes: digits, dots, hyphens, +, @, letters."""
    digits = sum(map(len, _DIGITS.findall(body)))
    size = sum(digits >= x for x in (1, 3, 4, 6, 9, 13, 20))
    letters = any(c.isalpha() for c in body)
    out = size
    for value, most in ((body.count("."), 5), (body.count("-"), 4), ("+" in body, 2), ("@" in body, 2), (letters, 2)):
        out = out * most + min(int(value), most - 1)
    return out


SHAPES = 8 * 5 * 4 * 2 * 2 * 2


def learn(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts (what, a, b, n): ``shape`` by label, ``chain`` by both labels, ``skip`` by
    both labels.  At most SHAPES x LABELS + 2 LABELS^2 rows from a task and in all."""
    rows = docs.select(F.col(text).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for body in part.column("text").to_pylist():
                    if not _HINT.search(body):
                        continue
                    v = Variables(body, base_spans(body))
                    labels = v.labels.tolist()
                    counts.update(("shape", s, x) for s, x in zip(v.shapes, labels))
                    counts.update(("chain", labels[i], labels[i + 1]) for i in v.chain())
                    counts.update(("skip", labels[i], labels[j]) for i, j in v.skips())
        what, a, b = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(what, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts.values(), pa.int64())],
            names=["what", "a", "b", "n"],
        )

    parts = rows.mapInArrow(run, "what string, a long, b long, n long")
    return parts.groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def potentials(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log potentials: shape x label, label x label of neighbours, label x label of similar tokens."""
    shapes = np.full((SHAPES, LABELS), SMOOTHING)
    chain = np.full((LABELS, LABELS), SMOOTHING)
    skip = np.full((LABELS, LABELS), SMOOTHING)
    for r in counts.collect():  # bounded, see learn()
        {"shape": shapes, "chain": chain, "skip": skip}[r.what][r.a, r.b] += r.n
    unary = np.log(shapes / shapes.sum(axis=1, keepdims=True))

    def association(n: np.ndarray) -> np.ndarray:
        """Pointwise mutual information of the two labels."""
        p = n / n.sum()
        return np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0)))

    # Tokens outside base spans may be missed entities, so agreement between similar
    # tokens is learned from pairs of entity labels only; pairs with the outside are
    # as likely as chance.
    seen = skip[1:, 1:]
    agree = np.log(np.trace(seen) / (seen.sum() - np.trace(seen)))
    similar = np.zeros((LABELS, LABELS))
    np.fill_diagonal(similar, max(agree, 0.0))
    return unary, association(chain), similar


def propagate(
    unary: np.ndarray, links: np.ndarray, kinds: np.ndarray, pairwise: tuple[np.ndarray, np.ndarray],
    owners: np.ndarray | None = None,
) -> np.ndarray:
    """Marginals by damped loopy sum-product over all links at once, until they settle.

    ``owners``: the text of each link, in order.  A text whose messages have settled
    takes no further rounds, so its marginals don't depend on the texts beside it.
    """
    n, m = len(unary), len(links)
    belief = unary.copy()
    if m:
        owner = np.zeros(m, np.int64) if owners is None else owners
        owner = np.unique(owner, return_inverse=True)[1]
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        tables = np.stack(pairwise)[kinds]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        owner = np.concatenate([owner, owner])
        message = np.zeros((2 * m, LABELS))
        active = np.arange(2 * m)
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target[active], message[active])
            from_source = belief[source[active]] - message[back[active]]
            fresh = np.logaddexp.reduce(from_source[:, :, None] + tables[active], axis=1)
            fresh -= np.logaddexp.reduce(fresh, axis=1)[:, None]
            fresh = DAMPING * message[active] + (1 - DAMPING) * fresh
            moved = np.zeros(owner.max() + 1)
            np.maximum.at(moved, owner[active], np.abs(fresh - message[active]).max(axis=1))
            message[active] = fresh
            active = active[moved[owner[active]] > SETTLED]
            if not len(active):
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
    belief -= np.logaddexp.reduce(belief, axis=1)[:, None] if n else 0
    return np.exp(belief)


CLAMP = 50.0


def _found(bodies: list[str], model: tuple) -> tuple[list[list], list[list]]:
    """Base and all spans of texts, one message-passing run for all of them."""
    unary, chain, skip = model
    bases = [base_spans(x) for x in bodies]
    fields = [Variables(x, b) if _HINT.search(x) else None for x, b in zip(bodies, bases)]
    scores, links, kinds, owners, starts, n = [], [], [], [], [], 0
    for d, v in enumerate(fields):
        starts.append(n)
        if v is None or not v.places:
            continue
        own = unary[np.array(v.shapes)].copy()
        observed = np.flatnonzero(v.labels)
        own[observed] = -CLAMP
        own[observed, v.labels[observed]] = 0.0
        scores.append(own)
        links += [(n + i, n + i + 1) for i in v.chain()]
        kinds += [0] * (len(links) - len(kinds))
        links += [(n + i, n + j) for i, j in v.skips()]
        kinds += [1] * (len(links) - len(kinds))
        owners += [d] * (len(links) - len(owners))
        n += len(v.places)
    spans = [list(b) for b in bases]
    if not n:
        return bases, spans
    marginal = propagate(
        np.concatenate(scores), np.array(links, np.int64).reshape(-1, 2), np.array(kinds, np.int64), (chain, skip),
        np.array(owners, np.int64),
    )
    label = np.where(marginal[:, 1:].max(axis=1) > THRESHOLD, marginal[:, 1:].argmax(axis=1) + 1, 0)
    for d, v in enumerate(fields):
        if v is None or not v.places:
            continue
        own = label[starts[d] : starts[d] + len(v.places)]
        last = None
        for i in np.flatnonzero((own > 0) & (v.labels == 0)).tolist():
            joined = last is not None and i == last + 1 and own[i] == own[last] and v.ordinals[i] == v.ordinals[last] + 1
            begin, end = v.places[i]
            if joined:
                spans[d][-1] = (spans[d][-1][0], spans[d][-1][1], end)
            else:
                spans[d].append((int(own[i]) - 1, begin, end))
            last = i
        spans[d].sort()
    return bases, spans


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_personal_data(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``pii_spans``: (kind, start, end) by kind, then start.

    ``pii_spans`` has the base spans and those the field adds; an added span never
    touches a token under a base span.  A text without base spans has nothing observed;
    its tokens are judged by shapes and links alone.  Null and empty texts have none;
    repeated rows get equal spans;
    columns of the two names are replaced; an empty table stays empty.
    """
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def start():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            bodies = [x or "" for x in part.column(text).to_pylist()]
            named = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], kind)
            return [named(x) for x in _found(bodies, model)]

        return work

    return add_columns(docs, text, [("base_spans", T.ArrayType(SPAN)), ("pii_spans", T.ArrayType(SPAN))], start)


def shown(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
