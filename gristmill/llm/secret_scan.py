"""Secret scans (operator 8): patterns, and a battery of randomness tests.

Built-in expressions only.  Patterns give the base spans.  Beside them, long runs of
encoding characters are candidates: from its characters each gets an inferred encoding,
and its symbols take three tests of uniform randomness (chi-squared uniformity over as
many cells as its length can fill, runs about the median, serial correlation).  Their
combined p-value has the null "random", a second one the null "harmless": a name made of
numbers and words as the table's own texts have them, whose likelihood ratio against
random symbols bounds the chance of as much evidence.  Both are held, inside strata of encoding and length, against
Benjamini and Hochberg's rule over the whole corpus.  Reported is what the rule rejects
as harmless, so that false reports are what it controls, and doesn't reject as random.
Every run that mixes letters and digits has an encoding; where base spans cover a part
of a run, what they leave is tested.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.staging import stage

# What the base kinds look like.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run is one match or none, so the length can stand inside
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
# Candidates of the battery: runs of 20 or more; a closing = belongs to the run.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST = 20
SEPARATORS = r"[+/_-]"
# Between the separators of a run stand candidates of their own.
SEGMENT = r"[A-Za-z0-9]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base38": "0123456789abcdefghijklmnopqrstuvwxyz-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Frequencies of letters in English text, in percent.
LETTERS = dict(zip(
    "abcdefghijklmnopqrstuvwxyz",
    (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
     6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
))
# Common words, which tell what letter follows what before a text does.
WORDS = (
    "the of and to in is you that it he was for on are as with his they at be this have from or one had by word "
    "but not what all were we when your can said there use an each which she do how their if will up other about "
    "out many then them these so some her would make like him into time has look two more write go see number no "
    "way could people my than first water been call who oil its now find long down day did get come made may part "
    "report version final draft chapter section notes page header user profile project module util conference "
    "program committee python setup tools file image index table value server client public private change"
).split()
# Their weight, and that of the letters alone, in pairs seen.
LETTER_WEIGHT = 20.0
# Share of letters that harmless names take evenly: other languages, initials.
EVEN_LETTERS = 0.1
# Parts of a text that may be words: nothing that a key could be made of stands at them.
BETWEEN_TOKENS = r"[^A-Za-z0-9+/_=-]+"
LONGEST_WORD = 32
# What follows what in a harmless name: S a separator or the start; in runs of one case
# A a letter, N a digit; in the others L and U a lower and an upper letter, D a digit.
STEPS = {
    "SA": 0.75, "SN": 0.25, "AA": 0.95, "AN": 0.05, "NN": 0.85, "NA": 0.15,
    "SL": 0.55, "SU": 0.25, "SD": 0.2,
    "LL": 0.91, "LU": 0.05, "LD": 0.04,
    "UL": 0.47, "UU": 0.47, "UD": 0.06,
    "DD": 0.85, "DL": 0.09, "DU": 0.06,
}
# Alphabets a random run may have, hex and base36 and base38 in either case.
VARIANTS = 8
FALSE_DISCOVERY = 0.05
P_FLOOR_EXPONENT = 12
BINS_PER_DECADE = 50

SPANS = "array<struct<kind:int,start:int,end:int>>"


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """(kind, start, end) of all matches in code points; ``keep``: flags, one for each match.

    What stands between the matches gives their places.
    """
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    flags = F.transform(sizes, lambda _: F.lit(True)) if keep is None else keep
    steps = F.arrays_zip(between.alias("gap"), sizes.alias("n"), flags.alias("keep"))
    begun = F.struct(F.lit(0).alias("at"), _no_spans().alias("found"))

    def step(held: Column, x: Column) -> Column:
        start = held["at"] + x["gap"]
        end = start + x["n"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        found = F.when(x["keep"], F.concat(held["found"], F.array(span))).otherwise(held["found"])
        # The last gap has no match behind it.
        return F.when(x["n"].isNull(), held).otherwise(F.struct(end.alias("at"), found.cast(SPANS).alias("found")))

    return F.aggregate(steps, begun, step, lambda held: held["found"])


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds: leftmost, not overlapping in a kind, failing ones left out."""
    assign_ok = F.transform(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.char_length(x) >= ASSIGN_LEAST
    )
    parts = (
        F.when(text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, 0, assign_ok)),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)),
    )
    return F.concat(*[F.coalesce(p, _no_spans()) for p in parts])


def _mixed(run: Column) -> Column:
    return run.rlike("[0-9]") & run.rlike("[A-Za-z]")


def _body(run: Column) -> Column:
    """The characters that are tested.  In a run of one-case letters the separators are none
    of its symbols and go, if enough is left."""
    bare = F.regexp_replace(run, "=+$", "")
    joined = F.regexp_replace(bare, SEPARATORS, "")
    one_case = ~(bare.rlike("[A-Z]") & bare.rlike("[a-z]"))
    return F.when(one_case & (F.char_length(joined) >= LEAST), joined).otherwise(bare)


def _encoding(body: Column) -> Column:
    """The narrowest encoding that has all the characters; words and numbers are none."""
    return (
        F.when(~_mixed(body), F.lit(None).cast("string"))
        .when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(body.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(body.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), F.lit("base36"))
        .when(body.rlike("[A-Z]") & body.rlike("[a-z]"), F.lit("base64"))
        .otherwise(F.lit("base38"))
    )


def _by_encoding(value) -> Column:
    whens = [F.when(F.col("encoding") == e, value(a)) for e, a in ALPHABETS.items()]
    return F.coalesce(*whens)


def _symbols(run: Column) -> Column:
    """Numbers of the characters in the alphabet of the inferred encoding."""
    def of(alphabet: str) -> Column:
        folded = run if len(alphabet) == 64 else F.upper(run) if alphabet[0] == "A" else F.lower(run)
        same = {64: F.translate(folded, "-_", "+/"), 38: F.translate(folded, "+/", "-_")}.get(len(alphabet), folded)
        # split() by nothing gives the characters.
        return F.transform(F.split(same, ""), lambda c: F.call_function("instr", F.lit(alphabet), c) - 1)

    return _by_encoding(of)


def _two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal Z: a rational approximation, good to 2e-7."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Coefficients of the approximation of erfc.
    poly = reduce(lambda p, c: (p + F.lit(c)) * t, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429) * t)
    return poly * F.exp(-x * x)


def battery(candidates: DataFrame, run: str = "run") -> DataFrame:
    """Add ``p_uniform``, ``p_runs``, ``p_serial`` and their combination ``p``.

    ``encoding`` must not be null.  Cells of the chi-squared test: as many as keep five
    expected symbols in each, two at least.  ``p`` is three times the least of the three,
    one at most.
    """
    base = _by_encoding(lambda a: F.lit(len(a)))
    typed = candidates.withColumn("__body", _body(F.col(run))).select(
        *candidates.columns, _symbols(F.col("__body")).alias("__s"), base.alias("__k")
    ).withColumn("__n", F.size("__s"))
    n, k = F.col("__n"), F.col("__k")
    cells = F.greatest(F.lit(2), F.least(k, F.floor(n / 5).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    typed = typed.withColumn("__c", cells)
    counted = F.transform(
        F.sequence(F.lit(0), F.col("__c") - 1),
        lambda j: F.size(F.filter("__s", lambda x: F.floor(x * F.col("__c") / F.col("__k")) == j)).cast("double"),
    )
    # Cells of unequal width: the alphabet's symbols that fall in each.
    expected = F.transform(
        F.sequence(F.lit(0), F.col("__c") - 1),
        lambda j: n * (F.ceil((j + 1) * k / F.col("__c")) - F.ceil(j * k / F.col("__c"))) / k,
    )
    chi = total(F.zip_with(counted, expected, lambda o, e: (o - e) * (o - e) / e))
    df = F.col("__c") - 1
    cube = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    upper = F.when(cube > 0, _two_sided(cube) / 2).otherwise(1 - _two_sided(cube) / 2)
    high = F.transform("__s", lambda x: (x * 2 >= F.col("__k")).cast("int"))
    n1 = total(F.transform(high, lambda x: x.cast("double")))
    n0 = n - n1
    changes = total(F.zip_with(F.slice(high, 1, n - 1), F.slice(high, 2, n - 1), lambda a, b: (a != b).cast("double")))
    mean = 2 * n1 * n0 / n + 1
    spread = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, _two_sided((changes + 1 - mean) / F.sqrt(spread))).otherwise(F.lit(0.0))
    centred = F.transform("__s", lambda x: x - (F.col("__k") - 1) / 2.0)
    square = total(F.transform(centred, lambda x: x * x))
    product = total(F.zip_with(F.slice(centred, 1, n - 1), F.slice(centred, 2, n - 1), lambda a, b: a * b))
    serial = F.when(square > 0, _two_sided(product / square * F.sqrt(n))).otherwise(F.lit(0.0))
    tested = typed.select(
        *candidates.columns, upper.alias("p_uniform"), runs.alias("p_runs"), serial.alias("p_serial")
    )
    return tested.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial")))


def learn_letters(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-probabilities of a letter or digit by the one before, from all words of all texts.

    Words are counted first, each of them gives its pairs once for all its occurrences, and
    the pairs, at most 26 x 26, reach the driver.  Row 0 is for letters with none before;
    in a row, place 0 is no symbol and has probability 1, then come letters and digits.
    Null texts have no words.
    """
    tokens = docs.select(F.explode(F.split(F.col(text), BETWEEN_TOKENS)).alias("token"))
    counted = tokens.filter(F.char_length("token").between(2, LONGEST_WORD)).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    words = counted.filter(F.col("token").rlike("^[A-Za-z]+$")).select(F.lower("token").alias("word"), "n")
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    pairs = words.select(F.explode(F.transform(places, lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair"), "n")
    seen = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    return letter_table(seen)


def letter_table(seen: dict[str, int]) -> list[float]:
    """The table of ``learn_letters`` from counts of pairs of letters."""
    names = list(LETTERS)
    alone = {b: share / sum(LETTERS.values()) for b, share in LETTERS.items()}
    known = dict(seen)
    for word in WORDS:
        for i in range(len(word) - 1):
            known[word[i : i + 2]] = known.get(word[i : i + 2], 0) + 1
    out = []
    for a in ["", *names]:
        total = sum(known.get(a + b, 0) for b in names) if a else 0
        out.append(0.0)
        for b in names:
            n = known.get(a + b, 0) if a else 0
            share = (n + LETTER_WEIGHT * alone[b]) / (total + LETTER_WEIGHT)
            out.append(log((1 - EVEN_LETTERS) * share + EVEN_LETTERS / len(names)))
        out += [log(0.1)] * 10
    return out


def harmless(candidates: DataFrame, letters: list[float], run: str = "run") -> DataFrame:
    """Add ``p_harmless``: the chance, at most, that a harmless name looks as random.

    A harmless name is a chain of letters and digits that seldom changes between the two
    and begins anew behind a separator; letters follow each other as ``letters`` says
    (``learn_letters``).  A random one has equal symbols.  Where separators stand is given
    for both.  By Markov's inequality the likelihood ratio is a p-value, after division by
    the number of alphabets that were tried.  Evidence adds up by the character, so short
    runs have little.
    """
    symbols = "abcdefghijklmnopqrstuvwxyz0123456789"
    mixed = F.col("encoding") == "base64"
    kinds = F.translate(
        F.when(mixed, F.translate(F.col(run), symbols + symbols[:26].upper(), "L" * 26 + "D" * 10 + "U" * 26)).otherwise(
            F.translate(F.lower(run), symbols, "A" * 26 + "N" * 10)
        ), "+/_-=", "S" * 5,
    )
    typed = candidates.select(
        *candidates.columns, F.split(kinds, "").alias("__kinds"), F.split(F.lower(run), "").alias("__chars")
    )
    steps = F.create_map(*[F.lit(x) for k, v in STEPS.items() for x in (k, log(v))])
    table = F.array(*[F.lit(x) for x in letters])
    behind = lambda a: F.concat(F.array(F.lit("S")), F.slice(a, 1, F.size(a) - 1))
    place = lambda c, of: F.call_function("instr", F.lit(of), c)
    changes = F.zip_with(
        behind("__kinds"), "__kinds", lambda a, b: F.coalesce(F.element_at(steps, F.concat(a, b)), F.lit(0.0))
    )
    # What stands at the start is no lower-case letter, as the capital S isn't.
    drawn = F.zip_with(
        behind("__chars"), "__chars",
        lambda a, b: F.element_at(table, place(a, symbols[:26]) * (len(symbols) + 1) + place(b, symbols) + 1),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(F.filter("__kinds", lambda x: x != "S"))
    alike = _by_encoding(lambda a: F.lit(log(sum(c.isalnum() for c in a))))
    ratio = total(changes) + total(drawn) + n * alike + log(VARIANTS)
    return typed.select(*candidates.columns, F.exp(F.least(F.lit(0.0), ratio)).alias("p_harmless"))


def _binned(p: str) -> Column:
    """Bin of a p-value on a logarithmic scale; its edge is the larger end."""
    level = F.least(F.lit(float(P_FLOOR_EXPONENT)), -F.log10(F.greatest(p, F.lit(10.0**-P_FLOOR_EXPONENT))))
    return F.floor(level * BINS_PER_DECADE).cast("int")


def _limits(binned: DataFrame, column: str, q: float) -> DataFrame:
    """(encoding, length_class, limit): the rule rejects bins from the limit on.

    It works on counts, a bounded table of strata x bins that is pre-aggregated.
    """
    keys = ["encoding", "length_class"]
    counts = binned.groupBy(*keys, F.col(column).alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    smaller = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    whole = Window.partitionBy(*keys)
    ranked = counts.select(*keys, "bin", F.sum("m").over(smaller).alias("rank"), F.sum("m").over(whole).alias("of"))
    rejected = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("of") <= F.col("rank") * q)
    return rejected.groupBy(*keys).agg(F.min("bin").alias(f"{column}_limit"))


def discoveries(tested: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """Candidates that Benjamini and Hochberg's rule at level ``q`` rejects as harmless
    (``p_harmless``) and doesn't reject as random (``p``).

    Strata: encoding, and length class by powers of two of ``run``, which is left out.
    P-values are taken as bins of a logarithmic scale, rounded up.  The bins are written
    once; the rule's limits, two for each of at most 5 x 31 strata, are broadcast.
    """
    others = [c for c in tested.columns if c not in ("run", "p_uniform", "p_runs", "p_serial", "p", "p_harmless")]
    binned = stage(tested.select(
        *others, F.floor(F.log2(F.char_length("run"))).cast("int").alias("length_class"),
        _binned("p").alias("random_bin"), _binned("p_harmless").alias("harmless_bin"),
    ), "tested")
    keys = ["encoding", "length_class"]
    judged = binned
    for column in ("random_bin", "harmless_bin"):
        judged = judged.join(F.broadcast(_limits(binned, column, q)), keys, "left")
    kept = judged.filter("harmless_bin >= harmless_bin_limit").filter(
        "random_bin_limit is null or random_bin < random_bin_limit"
    )
    return kept.select(*others)


def _outside(place: Column, covering: Column) -> Column:
    """The parts of a place that no span covers; spans by start."""
    span = lambda a, b: F.array(F.struct(F.lit(KINDS.index("random")).alias("kind"), a.alias("start"), b.alias("end")))
    begun = F.struct(place["start"].alias("at"), _no_spans().alias("parts"))

    def step(held: Column, s: Column) -> Column:
        before = F.when(s["start"] > held["at"], span(held["at"], s["start"])).otherwise(_no_spans())
        return F.struct(
            F.greatest(held["at"], s["end"]).alias("at"), F.concat(held["parts"], before).cast(SPANS).alias("parts")
        )

    def done(held: Column) -> Column:
        last = F.when(held["at"] < place["end"], span(held["at"], place["end"])).otherwise(_no_spans())
        return F.concat(held["parts"], last).cast(SPANS)

    return F.aggregate(covering, begun, step, done)


def _candidates(scanned: DataFrame) -> DataFrame:
    """(row, first, whole, place, run, encoding) of what the battery tests.

    Of a run, the parts outside base spans, except a short prefix of an assignment's name.
    Segments between the separators of a part (``whole`` false) count where it is rejected.
    """
    runs = scanned.filter(F.size("runs") > 0).select("row", "base", F.inline(F.arrays_zip("places", "runs")))
    place, run = F.col("places"), F.col("runs")
    touching = F.filter("base", lambda b: (b["start"] < place["end"]) & (b["end"] > place["start"]))
    by_start = F.array_sort(F.transform(touching, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    named = F.exists(touching, lambda b: b["kind"] == KINDS.index("assign"))
    parted = runs.select("row", "places", "runs", named.alias("named"), by_start.alias("covering")).select(
        "row", "places", "runs", "named", F.explode(_outside(place, F.col("covering"))).alias("place")
    )
    part = F.col("place")
    parts = parted.select(
        "row", "named", "place", F.substring(run, part["start"] - place["start"] + 1, part["end"] - part["start"]).alias("run")
    ).filter(F.col("run").rlike(f"^{RUN}$") | ~F.col("named"))
    piece = lambda whole, at, text: F.struct(F.lit(whole).alias("whole"), at.alias("place"), text.alias("run"))
    first = F.col("place")["start"]
    found = F.arrays_zip(
        _spans(F.col("run"), SEGMENT, KINDS.index("random")).alias("at"),
        F.regexp_extract_all("run", F.lit(SEGMENT), F.lit(0)).alias("text"),
    )
    moved = lambda at: F.struct(
        at["kind"].alias("kind"), (at["start"] + first).alias("start"), (at["end"] + first).alias("end")
    )
    segments = F.transform(found, lambda x: piece(False, moved(x["at"]), x["text"]))
    itself = F.array(piece(True, F.col("place"), F.col("run")))
    both = F.when(F.col("run").rlike(SEPARATORS), F.concat(itself, segments)).otherwise(itself)
    pieces = parts.select("row", first.alias("first"), F.inline(both))
    typed = pieces.withColumn("__body", _body(F.col("run"))).withColumn("encoding", _encoding(F.col("__body")))
    return typed.filter("encoding is not null").drop("__body").distinct()


def _row(doc_id, text) -> Column:
    """128 bits that tell rows apart, equal rows aside."""
    return F.struct(
        F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("second"), text, doc_id).alias("b")
    )


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", q: float = FALSE_DISCOVERY,
    letters: list[float] | None = None,
) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end) by start, then kind.

    ``spans`` holds the base spans and those the battery adds: candidates that stand the
    tests, without what base spans cover.  Null and empty texts have none.  Repeated rows each
    get the same result; rows that share an id but not the text are told apart by two hashes
    of it.  Other columns are not looked at; an empty table gives an empty one.  ``letters``
    (``learn_letters``) are learned from the table itself unless given.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    # Written once, narrow: both branches below read it.
    scanned = stage(marked.select(
        "doc_id",
        _row("doc_id", "text").alias("row"),
        base_spans(F.col("text")).alias("base"),
        F.when(F.col("text").rlike(RUN), _spans(F.col("text"), RUN, 3)).alias("places"),
        F.when(F.col("text").rlike(RUN), F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("runs"),
    ), "scanned")
    if letters is None:
        letters = learn_letters(marked)
    stood = discoveries(harmless(battery(_candidates(scanned)), letters), q)
    of_run = Window.partitionBy("row", "first")
    added = (
        stood.withColumn("__whole", F.max("whole").over(of_run))
        .filter("whole or not __whole")
        .groupBy("row").agg(F.collect_list("place").alias("added"))
    )
    joined = scanned.select("doc_id", "row", "base").join(added, "row", "left")
    order = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )
    return joined.select(
        "doc_id", "row", order("base").alias("base"),
        order(F.concat("base", F.coalesce("added", _no_spans()))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", q: float = FALSE_DISCOVERY) -> DataFrame:
    """All rows and columns, with every secret in the text replaced by a mask.

    Only rows that some pattern could match are shuffled to meet their spans; the
    others pass by.  Null texts stay null; helper columns start with two underscores.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    suspect = body.rlike(ASSIGN_HINT) | body.contains("AKIA") | body.rlike(HEX) | body.rlike(RUN)
    letters = learn_letters(docs, text)
    found = find_secrets(docs.filter(suspect), doc_id, text, q, letters).filter(F.size("spans") > 0)
    spans = found.select(F.col("row").alias("__row"), F.col("spans").alias("__spans")).dropDuplicates(["__row"])
    keyed = docs.filter(suspect).withColumn("__row", _row(F.col(doc_id), body))
    masked = keyed.join(spans, "__row", "left").withColumn(
        text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col("__spans")))
    )
    return docs.filter(~suspect).unionByName(masked.select(*docs.columns))


def shown(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch of spans replaced by the mask; other texts stay as they are."""
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        clear = F.substring(text, held["at"] + 1, s["start"] - held["at"])
        first = F.struct(s["end"].alias("at"), F.concat(held["out"], clear, F.lit(mask)).alias("out"))
        inside = F.struct(F.greatest(held["at"], s["end"]).alias("at"), held["out"].alias("out"))
        return F.when(s["start"] < held["at"], inside).otherwise(first)

    done = F.aggregate(spans, begun, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
