"""Secret scans: patterns, and Shannon entropy in a sliding window. DataFrame operations only.

Base kinds are patterns: assignments of a password, token or key; access key ids; long hexadecimal
strings. The entropy kind takes candidate strings of 20 characters or more, by character class:

- ``hex``: hexadecimal digits of either case, 32 or more; window 32, at least 3.0 bits a character;
- ``mixed``: letters, digits and +/_=-, with lower and upper case and a digit; window 20, at least 3.8 bits;
- ``lower``, ``upper``: as mixed, with letters of that case alone and a digit; window 20, at least 3.7 bits;
- ``letters``: as mixed, without a digit; window 20, at least 3.9 bits.

The entropy of a window is log2(w) - sum(c * log2 c) / w over its character counts. The counts go along with the window, as one
character each of a string of 128: sliding on changes two of them, and the sum by two differences. A candidate's entropy is that of
its best window. Suppressed (the allow list): strings of digits only, UUIDs, words joined by single separators, paths of
such words, marked examples and placeholders, alphabet and digit runs. Base spans are cut out first, and
candidates are looked for in what lies between them; so nothing overlaps a base span.

Positions come from the texts between matches: split by the pattern, sum up the lengths. Repeated groups in the patterns are
possessive, which the matcher runs as loops, so long unbroken strings neither overflow its stack nor take more than linear time.

Edge cases: null text counts as empty; empty texts have no spans; whole texts are scanned, one pass per kind, and only texts that
match are split; repeated rows each get their spans; columns of any name are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.functions.arrays import let, running, text_between, text_parts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs are greedy and maximal, so asking for their length here equals dropping shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
MIN_VALUE, MIN_CANDIDATE = 6, 20
CLASSES = {"hex": (32, 3.0), "mixed": (20, 3.8), "lower": (20, 3.7), "upper": (20, 3.7), "letters": (20, 3.9)}
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?+(?:[A-Za-z][a-z]*+|[0-9]++|[A-Z]++)(?![A-Za-z0-9])(?:[/_=+-]++(?:[A-Za-z][a-z]*+|[0-9]++|[A-Z]++)(?![A-Za-z0-9]))*+/?+$",
    r"(?i)example|placeholder|your[_-]?(?:key|token|secret)|changeme|xxxx|dummy",
    r"(?i)abcdefgh|01234567|(.)\1{7}",
)
#: For the classes without all of digits and both cases: words, also in camel case or numbered, and their paths.
ALLOWED_WORDS = r"^[/_=+-]*+(?:(?=[A-Za-z0-9])(?:[a-z]*+(?:[A-Z][a-z]{2,})*+[0-9]{0,4}|[A-Z]++[0-9]{0,4}|[0-9]++)(?![A-Za-z0-9])[/_=+-]*+)*+$"
MASK = "[SECRET]"

_SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Array of (start, kind_no, end, kind) of the matches that ``keep`` (of a match) holds for."""

    def located(matches: Column) -> Column:
        # One more gap than matches: the last place has no match.
        places = F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))

        def at(each: Column) -> Column:
            before = running(F.transform(each, lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))), lambda a, b: a + b, F.lit(0), "int")
            return F.zip_with(before, each, lambda b, x: F.struct((b + x["gap"]).alias("start"), x["match"].alias("match")))

        found = F.filter(let(places, at), lambda x: F.coalesce(keep(x["match"]), F.lit(False)))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(_none()))


def _weight(count: Column) -> Column:
    """c * log2(c), 0 for none."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(candidate: Column, window: Column) -> Column:
    """Most bits a character of any window of that width; null if the candidate is shorter. Candidates are ASCII."""
    zero = 33  # the counts of the 128 characters are written as characters from this one on

    def count(counts: Column, c: Column) -> Column:
        return F.ascii(F.substring(counts, c + 1, F.lit(1))) - zero

    def changed(counts: Column, c: Column, by: int) -> Column:
        return F.overlay(counts, F.char(count(counts, c) + zero + by), c + 1, F.lit(1))

    def best(codes: Column) -> Column:
        head = F.slice(codes, 1, window)
        counts = F.aggregate(head, F.lit(chr(zero) * 128), lambda acc, c: changed(acc, c, 1))
        state = let(counts, lambda n: let(F.aggregate(F.array_distinct(head), F.lit(0.0), lambda t, c: t + _weight(count(n, c))), lambda t: F.struct(t.alias("total"), t.alias("least"), n.alias("counts"))))

        def step(acc: Column, i: Column) -> Column:
            leaving, entering = F.element_at(codes, i - window), F.element_at(codes, i)
            less = F.struct((acc["total"] - _weight(count(acc["counts"], leaving)) + _weight(count(acc["counts"], leaving) - 1)).alias("total"), changed(acc["counts"], leaving, -1).alias("counts"))

            def enter(now: Column) -> Column:
                more = now["total"] - _weight(count(now["counts"], entering)) + _weight(count(now["counts"], entering) + 1)
                return let(more, lambda t: F.struct(t.alias("total"), F.least(acc["least"], t).alias("least"), changed(now["counts"], entering, 1).alias("counts")))

            return let(less, enter)

        steps = F.when(F.size(codes) > window, F.sequence(window + 1, F.size(codes))).otherwise(F.array().cast("array<int>"))
        return F.log2(window.cast("double")) - F.aggregate(steps, state, step, lambda acc: acc["least"]) / window

    chars = F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0))
    return F.when(F.length(candidate) >= window, let(F.transform(chars, lambda c: F.ascii(c)), best))


def _high_entropy(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    digit, lower, upper = (candidate.rlike(c) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    # The first class that holds.
    of_class = F.when(candidate.rlike("^[0-9a-fA-F]+$"), "hex").when(digit & lower & upper, "mixed").when(digit & lower, "lower").when(digit & upper, "upper").when(~digit & (lower | upper), "letters")

    def measured(name: Column) -> Column:
        window, bits = (F.element_at(F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, v[i])]), name) for i in (0, 1))
        words = ~name.isin("hex", "mixed") & candidate.rlike(ALLOWED_WORDS)
        return F.when(name.isNull() | words, F.lit(False)).otherwise(F.coalesce(let(window, lambda w: window_entropy(candidate, w)) >= bits, F.lit(False)))

    return F.when(allowed, F.lit(False)).otherwise(let(of_class, measured))


def _base(text: Column) -> Column:
    """Spans of the base kinds in order of start and kind."""
    # Values are looked at only in the few matches, not in the texts again.
    keeps = {"assign": lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN, 2)) >= MIN_VALUE, "access": lambda m: m.isNotNull(), "hex": lambda m: m.isNotNull()}
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    return F.array_sort(F.concat(*[_spans(text, patterns[k], k, keeps[k]) for k in KINDS[:3]]))


def _covered(spans: Column) -> Column:
    """For each span the end of what the spans before it cover."""
    return running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0), "int")


def _entropy(text: Column, base: Column) -> Column:
    """Entropy spans of the text between the base spans."""

    def between(cut: Column) -> Column:
        ends = F.concat(F.transform(base, lambda s: s["start"]), F.array(F.length(text)))
        last = F.array(F.array_max(F.transform(base, lambda s: s["end"])))
        gaps = F.zip_with(F.concat(_covered(base), last), ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
        long = F.filter(gaps, lambda g: g["end"] - g["start"] >= MIN_CANDIDATE)
        return F.transform(long, lambda g: F.struct(g["start"].alias("start"), text_between(cut, g["start"], g["end"]).alias("part")))

    def found(g: Column) -> Column:
        own = _spans(g["part"], CANDIDATE, "entropy", _high_entropy)
        return F.transform(own, lambda s: F.struct((s["start"] + g["start"]).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + g["start"]).alias("end"), s["kind"].alias("kind")))

    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("part")))
    return F.flatten(F.transform(F.when(F.size(base) == 0, whole).otherwise(let(text_parts(text), between)), found))


def scan(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text (null is empty), spans: all spans in order of start, kind (array of start, kind_no, end, kind)."""
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.withColumn("base", _base(F.col("text")))
    return found.select("row", "text", F.array_sort(F.concat("base", _entropy(F.col("text"), F.col("base")))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    return scan(docs.select(F.col("doc_id").cast("long"), "text")).select("row.doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``, overlapping ones once; other texts as they are, columns too."""
    spans = F.col("spans")

    def masked(cut: Column) -> Column:
        def piece(covered: Column, s: Column) -> Column:
            return F.when(s["start"] >= covered, F.concat(text_between(cut, covered, s["start"]), F.lit(mask))).otherwise(F.lit(""))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(_covered(spans), spans, piece), ""), text_between(cut, last, F.length("text")))

    cleaned = F.when(F.size(spans) > 0, let(text_parts(F.col("text")), masked)).otherwise(F.col("row.text"))
    return scan(docs).select(*[cleaned.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
