"""Format-preserving pseudonyms for personal data. DataFrame operations only.

Validated numbers and dates are permuted within their format by a keyed Feistel network: the value is a
pair (a, b) of residues, and rounds add to one residue a keyed hash (SHA-256) of the other. Each round can be undone, so
the whole is a permutation of the format's values: equal values get equal pseudonyms in every document, and different values different ones.

- ``card``: 13 to 19 digits that pass the check-digit test, also beside other digits, in whole groups; all but the last are permuted, the check digit is set anew; separators stay;
- ``ssn``: 3-2-4 digits with valid groups; ``phone``: with a country code (kept) or in area-code form; the other digits are permuted;
- ``ip``: four octets up to 255, permuted as a 32-bit number;
- ``date``: real days of 1800 to 2199 (year first, day first, or month first where that alone is a day; also before a time of day), permuted as days of that 400-year cycle (146,097 = 189 * 773 days);
- ``email``: no number; the local part's letters and digits are replaced by keyed hash values of the same kind, the domain stays.

One pattern finds all kinds in one pass, leftmost first. Matches that fail their validation stay as they are. Repeated groups in the
pattern are possessive or bounded, and runs of characters are entered once, so long unbroken strings neither overflow the matcher's stack nor
take more than linear time.

Edge cases: null text stays null; empty and clean texts stay the same; repeated rows get the same text; columns of any name are kept; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweave.functions.arrays import let, parts

KEY = "arborweave-default-key"
ROUNDS = 8
#: What an e-mail address's local part and a label of its domain are made of.
LOCAL, LABEL = r"[\p{L}\p{N}._%+-]", "[A-Za-z0-9-]"
#: From where a run of local characters begins, or the match before ended; all labels of the domain, of which one but the first begins with two letters.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@(?={LABEL}++(?:\.(?![A-Za-z]{{2}}){LABEL}++)*+\.[A-Za-z]{{2}}){LABEL}++(?:\.{LABEL}++)*+"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|[.-]\d)"
DATE = r"(?<![\w./-])(?:(?:18|19|20|21)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:18|19|20|21)\d\d)(?!(?![Tt]\d\d:?\d\d)\w|[./-]\d)"
PHONE = r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)"
#: Ends a group of digits: neither a word nor a decimal goes on.
_ENDS = r"(?!\w|\.\d)"
#: What follows a space isn't an e-mail address.
_NO_MAIL = rf"(?!{LOCAL}*+@)"
#: A whole run of digit groups, 13 digits at least; it ends before a date, a social security or a phone number. Cards are looked for inside.
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_NO_MAIL}\d++{_ENDS}(?:(?:-| {_NO_MAIL}(?!{DATE.replace(chr(92) + '1', chr(92) + '3').replace(chr(92) + '2', chr(92) + '4')}|{SSN}|{PHONE}))\d++{_ENDS})*+"
CARD_DIGITS = (13, 19)
DAYS, DAY_MODULI = 146_097, (189, 773)
#: A step lands on a day over 12 in six of ten cases, so the walk of a month-first date ends long before.
MONTH_FIRST_STEPS = 64
KINDS = ("email", "ip", "date", "ssn", "phone", "card")


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash, as long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, a_mod: Column, b_mod: Column, key: str, tweak: Column, rounds: int = ROUNDS, inverse: bool = False) -> tuple[Column, Column]:
    """Permutes pairs of residues; ``inverse`` undoes it. Rounds are nested as array steps, so expressions don't double in size."""
    order = range(rounds) if not inverse else reversed(range(rounds))
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        hashed = _keyed(key, tweak, i, F.when(even, pair["b"]).otherwise(pair["a"]))
        modulus = F.when(even, a_mod).otherwise(b_mod)
        shift = hashed % modulus if not inverse else modulus - hashed % modulus
        return F.struct(F.when(even, (pair["a"] + shift) % a_mod).otherwise(pair["a"]).alias("a"), F.when(even, pair["b"]).otherwise((pair["b"] + shift) % b_mod).alias("b"))

    out = F.aggregate(F.array(*[F.lit(i) for i in order]), pair, step)
    return out["a"], out["b"]


def _power10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), n + 1)


def permuted_digits(digits: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """A string of 2 to 20 digits, permuted among the strings of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n - left).cast("long")
    out = F.struct(*[x.alias(k) for k, x in zip("ab", feistel(a, b, _power10(left), _power10(n - left), key, F.concat(tweak, F.lit(":"), n.cast("string")), inverse=inverse))])
    return let(out, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0")))


def luhn_sum(digits: Column) -> Column:
    """Check sum modulo 10 of a digit string, the last digit counted once."""
    chars = F.reverse(F.regexp_extract_all(digits, F.lit("."), F.lit(0)))

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(chars, value), F.lit(0), lambda s, x: s + x) % 10


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _with_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct((acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"), F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)), start, step, lambda acc: acc["out"])


def _card(m: Column, key: str) -> Column:
    """A card (one that passes the test) with its digits permuted and a new check digit."""

    def swap(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        return let(body, lambda x: _with_digits(m, F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0")))) % 10).cast("string"))))

    return let(_digits(m), swap)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(*CARD_DIGITS) & ~digits.rlike("^0+$") & (luhn_sum(digits) == 0)


def _card_run(m: Column, key: str) -> Column:
    """Text and number of cards (text, n) of a run of digit groups.

    A run that is a card in whole is one. Else cards are stretches of whole groups that pass the test, from the left on. Of those that
    begin with one group, a usual grouping is preferred, then the longer one; a stretch in no usual grouping gives way to one that
    is in a usual grouping and begins inside it. The cost grows with the run's length: the result is joined from parts.
    """
    tokens = F.regexp_extract_all(m, F.lit("[0-9]+|[ -]"), F.lit(0))  # groups at even places from 0, separators between

    def inside(t: Column) -> Column:
        groups = F.floor((F.size(t) + 1) / 2).cast("int")

        def text(a: Column, b: Column) -> Column:
            """Groups a to b (inclusive) with their separators."""
            return F.array_join(F.slice(t, 2 * a + 1, 2 * (b - a) + 1), "")

        def stretch(a: Column, b: Column) -> Column:
            def described(grouped: Column) -> Column:
                usual = grouped.rlike(r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$")
                return let(_digits(grouped), lambda d: F.struct(F.when(usual, 0).otherwise(1).alias("rank"), (-F.length(d)).alias("size"), b.alias("b"), d.alias("digits")))

            return let(text(a, b), described)

        def best(a: Column) -> Column:
            ends = F.sequence(a, F.least(a + CARD_DIGITS[1] - 1, groups - 1))
            return F.get(F.array_sort(F.filter(F.transform(ends, lambda b: stretch(a, b)), lambda s: _is_card(s["digits"]))), F.lit(0))

        def marked(found: Column) -> Column:
            """Each group with the last group of its card, if one begins there."""

            def ends(s: Column, i: Column) -> Column:
                later = F.slice(found, i + 2, s["b"] - i)
                return F.struct(i.alias("a"), F.when((s["rank"] == 0) | ~F.exists(later, lambda x: F.coalesce(x["rank"] == 0, F.lit(False))), s["b"]).alias("b"))

            return F.transform(found, ends)

        def write(acc: Column, g: Column) -> Column:
            lead = F.when(g["a"] > 0, F.get(t, 2 * g["a"] - 1)).otherwise(F.lit(""))
            whole = F.struct((g["b"] + 1).alias("at"), F.concat(acc["out"], lead, _card(text(g["a"], g["b"]), key)).alias("out"), (acc["n"] + 1).alias("n"))
            plain = F.struct((g["a"] + 1).alias("at"), F.concat(acc["out"], lead, F.get(t, 2 * g["a"])).alias("out"), acc["n"].alias("n"))
            return F.when(g["a"] < acc["at"], acc).when(g["b"].isNotNull(), whole).otherwise(plain)

        def add(acc: Column, part: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.lit("").alias("out"), acc["n"].alias("n"))
            return let(F.aggregate(part, start, write), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"), x["n"].alias("n")))

        last = groups - 1
        apart = let(F.transform(F.sequence(F.lit(0), last), best), marked)
        every = F.when(_is_card(_digits(m)), F.array(F.struct(F.lit(0).alias("a"), last.alias("b")))).otherwise(apart)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(parts(every), start, add, lambda acc: F.struct(F.array_join(acc["out"], "").alias("text"), acc["n"].alias("n")))

    return let(tokens, inside)


SOUND_SSN = "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"


def _plain(m: Column, key: str, kind: Column) -> Column:
    """Digits of a social security or phone number permuted, but for a country code; an unsound number stays."""
    prefix = F.when(kind == "phone", F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-]))?", 0)).otherwise(F.lit(""))

    def swap(rest: Column) -> Column:
        return F.concat(prefix, _with_digits(rest, permuted_digits(_digits(rest), key, kind)))

    return F.when((kind == "ssn") & ~m.rlike(SOUND_SSN), m).otherwise(let(F.substring(m, F.length(prefix) + 1, F.length(m)), swap))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\.", -1), lambda x: x.cast("int"))

    def swap(p: Column) -> Column:
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("int"), (x["a"] % 256).cast("int"), F.floor(x["b"] / 256).cast("int"), (x["b"] % 256).cast("int")))

    return let(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), swap(p)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """Year first, or year last with the day before the month, or after it where only that is a day.

    Month-first texts are permuted among themselves (steps go on until the day is over 12 again), so none meets a day-first one.
    Single-digit days and months stay unpadded only if they were.
    """
    separator = F.regexp_extract(m, r"[-/.]", 0)
    year_first = m.rlike(r"^[0-9]{4}")
    fields = F.split(m, r"[-/.]", -1)
    padded = ~m.rlike(r"(?:^|[-/.])[0-9](?:[-/.]|$)")

    def number(year: Column, month: Column, day: Column) -> Column:
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        n = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1800-01-01").cast("date"))
        return F.when((n >= 0) & (n < DAYS), n)

    def of(n: Column) -> Column:
        return F.date_add(F.lit("1800-01-01").cast("date"), n)

    def permuted(n: Column, month_first: Column) -> Column:
        """The day after one step, or after as many as bring a month-first date to a day over 12 again."""

        def step(acc: Column, _: Column) -> Column:
            a, b = feistel(F.floor(acc["n"] / DAY_MODULI[1]), acc["n"] % DAY_MODULI[1], F.lit(DAY_MODULI[0]), F.lit(DAY_MODULI[1]), key, F.lit("date"))
            next_day = let(F.struct(a.alias("a"), b.alias("b")), lambda x: (x["a"] * DAY_MODULI[1] + x["b"]).cast("int"))
            return F.when(acc["done"], acc).otherwise(let(next_day, lambda x: F.struct(x.alias("n"), (~month_first | (F.dayofmonth(of(x)) > 12)).alias("done"))))

        return F.aggregate(F.sequence(F.lit(1), F.when(month_first, MONTH_FIRST_STEPS).otherwise(1)), F.struct(n.alias("n"), F.lit(False).alias("done")), step, lambda acc: acc["n"])

    def written(d: Column, month_first: Column) -> Column:
        dd = F.when(padded, F.lpad(F.dayofmonth(d).cast("string"), 2, "0")).otherwise(F.dayofmonth(d).cast("string"))
        mm = F.when(padded, F.lpad(F.month(d).cast("string"), 2, "0")).otherwise(F.month(d).cast("string"))
        yy = F.lpad(F.year(d).cast("string"), 4, "0")
        return F.when(year_first, F.concat(yy, separator, mm, separator, dd)).when(month_first, F.concat(mm, separator, dd, separator, yy)).otherwise(F.concat(dd, separator, mm, separator, yy))

    def swap(p: Column) -> Column:
        usual = number(F.when(year_first, p[0]).otherwise(p[2]), p[1], F.when(year_first, p[2]).otherwise(p[0]))
        other = F.when(~year_first, number(p[2], p[0], p[1]))
        both = F.struct(F.coalesce(usual, other).alias("n"), usual.isNull().alias("month_first"))
        return let(both, lambda d: F.when(d["n"].isNull(), m).otherwise(let(permuted(d["n"], d["month_first"]), lambda x: written(of(x), d["month_first"]))))

    return let(fields, swap)


def _email(m: Column, key: str) -> Column:
    """The address reaches to the last label of the domain that begins with two letters, as far as its letters go; what is behind stays."""
    found = F.regexp_extract(m, r"^[^@]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)

    def swap(address: Column) -> Column:
        local = F.substring_index(address, "@", 1)
        stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"email{i}"), F.lower(address)), 256) for i in range(4)])

        def char(c: Column, i: Column, bytes_: Column) -> Column:
            byte = F.conv(F.substring(bytes_, (i * 4) % 256 + 1, F.lit(4)), 16, 10).cast("int")
            letters, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")
            return F.when(c.rlike(r"^\p{N}$"), F.substring(digits, byte % 10 + 1, F.lit(1))).when(c.rlike(r"^\p{L}$"), F.substring(letters, byte % 26 + 1, F.lit(1))).otherwise(c)

        new = let(stream, lambda x: F.array_join(F.transform(F.regexp_extract_all(local, F.lit("(?s)."), F.lit(0)), lambda c, i: char(c, i, x)), ""))
        return F.concat(new, F.substring(m, F.length(local) + 1, F.length(m)))

    return let(found, swap)


def pseudonym(m: Column, key: str) -> Column:
    """Kind, text and number of replaced values (kind, text, n) of one match, by the first kind that it is of in whole."""
    kind = (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(m.rlike(f"^(?:{DATE})$"), "date")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d[0-9 -]*$") & ~m.rlike(r"^\d{3}-\d{3}-\d{4}$"), "card")
        .otherwise("phone")
    )

    def replaced(k: Column) -> Column:
        text = F.when(k == "email", _email(m, key)).when(k == "ip", _ip(m, key)).when(k == "date", _date(m, key)).otherwise(_plain(m, key, k))
        one = let(text, lambda x: F.struct(x.alias("text"), (x != m).cast("int").alias("n")))
        return let(F.when(k == "card", _card_run(m, key)).otherwise(one), lambda x: F.struct(k.alias("kind"), x["text"].alias("text"), x["n"].alias("n")))

    return let(kind, replaced)


#: Groups of the date pattern are numbered within it, so it comes first in the whole.
PATTERN = f"{DATE}|{EMAIL}|{IP}|{SSN}|{PHONE}|{CARD}"


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """row (all columns of ``docs``), text with pseudonyms, marks: array of (kind, n: values replaced) per match."""
    text = F.col("text")
    found = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    nothing = F.array().cast("array<string>")
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(nothing)  # all kinds have one of these
    found = found.withColumn("found", F.coalesce(matches, nothing))
    found = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.col("new"), lambda g, m: F.concat(g, F.coalesce(m["text"], F.lit(""))))
    replaced = F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(text)
    return found.select("row", replaced.alias("text"), F.transform("new", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("marks"))


def without_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; other columns as they are."""
    return pseudonymized(docs, key).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def pseudonyms(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, the number of values replaced of each kind."""
    out = pseudonymized(docs.select(F.col("doc_id").cast("long"), "text"), key)

    def count(kind: str) -> Column:
        return F.aggregate("marks", F.lit(0), lambda n, p: n + F.when(p["kind"] == kind, p["n"]).otherwise(0)).cast("long").alias(f"n_{kind}")

    return out.select("row.doc_id", "text", *[count(k) for k in KINDS])
