"""Array and string expressions whose cost grows with the length, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of a part that is built up one by one, and characters of a text's part.
PART, TEXT_PART = 128, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parts(values: Column, size: int = PART) -> Column:
    """Array of consecutive slices of ``size`` entries, the last one shorter."""

    def cut(own: Column) -> Column:
        count = F.ceil(F.size(own) / F.lit(size)).cast("int")
        slices = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(own, k * size + 1, F.lit(size)))
        return F.when(F.size(own) > 0, slices).otherwise(F.slice(F.array(own), 1, 0))

    return let(values, cut)


def running(values: Column, combine: Callable[[Column, Column], Column], start: Column, kind: str) -> Column:
    """For each entry the combination of ``start`` and all entries before it; ``combine`` is associative.

    Entries are gathered part by part, and the parts' totals after that, since adding an entry copies the array.
    """

    def within(entries: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(entries, state, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(each: Column) -> Column:
        begins = within(F.transform(each, lambda p: p["at"]), start)
        return F.flatten(F.zip_with(each, begins["out"], lambda p, b: F.transform(p["out"], lambda x: combine(b, x))))

    return let(F.transform(parts(values), lambda p: within(p, start)), joined)


def text_parts(text: Column) -> Column:
    """The text in strings of ``TEXT_PART`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_PART}}}+"), F.lit(0))


def text_between(cut: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` (from 0) to ``end`` (exclusive) of a text given by its text_parts()."""
    first = F.floor(begin / F.lit(TEXT_PART)).cast("int")
    last = F.floor((end - 1) / F.lit(TEXT_PART)).cast("int")
    near = F.array_join(F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > begin, F.substring(near, begin - first * TEXT_PART + 1, end - begin)).otherwise(F.lit(""))
