"""Column functions: keys, periods, trigrams, distances, class scores. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def drawn(*parts: Column | str | int) -> Column:
    """A whole number from 0 to 2^32 - 1, by md5 of the parts joined with |. It depends on nothing else, so draws repeat."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def natural_key(col: Column) -> Column:
    """Orders digit runs as numbers: 2020-2 before 2020-10."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))


def shifted_day(text: Column) -> Column:
    """The last two characters as a number, plus 1, without padding: day 00 becomes 1. Null where they are no number."""
    day = F.substring(text, -2, 2).try_cast("int")
    return F.concat(F.substring(text, F.lit(1), F.greatest(F.length(text) - 2, F.lit(0))), (day + 1).cast("string"))


def floored_day(text: Column) -> Column:
    """Only day 00 changes, to 01."""
    return F.regexp_replace(text, "-00$", "-01")


DAY_POLICIES: dict[str, Callable[[Column], Column]] = {"shift": shifted_day, "floor": floored_day}


def parsed_date(text: Column) -> Column:
    """Strict year-month-day; anything else is null."""
    return F.try_to_date(text, "yyyy-M-d") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyy-M-d")))


def period_year(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def period_quarter(day: Column) -> Column:
    """Year and first month of the quarter: 2020-q1, -q4, -q7, -q10."""
    return F.concat(F.date_format(day, "yyyy"), F.lit("-q"), ((F.quarter(day) - 1) * 3 + 1).cast("string"))


def period_month(day: Column) -> Column:
    """Year and unpadded month. February 29 belongs to no month."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.when(~leap, F.concat(F.date_format(day, "yyyy"), F.lit("-"), F.month(day).cast("string")))


#: Division technique by name.
PERIODS: dict[str, Callable[[Column], Column]] = {"year": period_year, "quarter": period_quarter, "month": period_month}


def trigrams(sequence: Column) -> Column:
    """All overlapping three-letter substrings, in order; none for fewer than three letters. One pass: taking substrings by position would start over for each."""
    return F.regexp_extract_all(sequence, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def context(sequence: Column, position: Column, size: int = 2) -> Column:
    """The letters up to `size` before and after a 0-based position."""
    return F.substring(sequence, position + F.lit(1 - size), F.lit(2 * size + 1))


def site_differences(a: Column, b: Column, ranges: list[tuple[int, int]]) -> Column:
    """At how many positions of the inclusive 1-based ranges two sequences differ; a position in two ranges counts twice.

    Each range is cut out of both once, and only letters of unequal pieces are compared.
    """
    pieces = F.array(*[
        F.struct(F.substring(a, F.lit(x), F.lit(y - x + 1)).alias("a"), F.substring(b, F.lit(x), F.lit(y - x + 1)).alias("b"), F.lit(y - x + 1).alias("n"))
        for x, y in ranges
    ])
    unequal = lambda p: F.size(F.filter(F.sequence(F.lit(1), p["n"]), lambda i: F.substring(p["a"], i, F.lit(1)) != F.substring(p["b"], i, F.lit(1))))
    return F.aggregate(F.filter(pieces, lambda p: p["a"] != p["b"]), F.lit(0), lambda total, p: total + unequal(p))


def site_letters(sequence: Column, ranges: list[tuple[int, int]]) -> Column:
    """The letters at the inclusive 1-based ranges, joined, as often as they are in a range; ends that a short sequence lacks are filled up."""
    return F.concat(*[F.rpad(F.substring(sequence, F.lit(x), F.lit(y - x + 1)), y - x + 1, " ") for x, y in ranges])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def top_class(scores: Column) -> Column:
    """The first class of the highest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_probability(scores: Column) -> Column:
    return F.array_max(softmax(scores))


def cross_entropy(scores: Column, label: Column) -> Column:
    """-log of the softmax of the label's score, without under- or overflow."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.log(total) + top - F.get(scores, label)


def joined_links(links: Column) -> Column:
    """Cluster numbers as text: 0-2-3; empty without any."""
    return F.array_join(F.transform(links, lambda x: x.cast("string")), "-")


def parsed_links(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, "-"), lambda x: x.cast("int")))
