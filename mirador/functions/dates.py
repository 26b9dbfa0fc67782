"""Dates of events written in Spanish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import text

# How dates are written.
_LABELLED = r"(?iu)fecha\s+de\s+{}\s*:\s*(?:[\p{{L}}\p{{N}}_]+,\s*)?(\d{{1,2}})\s+de\s+([\p{{L}}\p{{N}}_]+)[,\s]+(\d{{4}})\s*[-–]\s*(\d{{1,2}}:\d{{2}})"
_ISO = r"\b(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?)\b"
_RANGE = r"(?iu)del?\s+(\d{1,2})\s+de\s+([\p{L}\p{N}_]+)\s+al?\s+(\d{1,2})\s+de\s+([\p{L}\p{N}_]+)(?:\s+de\s+(\d{4}))?"
_SINGLE = r"(?iu)\b(\d{1,2})\s+de\s+([\p{L}\p{N}_]+)\s+de\s+(\d{4})\b"


def month(name: Column) -> Column:
    """Number of a month's name; null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, dims.MONTHS)), F.lower(name)), F.lit(0).cast("bigint"))


def _iso(day: Column, month_: Column, year: Column, time: Column | None = None) -> Column:
    """Null if the month is unknown."""
    clock = F.lit("00:00") if time is None else time
    return F.when(month_.isNotNull(), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month_.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("int").cast("string"), 2, "0"), F.lit("T"), clock, F.lit(":00")))


def guessed_year(day: Column, month_: Column, as_of: Column) -> Column:
    """The year of ``as_of``, or the next if the day is past; null for a day that the month lacks."""
    this = F.try_to_date(F.concat_ws("-", F.year(as_of), F.lpad(month_.cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0")))
    return F.when(this.isNotNull(), F.year(as_of) + F.when(this < as_of, 1).otherwise(0))


def event_dates(c: Column, as_of: Column) -> Column:
    """struct(start, end): labelled dates, else ISO dates as written, else a range, else a single date; '' if none.

    Where a range has no year, the first year 20xx before it counts, else the next such day from ``as_of`` on.
    """
    t = text(c)
    pick = lambda p, g: F.regexp_extract(t, p, g)

    def labelled(word: str) -> Column:
        p = _LABELLED.format(word)
        return F.when(F.rlike(t, F.lit(p)), _iso(pick(p, 1), month(pick(p, 2)), pick(p, 3), pick(p, 4)))

    begin, finish = labelled("inicio"), labelled("fin")
    isos = F.regexp_extract_all(t, F.lit(_ISO), 1)
    m1, m2 = month(pick(_RANGE, 2)), month(pick(_RANGE, 4))
    before = F.regexp_extract(F.get(F.split(t, _RANGE, 2), F.lit(0)), r"\b(20\d{2})\b", 1)
    year = F.coalesce(F.nullif(pick(_RANGE, 5), F.lit("")), F.nullif(before, F.lit("")), guessed_year(pick(_RANGE, 1), F.coalesce(m1, F.lit(1)), as_of).cast("string"))
    span = F.rlike(t, F.lit(_RANGE)) & m1.isNotNull() & m2.isNotNull()
    single = F.when(F.rlike(t, F.lit(_SINGLE)), _iso(pick(_SINGLE, 1), month(pick(_SINGLE, 2)), pick(_SINGLE, 3)))
    both = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    rules = [
        (begin.isNotNull() | finish.isNotNull(), both(text(begin), F.coalesce(finish, begin))),
        (F.size(isos) >= 1, both(F.get(isos, F.lit(0)), F.coalesce(F.get(isos, F.lit(1)), F.get(isos, F.lit(0))))),
        (span, both(text(_iso(pick(_RANGE, 1), m1, year)), text(_iso(pick(_RANGE, 3), m2, year)))),
        (single.isNotNull(), both(single, single)),
    ]
    first = F.when(*rules[0])
    return reduce(lambda w, r: w.when(*r), rules[1:], first).otherwise(both(F.lit(""), F.lit("")))
