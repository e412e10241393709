"""Dates of birth: tolerant parsing and levels of agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import clean


def parse_date(c: Column | str) -> Column:
    """Date of the first ten characters; null if they are none. Never throws."""
    s = F.substring(clean(c), 1, 10)
    return F.coalesce(s.try_cast("date"), F.try_to_timestamp(s, F.lit("M/d/yyyy")).cast("date"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))


def iso_date(c: Column | str) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def _near_year(a: Column, b: Column) -> Column:
    return (F.month(a) == F.month(b)) & (F.dayofmonth(a) == F.dayofmonth(b)) & (F.abs(F.year(a) - F.year(b)) == 1)


def _near_day(a: Column, b: Column) -> Column:
    return (F.year(a) == F.year(b)) & (F.month(a) == F.month(b)) & (F.abs(F.dayofmonth(a) - F.dayofmonth(b)) == 1)


def _swapped(a: Column, b: Column) -> Column:
    return (F.year(a) == F.year(b)) & (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b))


def dob_level(a: Column, b: Column) -> Column:
    """missing, exact, near or disagree, for parsed dates; a day apart is near within one month only."""
    near = _near_year(a, b) | _near_day(a, b) | _swapped(a, b)
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "exact").when(near, "near").otherwise("disagree")


def dob_relation(a: Column, b: Column) -> Column:
    """exact, transpose, off_day, off_year or other; null if either is missing."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, "exact").when(_swapped(a, b), "transpose").when(_near_day(a, b), "off_day").when(_near_year(a, b), "off_year").otherwise("other")


def decade(c: Column) -> Column:
    return (F.floor(F.year(c) / 10) * 10).cast("int")
