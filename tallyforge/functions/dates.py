"""Dates: normalising of printed dates and strict parsing by declared formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import YEAR_MAX, YEAR_MIN
from .text import trim_ws

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
TOLERANT = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%d/%m/%y", "%d-%m-%y", "%d %b %y")
PERIOD = ("%d %b %Y", "%d %b %y", "%d/%m/%Y", "%d/%m/%y", "%Y-%m-%d")


def normalise(x: Column) -> Column:
    """Drop the weekday, ordinal endings and "of"; September in three letters; one space between parts."""
    s = trim_ws(x.cast("string"))
    s = F.regexp_replace(s, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    s = F.regexp_replace(s, r"(?i)(?<=[0-9])(st|nd|rd|th)\b", "")
    s = F.regexp_replace(s, r"(?i)\bof\b", "")
    s = F.regexp_replace(s, r"(?i)\bsept\b", "Sep")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def canonical(x: Column) -> Column:
    """One spelling for every way of writing a date's parts: months in three letters, apart from the digits."""
    s = normalise(x)
    s = F.regexp_replace(s, rf"(?i)\b({MONTHS})[a-z]*", "$1")
    s = F.regexp_replace(s, rf"(?i)(?<=[0-9])(?=({MONTHS}))", " ")
    s = F.regexp_replace(s, rf"(?i)(?<=({MONTHS}))(?=[0-9])", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


#: What each part of a declared format stands for, as a pattern and in Spark's letters.
PARTS = {"%d": ("[0-9]{1,2}", "d"), "%m": ("[0-9]{1,2}", "M"), "%Y": ("[0-9]{4}", "yyyy"), "%y": ("[0-9]{2}", "yy"), "%b": ("[A-Za-z]{3}", "MMM"), "%B": ("[A-Za-z]{3}", "MMM")}


def _split(fmt: str) -> list[str]:
    """The parts of a declared format, months set apart as `canonical` sets them."""
    out: list[str] = []
    for part in re.findall("%.|.", fmt, re.S):
        if out and {out[-1], part} & {"%b", "%B"} and out[-1] in PARTS and part in PARTS:
            out.append(" ")
        out.append(part)
    return out


def shape(fmt: str) -> str:
    return "^" + "".join(PARTS[p][0] if p in PARTS else re.escape(p) for p in _split(fmt)) + "$"


def java_format(fmt: str) -> str:
    """A declared format in Spark's letters."""
    return "".join(PARTS[p][1] if p in PARTS else f"'{p}'" if p.isalpha() else p for p in _split(fmt))


def _once(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _read(s: Column, fmt: str) -> Column:
    """The date of a canonical text: only a text of the format's shape is parsed. Two-digit years from 69 on are in the 1900s."""
    day = F.when(s.rlike(shape(fmt)), F.try_to_timestamp(s, F.lit(java_format(fmt)))).cast("date")
    if "%y" in fmt:
        day = _once(day, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
    return _once(day, lambda d: F.when(F.year(d).between(YEAR_MIN, YEAR_MAX), d))


def strict(x: Column, fmt: str) -> Column:
    """The date that the whole text gives in one format, within the years 1990 to 2100; else null."""
    return _once(canonical(x), lambda s: _read(s, fmt))


def parse(x: Column, fmt: str) -> Column:
    """ISO text of a printed date, null where it can't be read."""
    return F.when(trim_ws(x) != "", F.date_format(strict(x, fmt), "yyyy-MM-dd"))


def first_format(x: Column, formats: Sequence[str]) -> Column:
    """The first of the formats that fits; for one value. See `column_format` for a whole column."""
    return _once(canonical(x), lambda s: F.coalesce(*(_read(s, f) for f in formats)))


def tolerant(x: Column) -> Column:
    return first_format(x, TOLERANT)


def period_date(x: Column) -> Column:
    return first_format(x, PERIOD)


def column_format(x: Column, formats: Sequence[str]) -> Column:
    """Aggregate: the first format that reads every filled cell of a group, null if none does. One format needs no proof."""
    if len(formats) == 1:
        return F.first(F.lit(formats[0]))
    return fitting(x, formats)


def distinct_formats(formats: Sequence[str]) -> list[str]:
    """The formats without those that an earlier one reads alike: months are in three letters by then, however declared."""
    seen: dict[str, str] = {}
    for f in formats:
        seen.setdefault(java_format(f), f)
    return list(seen.values())


def readable(x: Column, formats: Sequence[str]) -> Column:
    """For one value: which of the formats read it. One without a year is tried with a leap year."""

    def reads(s: Column, f: str) -> Column:
        return (_read(s, f) if "%Y" in f or "%y" in f else _read(F.concat(s, F.lit(" 2000")), f"{f} %Y")).isNotNull()

    return _once(canonical(x), lambda s: F.array(*(reads(s, f) for f in formats)))


def fitting(x: Column, formats: Sequence[str], unless_empty: bool = False) -> Column:
    """Aggregate: the first format that fits all filled cells. Without a filled cell: the first, or null with `unless_empty`."""
    fits = F.when(F.coalesce(trim_ws(x) != "", F.lit(False)), readable(x, formats))
    all_fit = [F.bool_and(F.get(fits, F.lit(i))) for i in range(len(formats))]
    return F.coalesce(*(F.when(ok if unless_empty else F.coalesce(ok, F.lit(True)), F.lit(f)) for ok, f in zip(all_fit, formats)))


def with_year(x: Column, years: Column, start: Column, end: Column, fmt: str) -> Column:
    """A date without a year, given the years of its period: the first that falls inside it, else the first that reads."""
    dates = F.transform(years, lambda y: strict(F.concat_ws(" ", x, y.cast("string")), f"{fmt} %Y"))
    inside = F.filter(dates, lambda d: d.isNotNull() & F.coalesce(d >= start, F.lit(True)) & F.coalesce(d <= end, F.lit(True)))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)))


def excel_serial(x: Column) -> Column:
    """A spreadsheet's day number as a date; the time of day is cut off."""
    n = x.try_cast("double")
    return F.when((n > 20000) & (n < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def week(x: Column) -> Column:
    return F.date_trunc("week", x).cast("date")


def month(x: Column) -> Column:
    return F.date_trunc("month", x).cast("date")
