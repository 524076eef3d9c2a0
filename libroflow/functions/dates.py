"""Incomplete dates as text: `Y`, `Y-M`, `Y-M-D` or `start/end`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the months, February always 28.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def parse_date(c: Column) -> Column:
    """Up to three parts that are whole numbers, in order; null text gives null, an unreadable part ends the date."""
    text = F.split(F.substring_index(c, "/", 1), "-")
    y = F.get(text, F.lit(0)).try_cast("int")
    m = F.when(y.isNotNull(), F.get(text, F.lit(1)).try_cast("int"))
    d = F.when(m.isNotNull(), F.get(text, F.lit(2)).try_cast("int"))
    return F.when(c.isNotNull(), F.array_compact(F.array(y, m, d)))


def not_after(a: Column, b: Column) -> Column:
    """a <= b, part by part; a date that is the other's beginning comes first."""
    return a <= b


def _day(y: Column, m: Column, d: Column) -> Column:
    """Zero-padded; longer numbers are kept whole."""
    part = lambda c, n: F.when(c < 10 ** (n - 1), F.lpad(c.cast("string"), n, "0")).otherwise(c.cast("string"))
    return F.concat(part(y, 4), F.lit("-"), part(m, 2), F.lit("-"), part(d, 2))


def start_of(parts: Column) -> Column:
    y, m, d = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1))
    return F.when(F.size(parts) > 0, _day(y, m, d))


def end_of(parts: Column) -> Column:
    y, m = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(12))
    last = F.element_at(F.array(*[F.lit(n) for n in MONTH_DAYS]), F.greatest(F.least(m, F.lit(12)), F.lit(1)))
    d = F.coalesce(F.get(parts, F.lit(2)), last)
    return F.when(F.size(parts) > 0, _day(y, m, d))


def complete_date(c: Column, mode: str = "m") -> Column:
    """mode s: first possible day; e: last possible day; m: the range of both."""
    parts = parse_date(c)
    if mode == "s":
        return start_of(parts)
    if mode == "e":
        return end_of(parts)
    return F.concat_ws("/", start_of(parts), end_of(parts))
