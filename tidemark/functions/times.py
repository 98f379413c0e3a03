"""Instants, calendar keys, validity intervals and period labels, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all

_RFC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def parse_instant(c: Column) -> Column:
    """RFC 3339, or a bare date as its UTC midnight; anything else is null. Microseconds are kept."""
    t = trim_all(c)
    return F.when(t.rlike(_RFC), F.upper(t).try_cast("timestamp")).when(t.rlike(_DAY), F.concat(t, F.lit("T00:00:00Z")).try_cast("timestamp"))


def format_instant(c: Column) -> Column:
    """RFC 3339 in UTC, with 0, 3 or 6 digits of a fraction as needed (the session's zone must be UTC)."""
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("bigint").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("Z"))


def compact_day(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6


def calendar_key(c: Column, every: str) -> Column:
    """Struct (year, part): day of year, ISO week with its year, month, quarter, or the year alone."""
    year = {"weekly": F.extract(F.lit("YEAROFWEEK"), c)}.get(every, F.year(c))
    part = {"daily": F.dayofyear(c), "weekly": F.weekofyear(c), "monthly": F.month(c), "quarterly": F.quarter(c), "annual": F.lit(0)}[every]
    return F.struct(year.cast("int").alias("year"), part.cast("int").alias("part"))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Whether ``at`` lies in [start, end); a null end is open."""
    return (at >= start) & (end.isNull() | (at < end))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e1.isNull() | (s2 < e1)) & (e2.isNull() | (s1 < e2))


def period(label: Column) -> Column:
    """Struct (kind, year, quarter, month, day, start, end) of FY2027, FY2027Q3, CY2024, CY2024Q4, 2027-03 or 2027-03-14; null
    for others. Fiscal periods have no calendar span; ends are exclusive."""
    g = lambda p, i: F.nullif(F.regexp_extract(label, p, i), F.lit("")).cast("int")
    year_p, month_p = r"^(FY|CY)([0-9]{4})(?:Q([1-4]))?$", r"^([0-9]{4})-(0[1-9]|1[0-2])(?:-(0[1-9]|[12][0-9]|3[01]))?$"
    kind = F.nullif(F.regexp_extract(label, year_p, 1), F.lit(""))
    year, quarter = F.coalesce(g(year_p, 2), g(month_p, 1)), g(year_p, 3)
    month, day = g(month_p, 2), g(month_p, 3)
    date = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp") else F.make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))
    first = F.when(kind == "FY", F.lit(None)).otherwise(date(year, F.coalesce(month, (quarter - 1) * 3 + 1, F.lit(1)), F.coalesce(day, F.lit(1))))
    months = F.when(month.isNotNull(), 1).when(quarter.isNotNull(), 3).otherwise(12)
    end = F.when(day.isNotNull(), first + F.expr("INTERVAL 1 DAY")).otherwise(F.add_months(first, months).cast("timestamp"))
    fits = label.rlike(year_p) | (label.rlike(month_p) & first.isNotNull())
    name = F.coalesce(kind, F.when(day.isNotNull(), "DAY").otherwise("MONTH"))
    return F.when(fits, F.struct(name.alias("kind"), year.alias("year"), quarter.alias("quarter"), month.alias("month"), day.alias("day"), first.alias("start"), F.when(first.isNotNull(), end).alias("end")))


MICROS_MAX, MICROS_MIN = (1 << 63) - 1, -(1 << 63)


def plus(instant: Column, micros: Column | int) -> Column:
    """An instant so many microseconds later (earlier, if below 0); null beyond what an instant holds."""
    micros = micros if isinstance(micros, Column) else F.lit(micros).cast("bigint")
    return F.timestamp_micros(F.try_add(F.unix_micros(instant), micros))


def since(later: Column, earlier: Column) -> Column:
    """Microseconds between two instants, held at the ends of a long."""
    a, b = F.unix_micros(later), F.unix_micros(earlier)
    return F.coalesce(F.try_subtract(a, b), F.when(a > b, F.lit(MICROS_MAX)).otherwise(F.lit(MICROS_MIN)))


def seconds(micros: Column) -> Column:
    return micros / 1e6


def days(micros: Column) -> Column:
    return micros / 86_400e6


def last_week(day: Column) -> Column:
    """Struct (start, end) of the last whole week before a day, Monday to Monday; the end is exclusive."""
    monday = F.date_trunc("week", day).cast("date")
    return F.struct(F.date_sub(monday, 7).alias("start"), monday.alias("end"))


def previous_period(year: Column, index: Column, per_year: int) -> Column:
    """Struct (year, index) of the period before, numbered from 1 to ``per_year`` within a year."""
    return back(year, index, per_year, 1)


def next_period(year: Column, index: Column, per_year: int) -> Column:
    return F.struct((year + (index >= per_year).cast("int")).alias("year"), F.when(index < per_year, index + 1).otherwise(F.lit(1)).alias("index"))


def year_before(year: Column, index: Column) -> Column:
    return F.struct((year - 1).alias("year"), index.alias("index"))


def back(year: Column, index: Column, per_year: int, steps: Column | int) -> Column:
    """So many periods before."""
    at = year * per_year + index - 1 - steps
    return F.struct(F.floor(at / per_year).cast("int").alias("year"), (F.pmod(at, F.lit(per_year)) + 1).cast("int").alias("index"))
