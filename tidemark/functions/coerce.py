"""Strict scalar coercions and lossless inference of CSV fields, as expressions. What cannot be coerced is null; ``strict``
versions are had by wrapping with ``required``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, number_text, shortest_digits, trim_all

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_JSON_PLAIN = r"^-?(0|[1-9][0-9]*)\.(0|[0-9]*[1-9])$"
_JSON_POWER = r"^-?[1-9](\.[0-9]*[1-9])?e-?[1-9][0-9]*$"
MAX, MIN = (1 << 63) - 1, -(1 << 63)


def required(c: Column, source: Column, target: str) -> Column:
    return F.when(c.isNull() & source.isNotNull(), F.raise_error(F.concat(F.lit(f"INVALID_INPUT: no {target}: "), source.cast("string")))).otherwise(c)


def to_text(c: Column) -> Column:
    """Scalar text between double quotes; quotes inside stay as they are."""
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def number_to_text(c: Column) -> Column:
    return F.concat(F.lit('"'), number_text(c), F.lit('"'))


def nested_to_text(c: Column) -> Column:
    """Compact JSON of an array or struct between double quotes, inner quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.to_json(c), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _double(text: Column) -> Column:
    t = trim_all(text)
    named = F.lower(F.regexp_replace(t, r"^\+", ""))
    return F.when(t.rlike(_NUMBER), t.try_cast("double")).when(named.isin("inf", "infinity"), F.lit(float("inf"))).when(named.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(named.isin("nan", "-nan"), F.lit(float("nan")))


def _whole(d: Column) -> Column:
    """Half away from zero, held at the ends of a long; NaN is 0."""
    r = F.when(d < 0, F.ceil(d - 0.5)).otherwise(F.floor(d + 0.5))
    exact = F.when(F.abs(d) >= 4503599627370496.0, d.try_cast("bigint")).otherwise(r)
    return F.when(F.isnan(d), F.lit(0).cast("bigint")).when(d >= 9.2e18, F.coalesce(d.try_cast("bigint"), F.lit(MAX))).when(d <= -9.2e18, F.coalesce(d.try_cast("bigint"), F.lit(MIN))).otherwise(exact)


def text_to_integer(c: Column) -> Column:
    t = trim_all(c)
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), _whole(_double(c)))


def number_to_integer(c: Column) -> Column:
    return _whole(c.cast("double"))


def boolean_to_integer(c: Column) -> Column:
    return c.cast("int").cast("bigint")


def text_to_number(c: Column) -> Column:
    """Plain decimal text of the number that a text is; finite only."""
    d = _double(c)
    return F.when(F.abs(d) < float("inf"), number_text(d))


def text_to_boolean(c: Column) -> Column:
    t = F.lower(trim_all(c))
    return F.when(t.isin("true", "1", "yes", "on", "1.0"), True).when(t.isin("false", "0", "no", "off", "0.0"), False)


def number_to_boolean(c: Column) -> Column:
    return F.when(c == 1, True).when(c == 0, False)


def to_object(c: Column, source_type: str) -> Column:
    return F.to_json(F.struct(F.lit(source_type).alias("source_type"), c.alias("value")))


def infer_csv(field: Column) -> Column:
    """JSON text of a CSV field: null if empty, a number or boolean only where it prints back identically, else a string.

    A decimal prints back if it has JSON's form for its size and no digits to spare. Up to 15 digits always name one double and
    no shorter number does; beyond, and below 1e-300, they are compared with the digits of the double."""
    digits = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[eE].*$", ""), r"[-.]", ""), r"^0+|0+$", "")

    def printed(f: Column, d: Column) -> Column:
        size = F.abs(d)
        held = (size >= 1e-5) & (size < 1e16)
        form = F.when(f.contains("e"), ~held & (size > 0) & (size < float("inf"))).otherwise(held | f.isin("0.0", "-0.0"))
        few = (F.length(digits(f)) <= 15) & ((size == 0) | (size >= 1e-300))
        return form & F.when(few, True).otherwise(digits(f) == shortest_digits(d))

    f = field
    whole = F.when(f.rlike(r"^(0|-?[1-9][0-9]*)$") & f.try_cast("bigint").isNotNull(), f)
    real = F.when(f.rlike(_JSON_PLAIN) | f.rlike(_JSON_POWER), bound(f.try_cast("double"), lambda d: F.when(printed(f, d), f)))
    return F.when(f.isNull() | (f == ""), "null").otherwise(F.coalesce(whole, real, F.when(f.isin("true", "false"), f), json_string(f)))


def json_string(f: Column) -> Column:
    """The JSON of a text."""
    shown = F.to_json(F.struct(f.alias("v")))
    return F.substring(shown, F.lit(6), F.length(shown) - 6)
