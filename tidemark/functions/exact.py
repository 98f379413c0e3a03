"""Whole numbers of any size in expressions, for comparisons whose products do not fit 38 digits.

A number is an array of limbs in base 10 ** 8, lowest first. All limbs but the last lie in 0 .. base - 1; the last one carries
the sign (0 or -1 after an operation). Products and sums are made limb by limb and carried once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decisions import floor_div

BASE = 10**8
_LIMBS = "array<bigint>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _carried(limbs: Column) -> Column:
    """Limbs of any size and sign in their ranges; two more of them take what a limb of 64 bits can carry on."""
    start = F.struct(F.array().cast(_LIMBS).alias("out"), F.lit(0).cast("bigint").alias("carry"))

    def step(acc: Column, limb: Column) -> Column:
        return bound(limb + acc["carry"], lambda v: F.struct(F.array_append(acc["out"], F.pmod(v, F.lit(BASE))).alias("out"), floor_div(v, BASE).alias("carry")))

    padded = F.concat(limbs, F.array(F.lit(0), F.lit(0)).cast(_LIMBS))
    return F.aggregate(padded, start, step, lambda acc: F.array_append(acc["out"], acc["carry"]))


def number(x: Column) -> Column:
    """A number of a whole column: null stays null."""
    return F.when(x.isNotNull(), _carried(F.array(x.cast("bigint"))))


def plus(a: Column, b: Column, times: int = 1) -> Column:
    """a + times * b, for a small factor."""
    zero = F.lit(0).cast("bigint")
    return _carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + times * F.coalesce(y, zero)))  # null where either is


def minus(a: Column, b: Column) -> Column:
    return plus(a, b, -1)


def _product(a: Column, b: Column) -> Column:
    def at(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(a, i) * F.when(k >= i, F.coalesce(F.get(b, k - i), F.lit(0))).otherwise(0))

    return _carried(F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), at))


def times(*factors: Column) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = bound(F.struct(out.alias("a"), f.alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), _product(x["a"], x["b"])))
    return out


def negative(a: Column) -> Column:
    return F.element_at(a, -1) < 0


def less(a: Column, b: Column) -> Column:
    return negative(minus(a, b))


def over(a: Column, by: Column) -> Column:
    """a div by as decimal(38, 0), rounded down, for an ``a`` of 0 or more whose quotient fits, and a ``by`` of 1 to 10 ** 10."""
    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("q"), F.lit(0).cast("bigint").alias("r"))

    def step(acc: Column, limb: Column) -> Column:
        whole = lambda v: F.struct((acc["q"] * F.lit(BASE) + floor_div(v, by)).cast("decimal(38,0)").alias("q"), F.pmod(v, by).alias("r"))
        return bound(acc["r"] * BASE + limb, whole)

    return F.aggregate(F.reverse(a), start, step, lambda acc: acc["q"])
