"""Forecast arithmetic in whole basis points, as integer expressions: nothing is rounded through floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 10_000
EVEN = 2_500  # the Brier score of always saying 50 %


def floor_div(a: Column, b: Column | int) -> Column:
    """Division that rounds down, for b above 0 (``div`` rounds towards zero)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def likelihood(bps: Column) -> Column:
    return F.when(bps.isNotNull(), F.least(bps.cast("bigint"), F.lit(FULL)))


def from_probability(p: Column) -> Column:
    return F.round(p * FULL).cast("bigint")


def brier(bps: Column, came_true: Column) -> Column:
    miss = F.when(came_true, FULL - likelihood(bps)).otherwise(likelihood(bps))
    return floor_div(miss * miss, FULL)


def tenth(bps: Column) -> Column:
    return F.least(floor_div(bps, 1000), F.lit(9).cast("bigint"))


def skill(mean: Column) -> Column:
    """How far below the even score, in basis points of it; 0 at it or above."""
    return floor_div((EVEN - F.least(mean, F.lit(EVEN).cast("bigint"))) * FULL, EVEN)


def base_rate(held: Column, n: Column) -> Column:
    return F.when(n > 0, floor_div(F.least(held, n) * FULL, F.greatest(n, F.lit(1))))


def as_forecast(bps: Column) -> Column:
    return F.when(bps.isNotNull(), F.greatest(F.least(bps, F.lit(9_900).cast("bigint")), F.lit(100).cast("bigint")))


def recalibrated(said: Column, came: Column, scored: Column, counts_as: int = 5) -> Column:
    """What was said, counted as ``counts_as`` forecasts that went as said, together with the record."""
    whole = F.greatest(scored + counts_as, F.lit(1))
    return F.when(scored + counts_as == 0, likelihood(said)).otherwise(floor_div(F.least(came, scored) * FULL + counts_as * likelihood(said), whole))


def settle(window: str, due: Column, satisfied: Column) -> Column:
    """open, came_true, did_not or void, from the observations (array of booleans in time order)."""
    n = F.size(satisfied)
    if window == "any_time":
        return F.when(F.exists(satisfied, lambda x: x), "came_true").when(~due, "open").when(n == 0, "void").otherwise("did_not")
    last = F.try_element_at(satisfied, F.lit(-1))
    return F.when(~due, "open").when(n == 0, "void").when(last, "came_true").otherwise("did_not")


def alike(now: Column, then: Column) -> Column:
    return F.signum(now) == F.signum(then)


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")
