"""Claims that clash: forecasts about where one number will stand, each at or above (``up``) or at or below a level, or strictly
so, and how likely that was called, in basis points.

Of two claims on a subject, one may imply the other, exclude it, or cover with it every place where the number can stand. All
three are comparisons on one line: put a claim upwards at 2 x level, and one step further if it is strict, and a claim
downwards at 2 x level + 1, and one step back if it is strict. Then a claim upwards implies those upwards at or before it, and
a claim downwards those downwards at or behind it; one upwards excludes the claims downwards at or before it, and covers with
those at or behind it. So running extremes of likelihood in the order of that line say whether a claim clashes with any
other, without a pair of claims ever being made. Subjects may hold any number of claims: rows are sorted by range of
(subject, place), the extremes of a range are carried to the ranges before and behind it, and no task sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import refuse_when
from ..scratch import held

CERTAIN = 10_000


def clashes(claims: DataFrame) -> DataFrame:
    """``claims`` (subject, up, strict, level, bps, and more columns) with what each claim is up against, and four flags:

    - ``least_implied``, ``too_likely``: it can't happen without a claim that is called less likely;
    - ``most_implying``, ``too_unlikely``: a claim that can't happen without it is called likelier;
    - ``most_excluded``, ``too_much``: with a claim that can't happen beside it, it is called more than certain;
    - ``least_covering``, ``too_little``: with a claim of which one of the two must happen, less than certain.

    Likelihoods over 10,000 count as 10,000; missing parts and negative likelihoods refuse. All claims of a subject are taken to
    be about the same moment.
    """
    up, strict = F.col("up"), F.col("strict").cast("bigint")
    place = F.when(up, 2 * F.col("level") + strict).otherwise(2 * F.col("level") + 1 - strict)
    bad = F.isnull("subject") | F.isnull("up") | F.isnull("strict") | F.isnull("level") | F.isnull("bps") | (F.col("bps") < 0)
    sound = refuse_when(bad, "INVALID_INPUT", "a claim has a subject, a side, a level and a likelihood of 0 or more", F.least("bps", F.lit(CERTAIN)))
    rows = claims.withColumns({"__p": sound, "__at": place})
    rows = rows.withColumns({"__up": F.when(up, F.col("__p")), "__down": F.when(~up, F.col("__p"))})
    kept = held(rows.repartitionByRange("subject", "__at").withColumn("__range", F.spark_partition_id()), "claims")
    sides = [(f, c) for f in ("min", "max") for c in ("__up", "__down")]
    of = lambda f, c: getattr(F, f)(c)
    ends = kept.groupBy("subject", "__range").agg(*(of(f, c).alias(f + c) for f, c in sides))
    whole = Window.partitionBy("subject").orderBy("__range")
    before, behind = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("subject", "__range", *(of(f, f + c).over(w).alias(f"{n}_{f}{c}") for f, c in sides for n, w in (("before", before), ("behind", behind))))
    inside = Window.partitionBy("__range", "subject").orderBy("__at")
    until, since = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(0, Window.unboundedFollowing)

    def extreme(f: str, c: str, side: str) -> Column:
        here = of(f, c).over(until if side == "before" else since)
        return (F.least if f == "min" else F.greatest)(here, F.col(f"{side}_{f}{c}"))  # both skip nulls

    both = kept.join(carried, ["subject", "__range"])
    p = F.col("__p")
    found = both.withColumns(
        {
            "least_implied": F.when(up, extreme("min", "__up", "before")).otherwise(extreme("min", "__down", "behind")),
            "most_implying": F.when(up, extreme("max", "__up", "behind")).otherwise(extreme("max", "__down", "before")),
            "most_excluded": F.when(up, extreme("max", "__down", "before")).otherwise(extreme("max", "__up", "behind")),
            "least_covering": F.when(up, extreme("min", "__down", "behind")).otherwise(extreme("min", "__up", "before")),
        }
    )
    flags = {"too_likely": F.col("least_implied") < p, "too_unlikely": F.col("most_implying") > p, "too_much": F.col("most_excluded") + p > CERTAIN, "too_little": F.col("least_covering") + p < CERTAIN}
    named = ["least_implied", "most_implying", "most_excluded", "least_covering"]
    return found.select(*claims.columns, *named, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
