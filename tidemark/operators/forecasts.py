"""Settled forecasts (probability, came_true) and how they did: Brier score against saying 50 %, calibration by tenth, the split
of a record's score, and whether records differ beyond chance. The tests compare products of up to five counts as whole
numbers (``functions/exact``), so they are exact at any size of a record up to 10 ** 9 forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import decisions as D
from ..functions import exact as X


def checked(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` itself, once one pass has found it well formed and not empty."""
    p = F.col("probability")
    n, blank, off = outcomes.agg(F.count("*"), F.count_if(p.isNull() | F.col("came_true").isNull()), F.count_if(F.isnan(p) | (p < 0) | (p > 1))).first()
    if blank:
        raise Refused("NOT_OUTCOMES", f"{blank} forecasts lack a probability or an outcome", "outcomes")
    if off:
        raise Refused("NOT_A_PROBABILITY", f"{off} probabilities lie outside of 0 to 1", "outcomes")
    if not n:
        raise Refused("NOTHING_TO_SCORE", "no forecasts were given", "outcomes")
    return outcomes


def score(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by..., n, brier, even_brier, beats_even): one pass, partial sums first."""
    said = D.from_probability(F.col("probability"))
    held = outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.sum(D.brier(said, F.col("came_true"))).alias("s"))
    mean = D.floor_div(F.col("s"), F.greatest("n", F.lit(1)))
    return held.where("n > 0").select(*by, "n", (mean / 10_000).alias("brier"), F.lit(0.25).alias("even_brier"), (D.skill(mean) > 0).alias("beats_even"))


def calibration(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by..., tenth, forecasts, said, came_true): what was said on average in each tenth, and how many came true."""
    said = D.from_probability(F.col("probability"))
    held = outcomes.select(*by, said.alias("said"), "came_true").groupBy(*by, D.tenth(F.col("said")).alias("tenth"))
    out = held.agg(F.count("*").alias("forecasts"), F.sum("said").alias("s"), F.count_if("came_true").alias("came_true"))
    return out.select(*by, "tenth", "forecasts", (F.round(F.col("s") / F.col("forecasts")) / 10_000).alias("said"), "came_true")


# fixed values: forecasts that make a record; bounds in ten-thousandths for a record called calibrated, and in quarters for one
# called discerning
RECORD = 5
CALIBRATED = 100
TOLD = 4


def split(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by..., n, total, off_by, told_apart, how_hard, calibrated, discerning): the score of a record in ten-thousandths, parted into
    how far what was said was from what happened, how much it told apart, and how mixed outcomes were; each rounded down.

    Forecasts meet by what was said first (10,001 groups at most for each record), so one shuffle of partial counts serves.
    """
    said = D.from_probability(F.col("probability"))
    groups = outcomes.select(*by, said.alias("__p"), "came_true").groupBy(*by, "__p").agg(F.count("*").alias("__m"), F.count_if("came_true").alias("__c"))
    record = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a record's groups, not its forecasts
    told = groups.withColumns({"__n": F.sum("__m").over(record), "__o": F.sum("__c").over(record)})
    p, m, c, n, o = (F.col(f"__{x}") for x in "pmcno")
    miss = (c * (D.FULL - p) * (D.FULL - p) + (m - c) * p * p).cast("decimal(38,0)")
    gap = X.bound(X.number(m * p - D.FULL * c), lambda g: X.over(X.times(g, g), m))
    apart = X.bound(X.number(n * c - m * o), lambda d: X.over(X.times(d, d, X.number(F.lit(D.FULL))), m))
    whole = lambda x: F.sum(x).cast("decimal(38,0)")
    sums = told.select(*by, "__n", "__o", miss.alias("__s"), gap.alias("__g"), apart.alias("__a")).groupBy(*by, "__n", "__o").agg(whole("__s").alias("__s"), whole("__g").alias("__g"), whole("__a").alias("__a"))
    div = lambda a, b: F.call_function("div", a, b)
    wide = n.cast("decimal(10,0)")
    parts = {
        "total": div(F.col("__s"), (wide * D.FULL).cast("decimal(20,0)")),
        "off_by": div(F.col("__g"), (wide * D.FULL).cast("decimal(20,0)")),
        "told_apart": div(F.col("__a"), (wide * wide * wide).cast("decimal(38,0)")),
        "how_hard": div((o.cast("decimal(10,0)") * (n - o).cast("decimal(10,0)") * D.FULL).cast("decimal(38,0)"), (wide * wide).cast("decimal(20,0)")),
    }
    out = sums.select(*by, n.alias("n"), *(v.alias(k) for k, v in parts.items()))
    return out.withColumns({"calibrated": F.col("off_by") <= CALIBRATED, "discerning": (F.col("how_hard") > 0) & (F.col("how_hard") <= TOLD * F.col("told_apart"))})


def sureness(n: Column, came: Column, said: Column, spread: Column) -> Column:
    """untold, about, too_high or too_low: from a record's forecasts, how many came true, the sum of what was said in basis points
    and the sum of each likelihood times what it leaves of certainty. Beyond chance is more than two standard deviations."""
    over = X.bound(X.number(said - D.FULL * came), lambda d: X.less(X.times(X.number(F.lit(4)), X.number(spread)), X.times(d, d)))
    side = F.when(said > D.FULL * came, "too_high").otherwise("too_low")
    return F.when(n < RECORD, "untold").when(over, side).otherwise("about")


def apart(n1: Column, s1: Column, q1: Column, n2: Column, s2: Column, q2: Column) -> Column:
    """Whether the mean scores of two records differ by more than two standard errors: counts, sums and sums of squares of both."""

    def told(x: Column) -> Column:
        less_one = lambda n: X.minus(n, X.number(F.lit(1)))
        spread = lambda n, s, q: X.minus(X.times(n, q), X.times(s, s))
        v1 = X.times(x["n2"], x["n2"], less_one(x["n2"]), spread(x["n1"], x["s1"], x["q1"]))
        v2 = X.times(x["n1"], x["n1"], less_one(x["n1"]), spread(x["n2"], x["s2"], x["q2"]))
        ahead = X.bound(X.minus(X.times(x["s1"], x["n2"]), X.times(x["s2"], x["n1"])), lambda d: X.times(d, d, less_one(x["n1"]), less_one(x["n2"])))
        return X.less(X.times(X.number(F.lit(4)), X.plus(v1, v2)), ahead)

    given = {"n1": n1, "s1": s1, "q1": q1, "n2": n2, "s2": s2, "q2": q2}
    return (n1 >= RECORD) & (n2 >= RECORD) & X.bound(F.struct(*(X.number(v).alias(k) for k, v in given.items())), told)


def paired(n: Column, d: Column, q: Column) -> Column:
    """Whether two scores of the same forecasts differ by more than two standard errors: pairs, sum of differences and of their squares."""

    def told(x: Column) -> Column:
        square = lambda use: X.bound(X.times(x["d"], x["d"]), use)
        left = lambda dd: X.times(X.number(F.lit(4)), X.minus(X.times(x["n"], x["q"]), dd))
        return square(lambda dd: X.less(left(dd), X.times(dd, X.minus(x["n"], X.number(F.lit(1))))))

    given = {"n": n, "d": d, "q": q}
    return (n >= RECORD) & X.bound(F.struct(*(X.number(v).alias(k) for k, v in given.items())), told)


def moments(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by..., n, came, said, spread, s, q): what the tests need of each record, in one pass; s and q are the sums of the scores and of
    their squares."""
    said = D.from_probability(F.col("probability"))
    score = D.brier(said, F.col("came_true"))
    held = outcomes.select(*by, said.alias("__p"), score.alias("__b"), "came_true")
    return held.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("came_true").alias("came"),
        F.sum("__p").alias("said"),
        F.sum(F.col("__p") * (D.FULL - F.col("__p"))).alias("spread"),
        F.sum("__b").alias("s"),
        F.sum(F.col("__b") * F.col("__b")).alias("q"),
    )
