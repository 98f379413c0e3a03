"""Row windows over series that are too long for one task.

Rows are sorted by range of (series, time) and written once with their places: range and row. A range takes the rows that its
windows reach back to from the ranges before it - the last ``back`` rows, over as many short ranges as hold them - and a window
then runs in each range apart, so the largest task sees one range and ``back`` rows. A row of places for each range is all
that the driver sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import held

KEY, TIME = "series_id", "time"
RANGE, BORROWED = "__range", "__borrowed"


def ranged(s: DataFrame, back: int, ranges: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """The rows of ``s`` by range, each range with the ``back`` rows before it, and the window that orders a series' rows in a
    range. Rows of the range itself have ``__borrowed`` false: keep those once the window's columns are there."""
    order = [KEY, TIME]
    spread = s.repartitionByRange(ranges, *order) if ranges else s.repartitionByRange(*order)
    kept = held(spread.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    kept = kept.withColumn(RANGE, F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    sizes = sorted(kept.groupBy(RANGE).count().collect())
    starts, total = [], 0
    for number, n in sizes:
        starts.append((number, total, n))
        total += n
    rows = []
    for i, (number, start, n) in enumerate(starts):
        # later ranges that begin within ``back`` rows of this one's end
        after = []
        for other, begin, _ in starts[i + 1 :]:
            if begin - back >= start + n:
                break
            after.append((other, begin))
        rows.append((number, start, n, after))
    places = kept.sparkSession.createDataFrame(rows, f"{RANGE} bigint, __start bigint, __n bigint, __after array<struct<r:bigint,at:bigint>>")
    ends = kept.join(F.broadcast(places), RANGE).where(F.col("__row") >= F.col("__n") - back)
    lent = ends.select(*(c for c in kept.columns if c != RANGE), F.explode(F.filter("__after", lambda x: x["at"] - back <= F.col("__start") + F.col("__row"))).alias("__to"))
    lent = lent.select(*(c for c in lent.columns if c != "__to"), F.col("__to.r").alias(RANGE), F.lit(True).alias(BORROWED))
    out = kept.withColumn(BORROWED, F.lit(False)).unionByName(lent).drop("__row")
    return out, Window.partitionBy(RANGE, KEY).orderBy(TIME)
