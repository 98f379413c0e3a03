"""Resampling of a stream of points: watermarked windows whose state is one aggregate per series and open period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import choice
from ..operators.series import KEY, TIME, VALUE


def resample_stream(points: DataFrame, every: str = "1 day", aggregate: str = "last", late: str = "1 day") -> DataFrame:
    """(series_id, time, value) per period of fixed length, at the last instant observed; points later than ``late`` are lost."""
    how = {"last": F.max_by(VALUE, TIME), "mean": F.avg(VALUE), "sum": F.sum(VALUE)}
    value = how[choice(aggregate, how, "aggregate")]
    held = points.withWatermark(TIME, late).groupBy(KEY, F.window(TIME, every)).agg(F.max(TIME).alias("t"), value.alias(VALUE))
    return held.select(KEY, F.col("t").alias(TIME), VALUE)
