"""Clashing claims against the comparison of all pairs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims

SCHEMA = "id int, subject string, up boolean, strict boolean, level bigint, bps int"


def implies(a, b):
    if a[2] != b[2]:
        return False
    return (a[3] or not b[3]) if a[4] == b[4] else (b[4] < a[4] if a[2] else a[4] < b[4])


def opposed(a, b):
    return None if a[2] == b[2] else (a, b) if a[2] else (b, a)


def excludes(a, b):
    p = opposed(a, b)
    return bool(p) and (p[1][4] < p[0][4] or p[1][4] == p[0][4] and (p[0][3] or p[1][3]))


def covers(a, b):
    p = opposed(a, b)
    return bool(p) and (p[0][4] < p[1][4] or p[0][4] == p[1][4] and not (p[0][3] and p[1][3]))


@pytest.mark.parametrize("parts", [1, 9])
def test_all_pairs(spark, parts):
    r = random.Random(parts)
    rows = [(i, "hot" if i % 3 else f"s{i % 12}", r.random() < 0.5, r.random() < 0.5, r.randint(-6, 6), r.choice([0, 2_500, 5_000, 5_001, 7_500, 10_000, 12_000])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {x.id: x for x in claims.clashes(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    p = lambda x: min(x[5], 10_000)
    for a in rows:
        near = [b for b in rows if b[1] == a[1]]
        x = got[a[0]]
        assert x.too_likely == any(implies(a, b) and p(b) < p(a) for b in near), a
        assert x.too_unlikely == any(implies(b, a) and p(a) < p(b) for b in near), a
        assert x.too_much == any(excludes(a, b) and p(a) + p(b) > 10_000 for b in near), a
        assert x.too_little == any(covers(a, b) and p(a) + p(b) < 10_000 for b in near), a
        assert x.least_implied == min(p(b) for b in near if implies(a, b))


def test_odd_claims(spark):
    assert claims.clashes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = claims.clashes(spark.createDataFrame([(1, "a", True, False, 5, 9_000)], SCHEMA)).first()
    assert (one.too_likely, one.too_unlikely, one.too_much, one.too_little, one.most_excluded) == (False, False, False, False, None)
    for bad in ((1, None, True, False, 5, 1), (1, "a", True, False, 5, -1), (1, "a", None, False, 5, 1)):
        with pytest.raises(Exception, match="INVALID_INPUT"):
            claims.clashes(spark.createDataFrame([bad], SCHEMA)).collect()


def test_many_claims_on_one_subject(spark):
    """A pair for every two of these would be ten billion rows."""
    rows = spark.range(100_000).select(
        F.col("id").cast("int"), F.lit("one").alias("subject"), (F.col("id") % 2 == 0).alias("up"), (F.col("id") % 3 == 0).alias("strict"), (F.xxhash64("id") % 50_000).alias("level"), (5_000 - F.abs(F.xxhash64("id") % 50_000) / 10).cast("int").alias("bps")
    )
    began = time.monotonic()
    out = claims.clashes(rows.where("bps >= 0"))
    assert out.count() == rows.count() and time.monotonic() - began < 60
