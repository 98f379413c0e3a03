"""Connected components by alternating large-star and small-star steps.

Each step is a min per node and a join back to the edges, so a hub is pre-aggregated by the partial min, and its edges,
all in one join key, are split by adaptive skew handling. State lives in scratch tables, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).union(rest).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges``: two columns of one orderable type. Returns (node, component) for each node of an edge; component is the
    smallest node reachable. Nulls and self-loops link nothing; repeated edges count once; no edges give no rows."""
    a, b = (F.col(c) for c in edges.columns)
    now = scratch.save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = sign(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = scratch.save(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now, before = after, seen
        if (seen := sign(now)) == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
