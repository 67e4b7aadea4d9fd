"""Connected components by alternating stars; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node reachable.

    Large stars join a node's greater neighbours to its least one, small stars its lesser ones; the edges
    come to rest as stars around the least nodes after a logarithmic number of rounds. Nulls and loops are left out.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "stars")
    while True:
        before = _mark(now)
        if before[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(now, "stars")
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        ends = now.join(least, "u")
        now = ends.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(now, "stars")
        if _mark(now) == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(2**40 - 1))).alias("h")).first()
    return row.n, row.h or 0
