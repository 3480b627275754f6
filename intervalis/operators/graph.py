"""Connected components over an edge table, in rounds of star contraction.

Every round is two aggregations and two joins over the edge table; no node's
neighbourhood is gathered in one row, so hubs are split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.plans.scratch import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Null ends and self loops are ignored; nodes without an edge do not appear.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("s"), F.col(dst).alias("d"))
    now = now.filter("s is not null and d is not null and u <> v").select("u", "v")
    now = materialize(now.distinct(), "cc")
    before = _signature(now)
    while True:
        now = materialize(_small_star(_large_star(now)), "cc")
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
