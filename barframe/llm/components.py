"""Connected components of undirected links, by alternating large and small stars.

Every round hangs each vertex on the smallest of its neighbours (large stars over larger neighbours,
small stars over smaller ones) until nothing moves; the number of rounds grows with the logarithm of
the longest path. Minima are summed in part before a shuffle, hot vertices are split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.session import written


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(id, component) of every vertex of `links` (columns a, b; longs without nulls), where
    component is the smallest id reachable. Loops and repeats are allowed. Raises where `most` rounds are
    not enough, rather than to return components that links still join."""
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-0"
    )
    seen = None
    for step in range(1, most + 1):
        # Large stars: all larger neighbours of u go to the least of u and its neighbours.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small stars: u and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), f"star-{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still changed after {most} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
