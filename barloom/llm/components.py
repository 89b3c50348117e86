"""Connected components by alternating large and small stars, on edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import park, unpark


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (u, v: integers, u != v).

    Every round is two grouped minima, joined back; a hub's edges join its one minimum, which Spark may split. The
    edges of each round are written to the shared folder, and only their number and checksum come to the driver.
    """
    e = park(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        then = park(small)
        unpark(e)
        e = then
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")
