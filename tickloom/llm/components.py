"""Connected components of a large link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import store


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    down = links.join(smallest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionAll(smallest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node with a link to another; nodes are longs.

    Links may repeat, point either way or to the node itself; a link with a null end is none. Each round is stored in the
    shared folder, so a lost executor costs one round at most. Only a row count and a checksum come to the driver. The number
    of rounds grows with the logarithm of the longest chain.
    """
    current = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull())
    current = store(current.distinct())
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        current = store(_small_star(store(_large_star(current))))
