"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import written


def _lowest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the smallest of u and all its v.

    The minimum is combined before the shuffle, so that a hub costs one row per
    task. The minima are written before they are joined: Spark then knows their
    size and broadcasts them below its threshold, and beyond it both sides of the
    join are plain exchanges, of which adaptive execution can split a hub's one.
    """
    lowest = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
    return pairs.join(lowest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    met = _lowest(edges)
    near = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(met.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of the component.

    Loops, repeated and reversed edges do no harm. The number of rounds grows
    with the logarithm of the component's size. Only counts reach the driver.
    """
    u, v = F.col(a), F.col(b)
    now = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = written(_small_star(written(_large_star(now), "large-star")), "star")
        after = _mark(now)
        if after == before:
            break
        before = after
    # at the end every edge leads from a node to its root
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
