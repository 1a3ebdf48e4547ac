"""Connected components of a link table, on the executors: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, shared_dir, stored


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the least node of it) of every node that a link (a, b) has.

    Each round hangs a node's larger neighbours, and then its smaller ones, on its least
    neighbour, until stars are left; rounds grow with the logarithm of the nodes. Minima are
    combined before the shuffle, so the hub of a large star is one row a task. Each round ends
    in files of the shared folder.
    """
    spark = links.sparkSession
    distinct = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    old = None
    path = shared_dir(spark, "stars")
    edges = stored(distinct, path)
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(under.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, path = path, shared_dir(spark, "stars")
        edges = stored(stars, path)
        remove(spark, old)
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
