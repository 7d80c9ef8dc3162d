"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star steps. Each round is two combined aggregates and two joins on the node, written to the shared folder; about log(diameter) rounds. A hub's neighbours are never gathered: only their minimum is, and the join on a hub may be split. One count and one hash per round come to the driver.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u hang on the smallest neighbour of u
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large-star")
        # small star: the smaller neighbours of u, and u, hang on the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
