"""Connected components of undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import pinned


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that links reach, for every node of a link.

    ``links`` has columns a and b. Large-star and small-star steps take turns:
    every node's neighbours are hung on the smallest one nearby, until nothing
    moves. A step is an aggregate with partial minima and a join; a hub is many
    narrow rows, never one task's group.
    """
    edges = pinned(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("v > u")
        .distinct()
    )
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pinned(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("v > u").distinct()
        )
        large = pinned(large)
        lowest = pinned(large.groupBy("v").agg(F.min("u").alias("m")))
        hung = large.join(lowest, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = lowest.select("v", F.col("m").alias("u")).unionByName(hung).where("v > u").distinct()
        edges = pinned(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
