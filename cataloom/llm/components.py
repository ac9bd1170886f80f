"""Connected components by alternating large and small stars; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import drop, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)`` that isn't its component's smallest node.

    Large star: a node hands its larger neighbours its smallest neighbour. Small star: a node hands its smaller neighbours
    the smallest of them. Both keep components; together they end in stars after a logarithmic number of rounds. Minima are combined
    before the shuffle, so hubs cost no more than other nodes there; the joins that hand them out bring a hub's edges together, and are
    left to Spark's splitting of skewed partitions.
    """
    spark = edges.sparkSession
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(ordered, "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = written(small, "edges")
        drop(spark, path, large_path)
        now, path = after, after_path
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
