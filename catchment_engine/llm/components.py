"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node in it.

    Alternates large-star and small-star steps (each node's larger neighbours, then its
    smaller ones, are tied to its smallest neighbour) until only stars are left: a number
    of rounds that grows as the logarithm of the longest path. Edges are written to shared
    storage after each round; no neighbourhood is collected: minima are combined before
    the shuffle, and a hot node's edges are a skewed join's.
    """
    spark = edges.sparkSession
    path = new_path(spark, "components")
    now = stage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v"), "components", path)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v > u").join(smallest, F.col("u") == F.col("x")).select(F.col("m").alias("u"), "v").where("u <> v")
        # Small star: v's smaller neighbours and v itself are tied to the smallest of them.
        middle = new_path(spark, "components")
        large = stage(large, "components", middle)
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("x"), "m")
        small = large.join(least, F.col("v") == F.col("x")).select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.*")
        after = new_path(spark, "components")
        now = stage(small.where("u <> v").distinct(), "components", after)
        drop_path(spark, path)
        drop_path(spark, middle)
        path = after
        # Only stars are left if no node has two parents or a parent that has one.
        if not now.groupBy("v").count().where("count > 1").head(1) and not now.join(now.select(F.col("v").alias("x")), F.col("u") == F.col("x"), "left_semi").head(1):
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
