"""A world derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import World


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), (1 + F.col("s_suppkey") % 5).cast("int").alias("supply"))


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tract_id"), F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("long").alias("population"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least days between order and shipment for each supplier and customer, as minutes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = F.abs(F.datediff("l_shipdate", "o_orderdate")).cast("double")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_suppkey").alias("provider_id"), F.col("o_custkey").alias("tract_id")).agg(F.min(days).alias("minutes"))


def world(spark: SparkSession, sf_dir: str) -> World:
    return World(providers(spark, sf_dir), tracts(spark, sf_dir), edges(spark, sf_dir))


def scattered(key: Column) -> tuple[Column, Column]:
    """(lon, lat) of a whole-number key, spread over the box."""
    lon = F.lit(-109.0) + F.lit(7.0) * ((key * 7919) % 10007) / F.lit(10007.0)
    lat = F.lit(37.0) + F.lit(4.0) * ((key * 104729) % 10007) / F.lit(10007.0)
    return lon, lat


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tract_id with coordinates."""
    lon, lat = scattered(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tract_id"), lon.alias("lon"), lat.alias("lat"))


def provider_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = scattered(F.col("s_suppkey") + 500_000)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider_id"), lon.alias("lon"), lat.alias("lat"))
