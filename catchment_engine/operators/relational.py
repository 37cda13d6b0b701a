"""Small relational operators: sets, duplicates, relabelling, shuffling, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partitioning import placed


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_both, n_only_a, n_only_b, equal) of two tables of the same columns as sets: one
    union and one aggregate."""
    both = a.distinct().withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionByName(b.distinct().withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    each = both.groupBy(*a.columns).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    out = each.agg(F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("n_both"), F.count_if(F.col("__b") == 0).alias("n_only_a"), F.count_if(F.col("__a") == 0).alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def relabel(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """df with a key replaced by way of (old, new); a key without a new name fails."""
    n = names.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    new = F.when(F.col("__new").isNull(), F.raise_error(F.concat(F.lit("no new name for "), F.col(column).cast("string")))).otherwise(F.col("__new"))
    return df.join(n, F.col(column) == F.col("__old"), "left").withColumn(column, new).drop("__old", "__new")


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Rows in an order that depends on seed and keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def seeded_place(df: DataFrame, u: Column, key: str, out: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of a seeded number, ties by a key that tells
    rows apart. In two levels: no task has all rows."""
    return placed(df, [u, F.col(key)], out=out)


def scaled(df: DataFrame, column: str, factor: Column | float) -> DataFrame:
    """df with a column times a factor, widened first so that it can't overflow."""
    return df.withColumn(column, F.col(column).cast("double") * factor)


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def also_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_semi")
