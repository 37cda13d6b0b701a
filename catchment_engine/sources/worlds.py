"""Synthetic worlds that depend on a seed and keys alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import haversine_km
from ..schemas import World

#: The box that coordinates are drawn from.
LON_MIN, LAT_MIN, LON_MAX, LAT_MAX = -109.0, 37.0, -102.0, 41.0
#: Travel model: speed, least and most circuity.
KPH, CIRCUITY = 70.0, (1.0, 1.6)

_MODULUS = 2_147_483_647


def uniform(seed: int, *keys: Column | int) -> Column:
    """A number in [0, 1) from whole-number keys: linear congruential steps modulo
    2^31 - 1, in integers, so that any SQL engine gives the same."""
    state = F.lit(seed % _MODULUS + 1).cast("long")
    for k in keys:
        k = k if isinstance(k, Column) else F.lit(k)
        for _ in range(2):
            state = ((state + k.cast("long")) * 48271 + 11) % _MODULUS
    return (state * 16807 % _MODULUS) / F.lit(float(_MODULUS))


def make_world(spark: SparkSession, seed: int = 1, n_providers: int = 8, n_tracts: int = 25, isolated: int = 1, zero_pop: int = 2, duplicate_coords: bool = False) -> World:
    """Providers with supply 1..5 and tracts with population 200..9000 in the box. The last
    isolated providers stand far outside; the first zero_pop tracts have nobody; with
    duplicate_coords the second provider stands where the first does."""
    if n_providers < 1 or n_tracts < 1 or isolated > n_providers or zero_pop > n_tracts:
        raise ValueError("a world needs a provider and a tract, and no more exceptions than rows")
    k = F.col("k")
    at = F.when((k == 2) & F.lit(duplicate_coords), 1).otherwise(k)
    far = k > n_providers - isolated
    p = spark.range(1, n_providers + 1).select(F.col("id").alias("k"))
    providers = p.select(
        F.format_string("P%03d", k).alias("provider_id"),
        F.format_string("9%09d", k).alias("synth_id"),
        F.when(far, LON_MIN - 6).otherwise(LON_MIN + (LON_MAX - LON_MIN) * uniform(seed, 1, at)).alias("lon"),
        F.when(far, LAT_MIN - 4).otherwise(LAT_MIN + (LAT_MAX - LAT_MIN) * uniform(seed, 2, at)).alias("lat"),
        (1 + F.floor(5 * uniform(seed, 3, k))).cast("int").alias("supply"),
    )
    t = spark.range(1, n_tracts + 1).select(F.col("id").alias("k"))
    tracts = t.select(
        F.format_string("T%05d", k).alias("tract_id"),
        (LON_MIN + (LON_MAX - LON_MIN) * uniform(seed, 4, k)).alias("lon"),
        (LAT_MIN + (LAT_MAX - LAT_MIN) * uniform(seed, 5, k)).alias("lat"),
        F.when(k <= zero_pop, 0).otherwise(F.bround(200 + 8800 * uniform(seed, 6, k))).cast("int").alias("population"),
    )
    return World(providers, tracts, travel_matrix(providers, tracts, seed + 99), {"seed": seed})


def travel_matrix(providers: DataFrame, tracts: DataFrame, seed: int, kph: float = KPH) -> DataFrame:
    """(provider_id, tract_id, minutes, km) for every provider and tract: great-circle
    distance times a circuity drawn for the pair, over a speed. A full matrix is what is
    asked for; its size is the product of the two tables."""
    p = providers.select("provider_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    t = tracts.select("tract_id", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[^0-9]", "").try_cast("long"), F.lit(0)) % 1_000_003
    pairs = p.crossJoin(t).withColumn("km", haversine_km(F.col("plon"), F.col("plat"), F.col("tlon"), F.col("tlat")))
    low, high = CIRCUITY
    circuity = low + (high - low) * uniform(seed, number("provider_id"), number("tract_id"))
    return pairs.select("provider_id", "tract_id", (F.col("km") * circuity / F.lit(kph) * 60).alias("minutes"), "km")
