"""Catchment analytics: reachability, coverage and two-step floating catchment areas.

Bands are computed in one pass: an edge is expanded to the bands that it is within.
Thresholds are inclusive. An undefined ratio stays null; an unreached tract has access 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bands import CANONICAL_BANDS


def _checked(bands) -> list[float]:
    bands = [float(b) for b in bands]
    if not bands or any(b <= 0 for b in bands):
        raise ValueError("a threshold must be above 0 minutes")
    return bands


def band_array(bands) -> Column:
    return F.array(*[F.lit(b) for b in _checked(bands)])


def within_bands(edges: DataFrame, bands) -> DataFrame:
    """edges with a row and column band for each band that holds them."""
    bands = _checked(bands)
    near = edges.where(F.col("minutes") <= max(bands))
    return near.withColumn("band", F.explode(F.filter(band_array(bands), lambda b: F.col("minutes") <= b)))


def _per_band(df: DataFrame, bands) -> DataFrame:
    return df.withColumn("band", F.explode(band_array(bands)))


def reached(edges: DataFrame, threshold: float) -> DataFrame:
    """(tract_id, reached) for the tracts that have an edge."""
    _checked([threshold])
    return edges.groupBy("tract_id").agg((F.min("minutes") <= threshold).alias("reached"))


def reached_by_band(edges: DataFrame, bands=CANONICAL_BANDS) -> DataFrame:
    """(band, tract_id, reached): one aggregate of the edges for all bands."""
    nearest = edges.groupBy("tract_id").agg(F.min("minutes").alias("nearest"))
    return _per_band(nearest, bands).select("band", "tract_id", (F.col("nearest") <= F.col("band")).alias("reached"))


def pop_share_by_band(edges: DataFrame, tracts: DataFrame, bands=CANONICAL_BANDS) -> DataFrame:
    """(band, reached_population, total_population, pop_share): null share for nobody at
    all, 0 for nobody reached."""
    nearest = edges.groupBy("tract_id").agg(F.min("minutes").alias("nearest"))
    joined = _per_band(tracts.join(nearest, "tract_id", "left").select("population", "nearest"), bands)
    inside = F.when(F.col("nearest") <= F.col("band"), F.col("population")).otherwise(0)
    return (
        joined.groupBy("band")
        .agg(F.sum(inside).cast("long").alias("reached_population"), F.sum("population").cast("long").alias("total_population"))
        .withColumn("pop_share", F.try_divide(F.col("reached_population").cast("double"), F.col("total_population").cast("double")))
    )


def provider_ratio(edges: DataFrame, providers: DataFrame, tracts: DataFrame, bands=CANONICAL_BANDS) -> DataFrame:
    """Step 1, (band, provider_id, catchment_population, ratio), over the whole catchment:
    null for an empty one and for one of nobody."""
    people = within_bands(edges, bands).join(tracts.select("tract_id", "population"), "tract_id")
    people = people.groupBy("band", "provider_id").agg(F.sum("population").cast("long").alias("catchment_population"))
    every = _per_band(providers.select("provider_id", "supply"), bands)
    out = every.join(people, ["band", "provider_id"], "left")
    return out.select("band", "provider_id", "catchment_population", F.try_divide(F.col("supply").cast("double"), F.col("catchment_population").cast("double")).alias("ratio"))


def tract_access(edges: DataFrame, ratio: DataFrame, tracts: DataFrame, bands=CANONICAL_BANDS) -> DataFrame:
    """Step 2, (band, tract_id, population, access): the sum of the defined ratios in reach."""
    defined = ratio.where("ratio IS NOT NULL").select("band", "provider_id", "ratio")
    sums = within_bands(edges, bands).join(defined, ["band", "provider_id"]).groupBy("band", "tract_id").agg(F.sum("ratio").alias("access"))
    every = _per_band(tracts.select("tract_id", "population"), bands)
    return every.join(sums, ["band", "tract_id"], "left").select("band", "tract_id", "population", F.coalesce("access", F.lit(0.0)).alias("access"))


def two_step(edges: DataFrame, providers: DataFrame, tracts: DataFrame, bands=CANONICAL_BANDS) -> tuple[DataFrame, DataFrame]:
    """(provider ratios, tract access)."""
    ratio = provider_ratio(edges, providers, tracts, bands)
    return ratio, tract_access(edges, ratio, tracts, bands)


def band_summary(edges: DataFrame, providers: DataFrame, tracts: DataFrame, bands=CANONICAL_BANDS) -> DataFrame:
    """The golden summary, a row per band."""
    ratio, access = two_step(edges, providers, tracts, bands)
    used = ratio.groupBy("band").agg(F.count("ratio").alias("n_providers_used"))
    nearest = edges.groupBy("tract_id").agg(F.min("minutes").alias("nearest"))
    by_tract = access.join(nearest, "tract_id", "left").withColumn("in_reach", F.coalesce(F.col("nearest") <= F.col("band"), F.lit(False)))
    sums = by_tract.groupBy("band").agg(
        F.count_if("in_reach").alias("n_tracts_reached"),
        F.sum(F.when(F.col("in_reach"), F.col("population")).otherwise(0)).cast("long").alias("reached_population"),
        F.sum("population").cast("long").alias("total_population"),
        F.sum("access").alias("access_sum"),
        F.avg("access").alias("access_mean"),
        F.max("access").alias("access_max"),
        F.count_if(F.col("access") == 0).alias("n_zero_access"),
    )
    return sums.join(used, "band").select(
        F.col("band").cast("int").alias("band_min"),
        "n_tracts_reached",
        F.try_divide(F.col("reached_population").cast("double"), F.col("total_population").cast("double")).alias("pop_share_within"),
        "total_population",
        "n_providers_used",
        "access_sum",
        "access_mean",
        "access_max",
        "n_zero_access",
    )


def leave_one_out(edges: DataFrame, tracts: DataFrame, threshold: float) -> DataFrame:
    """(provider_id, tracts_lost, population_lost) if that provider alone went: the tracts
    that no other reaches, found without a pass per provider."""
    near = edges.where(F.col("minutes") <= _checked([threshold])[0])
    only = near.groupBy("tract_id").agg(F.count(F.lit(1)).alias("reaching"), F.min("provider_id").alias("sole")).where("reaching = 1")
    lost = only.join(tracts.select("tract_id", "population"), "tract_id").groupBy(F.col("sole").alias("provider_id")).agg(F.count(F.lit(1)).alias("lost"), F.sum("population").cast("long").alias("people"))
    every = edges.select("provider_id").distinct()
    return every.join(lost, "provider_id", "left").select("provider_id", F.coalesce("lost", F.lit(0)).alias("tracts_lost"), F.coalesce("people", F.lit(0)).alias("population_lost"))


def without_provider(edges: DataFrame, provider) -> DataFrame:
    return edges.where(F.col("provider_id") != F.lit(provider))


def supply_conservation(ratio: DataFrame, access: DataFrame, providers: DataFrame) -> DataFrame:
    """(band, used_supply, weighted_access): access times population adds up to the supply
    of the providers whose ratio is defined."""
    used = ratio.where("ratio IS NOT NULL").join(providers.select("provider_id", "supply"), "provider_id").groupBy("band").agg(F.sum("supply").cast("long").alias("used_supply"))
    weighted = access.groupBy("band").agg(F.sum(F.col("access") * F.col("population")).alias("weighted_access"))
    return used.join(weighted, "band", "full")


def isolation(edges: DataFrame, providers: DataFrame, limit: float = max(CANONICAL_BANDS)) -> DataFrame:
    """(provider_id, nearest, isolated): isolated if nothing is within the limit."""
    nearest = edges.groupBy("provider_id").agg(F.min("minutes").alias("nearest"))
    return providers.select("provider_id").join(nearest, "provider_id", "left").withColumn("isolated", F.coalesce(F.col("nearest") > limit, F.lit(True)))


def zero_share_pct(access: DataFrame, weight: str = "population", value: str = "access", by: list[str] | None = None) -> DataFrame:
    """Per cent of weight on units whose value is 0; null for no weight at all."""
    zero = F.sum(F.when(F.col(value) == 0, F.col(weight)).otherwise(0)).cast("double")
    total = F.sum(F.col(weight)).cast("double")
    return access.groupBy(*(by or [])).agg(F.try_divide(100 * zero, total).alias("zero_share_pct"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The shortest of repeated edges, for tables that may hold them."""
    return edges.groupBy("provider_id", "tract_id").agg(F.min("minutes").alias("minutes"))


def nearest_providers(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest providers of each tract, ties by provider_id. Each task keeps k of a
    tract before the shuffle (a limit per group that the planner pushes down)."""
    order = Window.partitionBy("tract_id").orderBy("minutes", "provider_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
