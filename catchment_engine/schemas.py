"""Schemas of a world: providers, tracts and travel times between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROVIDERS = T.StructType(
    [
        T.StructField("provider_id", T.StringType()),
        T.StructField("synth_id", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("supply", T.IntegerType()),
    ]
)
TRACTS = T.StructType(
    [
        T.StructField("tract_id", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("population", T.IntegerType()),
    ]
)
TRAVEL_TIMES = T.StructType(
    [
        T.StructField("provider_id", T.StringType()),
        T.StructField("tract_id", T.StringType()),
        T.StructField("minutes", T.DoubleType()),
        T.StructField("km", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class World:
    """providers (provider_id, supply, ...), tracts (tract_id, population, ...) and edges
    (provider_id, tract_id, minutes, ...), each edge once; a missing travel time is a
    missing row."""

    providers: DataFrame
    tracts: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)
