"""Chunk numbers, and catchment scores computed chunk by chunk.

Step 1 is always over all tracts; chunks part the output alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catchment import provider_ratio, tract_access

SCHEMES = ("even", "interleaved", "uneven")


#: Rows, chosen by a hash of their keys, from which the bounds of ranges are read.
SAMPLE = 2048


def placed(df: DataFrame, keys: list[Column], group: list[str] | None = None, out: str = "idx", buckets: int = 64) -> DataFrame:
    """Adds the place of each row of its group (default: all rows) in the order of keys, from
    1, in two levels: places within ranges of the keys, and the ranges' sizes, so that no
    task has all rows. Bounds are quantiles of rows chosen by hash: the same whenever a part
    of the plan runs again, as a sample by partition wouldn't be. Keys tell rows apart."""
    group = group or []
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    some = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE).agg(F.array_sort(F.collect_list("k")).alias("__s"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("__s", F.floor(i * F.size("__s") / buckets).cast("int")))
    bounds = some.select(F.array_distinct(cuts).alias("__bounds"))
    ranged = df.withColumn("__key", key).crossJoin(F.broadcast(bounds))  # one row
    ranged = ranged.withColumn("__part", F.size(F.filter("__bounds", lambda b: b < F.col("__key")))).drop("__bounds")
    counts = ranged.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__key"))
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = ranged.withColumn("__inside", inside).join(starts, on)
    return joined.withColumn(out, F.col("__inside") + F.col("__start")).drop("__key", "__part", "__p", "__start", "__inside", *[f"__{g}" for g in group])


def row_index(df: DataFrame, key: str, out: str = "idx", buckets: int = 64) -> DataFrame:
    """Adds the place of each row in the order of a key that tells rows apart, from 1."""
    return placed(df, [F.col(key)], out=out, buckets=buckets)


def chunk_number(idx: Column, n_items: Column, n_chunks: int, scheme: str = "even") -> Column:
    """1..n_chunks for a place 1..n_items. even: neighbours, near equal; interleaved: in
    turn; uneven: the first empty, the second one item, the rest even."""
    if n_chunks < 1 or scheme not in SCHEMES:
        raise ValueError("n_chunks is at least 1 and scheme one of " + ", ".join(SCHEMES))
    i, n = idx.cast("double"), n_items.cast("double")
    even = lambda i, n, k: F.least(F.ceil(i / (n / k)), F.lit(k)).cast("int")
    if n_chunks == 1:
        return F.lit(1)
    if scheme == "even":
        return even(i, n, n_chunks)
    if scheme == "interleaved":
        return (F.pmod(idx - 1, F.lit(n_chunks)) + 1).cast("int")
    if n_chunks == 2:
        return F.lit(2)
    return F.when(idx == 1, 2).otherwise(even(i - 1, F.greatest(n - 1, F.lit(1.0)), n_chunks - 2) + 2).cast("int")


def chunks_of_size(idx: Column, size: int) -> Column:
    return F.ceil(idx / size).cast("int")


def assign_chunks(tracts: DataFrame, n_chunks: int, scheme: str = "even", key: str = "tract_id") -> DataFrame:
    """tracts with chunk, by the order of their key."""
    total = tracts.agg(F.count(F.lit(1)).alias("__items"))
    return row_index(tracts, key).crossJoin(F.broadcast(total)).withColumn("chunk", chunk_number(F.col("idx"), F.col("__items"), n_chunks, scheme)).drop("__items")


def chunk_accounting(chunked: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, n_items) of every chunk, the empty ones too."""
    every = chunked.sparkSession.range(1, n_chunks + 1).select(F.col("id").cast("int").alias("chunk"))
    sizes = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_items"))
    return every.join(sizes, "chunk", "left").select("chunk", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def chunked_access(edges: DataFrame, providers: DataFrame, tracts: DataFrame, threshold: float, n_chunks: int = 1, scheme: str = "even") -> DataFrame:
    """(tract_id, chunk, access): step 1 over everything, step 2 with the tracts dealt out by
    chunk, put together by identifier. The processing order has no say."""
    ratio = provider_ratio(edges, providers, tracts, [threshold])
    dealt = assign_chunks(tracts, n_chunks, scheme).repartition("chunk")
    access = tract_access(edges, ratio, dealt.select("tract_id", "population"), [threshold])
    return dealt.select("tract_id", "chunk").join(access.select("tract_id", "access"), "tract_id")


def worker_plan(tracts: DataFrame, n_chunks: int, workers: int, scheme: str = "even", order: str = "forward", key: str = "tract_id") -> DataFrame:
    """(tract_id, chunk, worker, turn): chunks dealt to workers in turn, and the turn in
    which a worker takes its chunk, forward or reverse. Results don't depend on it."""
    if order not in ("forward", "reverse"):
        raise ValueError("order is forward or reverse")
    dealt = assign_chunks(tracts, n_chunks, scheme, key)
    at = F.col("chunk") if order == "forward" else n_chunks + 1 - F.col("chunk")
    turn = F.floor((at - 1) / workers).cast("int") + 1
    return dealt.select(key, "chunk", workers_of(F.col("chunk"), workers).cast("int").alias("worker"), turn.alias("turn"))


def workers_of(chunk: Column, workers: int) -> Column:
    """The worker that a chunk goes to in turn."""
    return F.pmod(chunk - 1, F.lit(workers)) + 1
