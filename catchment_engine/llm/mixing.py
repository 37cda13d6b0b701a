"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends on their
ids alone, served for a given number of passes. Documents are sent in packets of
some words; a packet's virtual finish time is the source's cumulative words at its
end divided by the source's target. Packets of all sources are ordered by finish
time and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Weights by source in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes.
BUDGET = 1.5
#: Times that a document may be taken.
PASSES = 2
#: Words in a packet.
PACKET = 512
#: Rows in a block of a source or of finish time, about, and the least number of hexadecimal
#: digits of the shuffling hash that part a source into blocks.
BLOCK_ROWS, LEAST_DIGITS = 20_000, 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def queue_tag(doc_id: Column, seed: str = "mix") -> Column:
    """What a source's documents are shuffled by."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def text_hash(text: Column) -> Column:
    """What tells rows of one id, or of none, apart in a queue."""
    return F.xxhash64(text.cast("string"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Targets share budget times all sizes by weight, none above passes times its
    source's size: with sources in the order of their cap over weight, those before
    some place are at their cap and the rest share what is left by weight.
    One row per source goes through the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    array = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(array, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.lit(float(passes)) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source",
        "source_size",
        "weight",
        (F.lit(passes) * F.col("source_size")).alias("cap"),
        (F.lit(float(budget)) * F.sum("source_size").over(whole)).alias("total"),
        F.coalesce(F.sum(F.lit(passes) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("level", F.first("level", ignorenulls=True).over(whole))
    return per.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def _running(df: DataFrame, keys: list[str], block: str, value: str, order: list) -> DataFrame:
    """Adds before: the sum of value over earlier rows of the keys, in order of block
    and then order; in two levels, so that a key isn't one task's."""
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(block).alias("__block"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__earlier"))
    on = df[block].eqNullSafe(sums["__block"])
    for k in keys:
        on = on & df[k].eqNullSafe(sums[f"__{k}"])
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, on).withColumn("before", F.col("__earlier") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("__block", "__earlier", *[f"__{k}" for k in keys])


def digits_for(rows: int) -> int:
    """Digits whose values part that many rows into blocks of about BLOCK_ROWS."""
    digits = LEAST_DIGITS
    while BLOCK_ROWS << 4 * digits < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = BUDGET, passes: int = PASSES, packet: int = PACKET, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, first_finish, text_hash) per row of docs.

    taken: words that the mix takes over all passes; first_finish: virtual time at
    which the document's first packet is sent. A null text has size 0 and takes 0;
    a null source is a source. The queue order is by md5 of seed and doc_id, then
    size and text_hash: rows equal in all of these are the same to the mix, and
    repeated rows each are documents. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), text_hash(F.col(text_col)).alias("text_hash"))
    rows = stage(rows, "mix-sizes")
    digits = digits_for(rows.count())
    per = targets(rows.select("source", "size"), budget=budget, passes=passes)
    per = stage(per, "mix-targets").select(F.col("source").alias("__source"), "source_size", "target")
    rows = rows.withColumn("tag", queue_tag(F.col("doc_id"), seed)).withColumn("block", F.substring("tag", 1, digits))
    queued = _running(rows, ["source"], "block", "size", ["tag", "doc_id", "size", "text_hash"])
    queued = queued.join(per, queued["source"].eqNullSafe(per["__source"])).drop("__source")
    queued = queued.withColumn("copy", F.row_number().over(Window.partitionBy("source", "block").orderBy("tag", "doc_id", "size", "text_hash")))
    queued = stage(queued, "mix-queue")

    one = queued.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    one = one.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet) * packet, F.lit(packet).cast("long"))))
    one = one.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at")))
    finish = (F.col("pass") * F.col("source_size") + F.col("before") + F.col("at") + F.col("words")) / F.col("target")
    # Packets that finish after time 2 can't be sent: at time 1 each queue has sent its target.
    sent = one.select("source", "block", "copy", "words", finish.alias("finish")).where("finish < 2")
    sent = sent.withColumn("slot", F.floor(F.col("finish") * 16**digits)).withColumn("all", F.lit(0))
    sent = _running(sent.withColumnRenamed("block", "queue"), ["all"], "slot", "words", ["finish", "source", "queue", "copy"])
    total = F.floor(F.lit(float(budget)) * F.col("__all"))
    everything = stage(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__all")), "mix-total")
    sent = sent.crossJoin(F.broadcast(everything))  # one row
    sent = sent.withColumn("sent", F.greatest(F.lit(0), F.least("words", total - F.col("before"))).cast("long")).where("sent > 0")
    taken = sent.groupBy(F.col("source").alias("__source"), F.col("queue").alias("__queue"), F.col("copy").alias("__copy")).agg(F.sum("sent").alias("taken"), F.min("finish").alias("first_finish"))
    on = queued["source"].eqNullSafe(taken["__source"]) & (queued["block"] == taken["__queue"]) & (queued["copy"] == taken["__copy"])
    return queued.join(taken, on, "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_finish", "text_hash")
