"""From raw documents to a mixed, deduplicated and decontaminated token store.

Each stage takes (spark, docs, sf_dir), with docs the table that the stage before it
kept, and returns a table of the columns of documents; the last returns what the token
store holds of each document. run() writes each stage's table to shared storage and reads
it again, so that a lost executor costs no more than the stage at work.

In all stages: an empty table gives an empty table; a null or empty text has no words; null
ids, languages and sources are values of their own; rows are carried whole, so that more
columns may have any names; doc_id is a whole number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment_engine.llm import common
from catchment_engine.llm import decontamination as decontamination_op
from catchment_engine.llm import minhash_dedup as minhash_op
from catchment_engine.llm import mixing as mixing_op
from catchment_engine.llm import quality as quality_op
from catchment_engine.llm import token_store as store_op
from catchment_engine.llm.queries import VOCABULARY, write_token_store

#: No SQL: the tokenizer isn't in it.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """What stages decide by, and each whole row as __row."""
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source. Texts
    without words fail; repeated rows stay or go together."""
    common.ship(spark)
    return quality_op.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, null last,
    then by a hash of the text; of rows equal in both, by text and then the other columns.
    Rows are decided one by one: an id that is null or repeated links nothing. Rows
    without words are in no group and stay. Shingles have two words, at 80 percent:
    the contract of op5_minhash_dedup is taken for the stage."""
    common.ship(spark)
    row = ["doc_id", "__h1", "__h2"]
    keyed = _rows(docs).withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit("row"), "text")})
    found = minhash_op.row_groups(keyed, row[1:]).where("n_shingles > 0")
    found = common.stage(found.groupBy(*row).agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("n")), "pipeline-near")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *row))
    first = common.stage(found.groupBy("group").agg(least.alias("least")).select("least.*"), "pipeline-first")
    gone = common.stage(common.without(found, first, row).select(row), "pipeline-copies")
    out = common.without(keyed, gone, row)
    repeated = common.stage(common.without(found.where("n > 1"), gone, row).select(row), "pipeline-repeated")
    common.unstage(found, first)
    if not repeated.head(1):
        return out.select("__row.*")
    # Of a repeated row key, rows are compared whole; only such rows are shuffled.
    other = repeated.select(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(row)])
    same = [out[c].eqNullSafe(other[f"__of{i}"]) for i, c in enumerate(row)]
    some = out.join(other, same[0] & same[1] & same[2], "left_semi")
    one = some.groupBy(*row).agg(F.min(F.struct("text", "__row")).alias("x")).select("x.__row.*")
    return common.without(out, repeated, row).select("__row.*").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; repeated rows stay or go together."""
    common.ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _rows(docs).withColumn("__key", F.xxhash64("doc_id", "text"))
    id_and_key = F.struct("doc_id", F.col("__key").alias("key"))
    found = decontamination_op.find_contamination(keyed.select(id_and_key.alias("doc_id"), "text"), benchmark, slop=None)
    gone = found.where(F.size("spans") > 0).select("doc_id.doc_id", F.col("doc_id.key").alias("__key"))
    gone = common.stage(gone, "pipeline-contaminated")
    common.unstage(found)
    return common.without(keyed, gone, ["doc_id", "__key"]).select("__row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, nought to two times: the words taken over
    the row's size, rounded. Repeated documents stand as repeated rows; those without words
    aren't taken."""
    common.ship(spark)
    taken = mixing_op.mix(docs).where("size > 0")
    # Queues are served in the order of their tags, sizes and text hashes, so a source's copies
    # end at a place: the decisions are a row per source, and no text is shuffled.
    place = lambda size, text_hash: F.struct(mixing_op.queue_tag(F.col("doc_id")).alias("tag"), size.alias("size"), text_hash.alias("hash"))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5)
    at_least = [F.count_if(copies >= k).alias(f"n{k}") for k in (1, 2)]
    places = taken.groupBy("source", place(F.col("size"), F.col("text_hash")).alias("place")).agg(F.count(F.lit(1)).alias("m"), *at_least)
    places = common.stage(places, "pipeline-places").withColumnsRenamed({"source": "__source", "place": "__place"})
    last = lambda k: F.max(F.when(F.col(f"n{k}") == F.col("m"), F.col("__place")))
    ends = common.stage(places.groupBy("__source").agg(last(1).alias("__once"), last(2).alias("__twice")), "pipeline-mix")
    placed = _rows(docs).withColumns({"__size": mixing_op.word_count(F.col("text")), "__hash": mixing_op.text_hash(F.col("text"))})
    placed = placed.withColumn("__at", place(F.col("__size"), F.col("__hash"))).where("__size > 0")
    same_source = F.col("source").eqNullSafe(F.col("__source"))
    n = F.when(F.col("__at") <= F.col("__twice"), 2).when(F.col("__at") <= F.col("__once"), 1).otherwise(0)
    times = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    out = placed.join(ends, same_source).withColumn("__copy", times(n)).select("__row.*")
    # An end may fall among equal rows, which have one place: two places of a source at most.
    cut = [F.when(F.col(f"n{k}") < F.col("m"), F.col(f"n{k}")).otherwise(0).alias(f"__n{k}") for k in (1, 2)]
    split = common.stage(places.where("(0 < n1 AND n1 < m) OR (0 < n2 AND n2 < m)").select("__source", "__place", *cut), "pipeline-split")
    if not split.head(1):
        return out
    equal = placed.join(split, same_source & (F.col("__at") == F.col("__place"))).groupBy("__source", "__place", "__n1", "__n2", "__row").agg(F.count(F.lit(1)).alias("__m"))
    over = Window.partitionBy("__source", "__place").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("__before", F.coalesce(F.sum("__m").over(over), F.lit(0)))
    n = sum(F.greatest(F.lit(0), F.least(F.col("__m"), F.col(f"__n{k}") - F.col("__before"))) for k in (1, 2))
    return out.unionByName(equal.withColumn("__copy", times(n)).select("__row.*"))


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the store and returns, as read back from it: doc_id, start, n_tokens, ids_crc32.
    Repeated rows are documents of their own; null ids come first."""
    common.ship(spark)
    path = write_token_store(spark, docs)
    return store_op.read_documents(spark, path, VOCABULARY).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token store", token_store),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
