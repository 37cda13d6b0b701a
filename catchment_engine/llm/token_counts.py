"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and reduced to (length, number of documents); all
answers come from suffix sums over that histogram: totals, quantiles and the
tokens left when every document is truncated to a context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stage

#: Lengths in one block of the two-level suffix sum.
BLOCK = 64


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) of each row of docs; null and empty texts have 0 tokens.

    vocabulary: path of a rank file, the same on each executor; pattern: its
    pre-tokenising expression. Texts are encoded whole.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for b in sliced(batches):
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), combined on the map side: a hot length is one row per task."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_report(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: n_docs and tokens of that length; docs_at_least
    and tokens_at_least (suffix sums over lengths from L); truncated_tokens, the
    corpus' tokens if each document is cut at L; cum_docs, its share, the quantile
    whose value L is; and the totals. An empty table gives no rows.

    Sums run in two levels, within blocks of BLOCK lengths and over the blocks,
    so no task holds more than the block count or a block. The histogram is written to
    shared storage first, as both levels read it and texts are to be encoded once.
    """
    h = stage(histogram, "token-histogram").select(
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(whole).alias("total_docs"),
        F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "tokens",
        "total_docs",
        "total_tokens",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
    )
    return at.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("cum_docs"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("cum_share"),
        "total_docs",
        "total_tokens",
    )


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """(limit, tokens): the corpus' tokens if cut at any context limit, also one
    at which no document ends: from the report's first length above it."""
    at = report.where(F.col("n_tokens") > limit).agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x"),
    )
    total = report.agg(F.first("total_tokens").alias("total_tokens"))
    return total.join(at).select(
        F.lit(limit).cast("long").alias("limit"),
        (F.coalesce("total_tokens", F.lit(0)) - F.coalesce("x.tokens_at_least", F.lit(0)) + F.lit(limit) * F.coalesce("x.docs_at_least", F.lit(0))).alias("tokens"),
    )


def quantile(report: DataFrame, q: float) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of documents doesn't exceed."""
    return report.where(F.col("cum_docs") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.lit(q).alias("q"), F.min("n_tokens").alias("n_tokens"))
