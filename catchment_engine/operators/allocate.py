"""Sharing out totals by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partitioning import placed


def _with_totals(df: DataFrame, group: list[str], **sums: Column) -> DataFrame:
    """df with aggregates of each row's group beside it: a row per group is joined, so that a
    group of all rows isn't one task's."""
    totals = df.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(*[c.alias(k) for k, c in sums.items()])
    if not group:
        return df.crossJoin(F.broadcast(totals))  # one row
    on = None
    for g in group:
        same = F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        on = same if on is None else on & same
    return df.join(totals, on).drop(*[f"__g_{g}" for g in group])


def _checked(weight: str) -> Column:
    """A null or negative weight or a zero total fails the query, as part of the value so
    that it can't be pruned."""
    return (
        F.when(F.col("__null"), F.raise_error(F.lit("allocation: null weight")).cast("double"))
        .when(F.col("__least") < 0, F.raise_error(F.lit("allocation: negative weight")).cast("double"))
        .when(F.col("__total") == 0, F.raise_error(F.lit("allocation: weights add up to zero")).cast("double"))
        .otherwise(F.col(weight).cast("double"))
    )


def allocate(df: DataFrame, total: Column | float, weight: str, group: list[str] | None = None, out: str = "allocated") -> DataFrame:
    """Proportional shares total * w / sum(w); rows of weight 0 stay, at exactly 0."""
    total = total if isinstance(total, Column) else F.lit(float(total))
    w = F.col(weight)
    known = _with_totals(df, group or [], __total=F.sum(w), __null=F.max(w.isNull()), __least=F.min(w))
    return known.withColumn(out, total * _checked(weight) / F.col("__total").cast("double")).drop("__total", "__null", "__least")


def allocate_integer(df: DataFrame, total: Column | int, weight: str, order: list[str], group: list[str] | None = None, out: str = "allocated") -> DataFrame:
    """Whole shares by largest remainder, ties to the first in order, which tells a group's
    rows apart; they add up exactly."""
    group = group or []
    total = (total if isinstance(total, Column) else F.lit(total)).cast("double")
    shares = allocate(df, total, weight, group, "__exact").withColumn("__base", F.floor("__exact")).withColumn("__rest", F.col("__exact") - F.col("__base"))
    ranked = placed(shares, [-F.col("__rest"), *[F.col(c) for c in order]], group, "__rank")
    left = F.round(total - F.col("__bases"))
    ranked = _with_totals(ranked, group, __bases=F.sum("__base"))
    return ranked.withColumn(out, (F.col("__base") + F.when(F.col("__rank") <= left, 1).otherwise(0)).cast("long")).drop("__exact", "__base", "__rest", "__bases", "__rank")


def weights_check(df: DataFrame, key: str, weight: str, n_units: int, tolerance: float = 1e-12) -> DataFrame:
    """(n_units, n_keys, total, complete, normalised): whether weights cover that many
    different units, none negative or null, and add up to 1."""
    w = F.col(weight).cast("double")
    out = df.agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct(key).alias("n_keys"), F.coalesce(F.sum(w), F.lit(0.0)).alias("total"), F.count_if(w.isNull() | (w < 0)).alias("__bad"))
    complete = (F.col("n_units") == n_units) & (F.col("n_keys") == n_units) & (F.col("__bad") == 0)
    return out.select("n_units", "n_keys", "total", complete.alias("complete"), (F.abs(F.col("total") - 1) <= tolerance).alias("normalised"))


def deviation_report(df: DataFrame, observed: str, exact: str, total: str, by: list[str]) -> DataFrame:
    """(by, max_abs_deviation, n_nonzero, conserved) of shares against their exact values."""
    return df.groupBy(*by).agg(
        F.max(F.abs(F.col(observed) - F.col(exact))).alias("max_abs_deviation"),
        F.count_if(F.col(observed) != 0).alias("n_nonzero"),
        (F.sum(observed) == F.max(total)).alias("conserved"),
    )
