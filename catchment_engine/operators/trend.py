"""Trends and Monte Carlo intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bands import z_value
from ..functions.stats import t_two_sided


#: Degrees of freedom whose quantile is computed exactly on the driver.
EXACT_DF = 100


def t_cdf_two_sided(t: float, df: int) -> float:
    """P(|T| <= t) for a whole number of degrees of freedom, by the finite sum."""
    angle = math.atan(t / math.sqrt(df))
    s, c = math.sin(angle), math.cos(angle)
    term, total = (c, 0.0) if df % 2 else (1.0, 0.0)
    for k in range(1, (df - 1) // 2 + 1 if df % 2 else df // 2 + 1):
        total += term
        term *= c * c * ((2 * k) / (2 * k + 1) if df % 2 else (2 * k - 1) / (2 * k))
    return 2 / math.pi * (angle + s * total) if df % 2 else s * total


def t_quantile(df: int, confidence: float) -> float:
    """Two-sided quantile by bisection."""
    low, high = 0.0, 1.0
    while t_cdf_two_sided(high, df) < confidence:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf_two_sided(middle, df) < confidence else (low, middle)
    return (low + high) / 2


def _t_quantile(df: Column, confidence: float) -> Column:
    """Up to EXACT_DF from a table, beyond by the expansion about the normal quantile."""
    z = z_value(confidence)
    n = df.cast("double")
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    far = F.lit(z) + terms[0] / n + terms[1] / (n * n) + terms[2] / (n * n * n)
    table = F.array(*[F.lit(t_quantile(k, confidence)) for k in range(1, EXACT_DF + 1)])
    return F.when(df < 1, None).when(df <= EXACT_DF, F.try_element_at(table, df.cast("int"))).otherwise(far)


def annual_trend(df: DataFrame, x: str, y: str, group: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """(group, n, slope, lo, hi, p): least squares with an interval and test by Student's t
    on n - 2 degrees of freedom. Null slope for a constant x or fewer than two points; lo, hi
    and p are null below three points, and the slope itself, with p 0, on a noiseless line."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(*(group or [])).agg(
        F.regr_count(yd, xd).alias("n"),
        F.regr_sxx(yd, xd).alias("sxx"),
        F.regr_syy(yd, xd).alias("syy"),
        F.regr_sxy(yd, xd).alias("sxy"),
    )
    slope = F.when(F.col("n") >= 2, F.try_divide(F.col("sxy"), F.col("sxx")))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    # What rounding leaves of a line without noise counts as none.
    rest = F.when(rest <= 1e-12 * F.col("syy"), 0.0).otherwise(rest)
    out = sums.withColumn("slope", slope).withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.try_divide(rest, (F.col("n") - 2) * F.col("sxx")))))
    half = _t_quantile(F.col("n") - 2, confidence) * F.col("se")
    p = F.when(F.col("se") == 0, F.when(F.col("slope") == 0, 1.0).otherwise(0.0)).otherwise(t_two_sided(F.try_divide(F.col("slope"), F.col("se")), F.col("n") - 2))
    return out.select(*(group or []), "n", "slope", (F.col("slope") - half).alias("lo"), (F.col("slope") + half).alias("hi"), F.when(F.col("se").isNotNull(), p).alias("p"))


def mc_weighted_ci(df: DataFrame, estimate: str, se: str, weight: str, draws: int, seed: int, key: str, confidence: float = 0.95) -> DataFrame:
    """(point, lo, hi) of a weighted mean: percentiles over draws of estimate + se * Z, with Z
    from hashes of seed, draw and key (Box and Muller), so that partitions have no say. The
    point lies between: lo and hi are widened to it.

    Rows are expanded to draws and summed per draw on the map side: draws rows are shuffled
    for each task.
    """
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("draw"), F.col(key)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(F.lit(2 * math.pi) * u(2))
    w, e = F.col(weight).cast("double"), F.col(estimate).cast("double")
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    each = drawn.groupBy("draw").agg(F.try_divide(F.sum((e + F.col(se) * z) * w), F.sum(w)).alias("value"))
    tail = (1 - confidence) / 2
    band = each.agg(F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1 - tail)).alias("hi"))
    point = df.agg(F.try_divide(F.sum(e * w), F.sum(w)).alias("point"))
    return point.crossJoin(band).select("point", F.least("lo", "point").alias("lo"), F.greatest("hi", "point").alias("hi"))
