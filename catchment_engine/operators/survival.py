"""Survival curves and hazards over ages, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_age(group: list[str]) -> Window:
    return Window.partitionBy(*group).orderBy("age")


def survival_curve(df: DataFrame, group: list[str] | None = None, hazard: str = "annual_hazard") -> DataFrame:
    """Adds survival, the product of 1 - hazard up to each age; hazards of 1 are fine. A hazard
    outside 0..1 fails the query."""
    h = F.when((F.col(hazard) < 0) | (F.col(hazard) > 1), F.raise_error(F.lit("hazard outside 0..1")).cast("double")).otherwise(F.col(hazard))
    so_far = _by_age(group or []).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("survival", F.product(1 - h).over(so_far))


def hazard_from_survival(df: DataFrame, group: list[str] | None = None, survival: str = "survival") -> DataFrame:
    """Adds hazard, 1 - S(age) / S(age before), the first from 1; null after S reached 0."""
    before = F.lag(survival, 1, 1.0).over(_by_age(group or []))
    return df.withColumn("hazard", 1 - F.try_divide(F.col(survival), before))


def anchor_spread(df: DataFrame, group: list[str] | None = None, survival: str = "survival", hazard: str = "annual_hazard") -> DataFrame:
    """(group, anchor_min, anchor_max, spread) of S over the product of 1 - hazard, which is
    one constant if the two belong together; ages of zero product are left out."""
    group = group or []
    made = survival_curve(df.withColumnRenamed(survival, "__s"), group, hazard)
    ratio = F.try_divide(F.col("__s"), F.col("survival"))
    return made.groupBy(*group).agg(F.min(ratio).alias("anchor_min"), F.max(ratio).alias("anchor_max")).withColumn("spread", F.col("anchor_max") - F.col("anchor_min"))


def violations(df: DataFrame, group: list[str] | None = None, survival: str = "survival") -> DataFrame:
    """(group, age, rule): survival rises, is outside 0..1, or an age is skipped."""
    w = _by_age(group or [])
    s = F.col(survival)
    rules = F.array_compact(
        F.array(
            F.when(s > F.lag(survival).over(w), F.lit("increasing")),
            F.when((s < 0) | (s > 1), F.lit("out_of_range")),
            F.when(F.col("age") != F.lag("age").over(w) + 1, F.lit("age_gap")),
        )
    )
    return df.select(*(group or []), "age", rules.alias("rules")).select(*(group or []), "age", F.explode("rules").alias("rule"))


def head_tail(df: DataFrame, value: str, group: list[str] | None = None, k: int = 5) -> DataFrame:
    """(group, head_mean, tail_mean): means over the first and last k ages."""
    group = group or []
    first = F.row_number().over(Window.partitionBy(*group).orderBy("age"))
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("age").desc()))
    ranked = df.withColumn("__first", first).withColumn("__last", last)
    return ranked.groupBy(*group).agg(F.avg(F.when(F.col("__first") <= k, F.col(value))).alias("head_mean"), F.avg(F.when(F.col("__last") <= k, F.col(value))).alias("tail_mean"))


def peak(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, peak_age, peak_value): the smallest age of the largest value."""
    best = F.max_by(F.struct("age", value), F.struct(value, -F.col("age")))
    return df.groupBy(*(group or [])).agg(best.alias("__b")).select(*(group or []), F.col("__b.age").alias("peak_age"), F.col(f"__b.{value}").alias("peak_value"))


def align(curves: list[DataFrame], value: str, names: list[str]) -> DataFrame:
    """Curves side by side on the ages that all of them have."""
    out = None
    for df, name in zip(curves, names, strict=True):
        part = df.select("age", F.col(value).alias(name))
        out = part if out is None else out.join(part, "age")
    return out


def shift_hazard(df: DataFrame, years: int) -> DataFrame:
    """The hazard of a curve whose retirements come some years later: h at age - years."""
    return df.withColumn("age", F.col("age") + years)


def survival_at(curve: DataFrame, ages: DataFrame, group: list[str] | None = None, survival: str = "survival") -> DataFrame:
    """The rows of ages with the survival of their age and group, null where the curve has
    none: the same values as the curve's, by a join."""
    group = group or []
    at = curve.select(*[F.col(c).alias(f"__{c}") for c in [*group, "age"]], F.col(survival).alias("__survival"))
    on = F.col("age") == F.col("__age")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return ages.join(at, on, "left").withColumn(survival, F.col("__survival")).drop("__survival", "__age", *[f"__{g}" for g in group])


#: Ages between which a career's weight peaks, and the share of its peak that the
#: last years' mean stays below.
PEAK_AGES, TAPER = (40, 60), 0.6


def career_violations(df: DataFrame, weight: str, group: list[str] | None = None, k: int = 5) -> DataFrame:
    """(group, rule, detail) of career arcs of weights by age that break a rule: a weight
    outside (0, 1] (null too), a peak at either end or outside PEAK_AGES, no early ramp, or
    a mean of the last k ages that isn't below TAPER of the peak."""
    group = group or []
    w = F.col(weight)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("age").desc()))
    ranked = df.withColumn("__last", last)
    peak_age = F.max_by("age", F.struct(w, -F.col("age")))
    arcs = ranked.groupBy(*group).agg(
        F.count_if(w.isNull() | ~((w > 0) & (w <= 1))).alias("bad"),
        F.min("age").alias("a"),
        F.max("age").alias("z"),
        peak_age.alias("peak"),
        F.max(w).alias("top"),
        F.min_by(w, "age").alias("first"),
        F.avg(F.when(F.col("__last") <= k, w)).alias("tail"),
    )
    rule = lambda bad, name, detail: F.when(bad, F.struct(F.lit(name).alias("rule"), F.col(detail).cast("double").alias("detail")))
    peak, top = F.col("peak"), F.col("top")
    rules = F.array_compact(
        F.array(
            rule(F.col("bad") > 0, "not_a_share", "bad"),
            rule((peak == F.col("a")) | (peak == F.col("z")), "peak_at_end", "peak"),
            rule(~peak.between(*PEAK_AGES), "peak_age", "peak"),
            rule(F.col("first") >= top, "no_ramp", "first"),
            rule(F.col("tail") >= TAPER * top, "no_taper", "tail"),
        )
    )
    return arcs.select(*group, F.explode(rules).alias("x")).select(*group, "x.rule", "x.detail")
