"""Data quality: differences within tolerances, contracts, drift and run verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bands import TOL_RELATIVE
from ..schemas import World


def numeric_diff(observed: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = TOL_RELATIVE, label: str = "value", relative: bool = False) -> DataFrame:
    """(keys, observed, expected, rel_diff, label) of the keys whose values differ, or stand
    on one side alone. Two nulls (or NaN) are equal, one is a difference. The difference is
    over the larger of 1 and the expected value, or with relative over the expected value."""
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    o = observed.select(*keys, clean(value).alias("observed"), F.lit(True).alias("__o"))
    e = expected.select(*[F.col(k).alias(f"__{k}") for k in keys], clean(value).alias("expected"), F.lit(True).alias("__e"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    size = F.abs(F.col("expected"))
    rel = F.when(F.col("observed") == F.col("expected"), 0.0).otherwise(F.try_divide(F.abs(F.col("observed") - F.col("expected")), size if relative else F.greatest(size, F.lit(1.0))))
    joined = o.join(e, on, "full").withColumn("rel_diff", rel)
    apart = F.col("__o").isNull() | F.col("__e").isNull() | (F.col("observed").isNull() != F.col("expected").isNull())
    both = F.col("observed").isNotNull() & F.col("expected").isNotNull()
    bad = apart | (both & F.coalesce(F.col("rel_diff") > tolerance, F.lit(True)))
    return joined.where(bad).select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], "observed", "expected", "rel_diff", F.lit(label).alias("label"))


def format_diff(diff: DataFrame, max_rows: int = 12) -> str:
    """A few differences as text; a report's limit is its purpose."""
    rows = diff.limit(max_rows + 1).collect()
    if not rows:
        return "(no differences)"
    lines = ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows[:max_rows]]
    return "\n".join(lines + [f"  and {diff.count() - max_rows} more"] * (len(rows) > max_rows))


def _broken(df: DataFrame, rule: str, bad: Column, key: Column, detail: Column) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def validate(world: World, complete: bool = False) -> DataFrame:
    """(rule, key, detail) of everything in a world that breaks its contract: repeated keys,
    nulls and NaN, negative sizes, edges to nowhere; with complete also missing pairs."""
    p, t, e = world.providers, world.tracts, world.edges
    edge = F.concat_ws("|", F.col("provider_id").cast("string"), F.col("tract_id").cast("string"))
    many = lambda df, keys, rule, key: _broken(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), rule, F.col("n") > 1, key, F.col("n"))
    parts = [
        many(p, ["provider_id"], "duplicate_provider", F.col("provider_id")),
        many(t, ["tract_id"], "duplicate_tract", F.col("tract_id")),
        many(e, ["provider_id", "tract_id"], "duplicate_edge", edge),
        _broken(p, "bad_supply", F.col("supply").isNull() | (F.col("supply") < 0), F.col("provider_id"), F.col("supply")),
        _broken(t, "bad_population", F.col("population").isNull() | (F.col("population") < 0), F.col("tract_id"), F.col("population")),
        _broken(e, "bad_minutes", F.col("minutes").isNull() | F.isnan("minutes") | (F.col("minutes") < 0), edge, F.col("minutes")),
        _broken(e.join(t.select("tract_id"), "tract_id", "left_anti"), "unknown_tract", F.lit(True), edge, F.lit(None)),
        _broken(e.join(p.select("provider_id"), "provider_id", "left_anti"), "unknown_provider", F.lit(True), edge, F.lit(None)),
    ]
    if "synth_id" in p.columns:
        parts.append(_broken(p, "bad_synth_id", ~F.coalesce(F.col("synth_id").rlike("^9[0-9]{9}$"), F.lit(False)), F.col("provider_id"), F.col("synth_id")))
    if complete:
        # Pairs are counted, not made: each provider needs an edge to as many tracts as there are.
        n = t.agg(F.count(F.lit(1)).alias("n_tracts"))
        per = e.groupBy("provider_id").agg(F.count_distinct("tract_id").alias("have"))
        short = p.select("provider_id").join(per, "provider_id", "left").crossJoin(F.broadcast(n))
        parts.append(_broken(short, "incomplete_matrix", F.coalesce("have", F.lit(0)) < F.col("n_tracts"), F.col("provider_id"), F.col("have")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def drift_report(observed: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = TOL_RELATIVE) -> DataFrame:
    """(column, kind, n_changed, max_abs_diff, drifted): per shared column the largest
    numeric difference or the number of changed texts, joined by key, and a row for each
    column or set of rows that one side lacks."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in expected.schema}
    shared = [c for c in expected.columns if c in observed.columns and c not in keys]
    o = observed.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in shared], F.lit(1).alias("__o"))
    e = expected.select(*keys, *[F.col(c).alias(f"__e_{c}") for c in shared], F.lit(1).alias("__e"))
    joined = o.join(e, keys, "full")
    sums = [F.count_if(F.col("__o").isNull() | F.col("__e").isNull()).alias("__rows")]
    for c in shared:
        a, b = F.col(f"__o_{c}"), F.col(f"__e_{c}")
        sums.append(F.count_if(~a.eqNullSafe(b)).alias(f"__n_{c}"))
        sums.append((F.max(F.abs(a.cast("double") - b.cast("double"))) if kinds[c] else F.lit(None).cast("double")).alias(f"__d_{c}"))
    one = joined.agg(*sums)

    def row(column: str, kind: str, n: Column, d: Column, drifted: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind"), n.cast("long").alias("n_changed"), d.cast("double").alias("max_abs_diff"), drifted.alias("drifted"))

    rows = [row("(rows)", "rows", F.col("__rows"), F.lit(None), F.col("__rows") > 0)]
    for c in shared:
        n, d = F.col(f"__n_{c}"), F.col(f"__d_{c}")
        rows.append(row(c, "number", n, d, F.coalesce(d > tolerance, F.lit(False)) | ((n > 0) & d.isNull())) if kinds[c] else row(c, "text", n, F.lit(None), n > 0))
    for c in sorted({*observed.columns} ^ {*expected.columns}):
        rows.append(row(c, "column", F.lit(None), F.lit(None), F.lit(True)))
    return one.select(F.inline(F.array(*rows)))


def run_verdicts(results: DataFrame, planned: DataFrame) -> DataFrame:
    """(file, passed, failed, error, skipped, verdict) of each planned file: NOT RUN without
    results, FAIL with a failure or error, else PASS."""
    sums = results.groupBy("file").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("passed", "failed", "error", "skipped")])
    verdict = F.when(F.col("passed").isNull(), "NOT RUN").when(F.col("failed") + F.col("error") > 0, "FAIL").otherwise("PASS")
    return planned.select("file").distinct().join(sums, "file", "left").withColumn("verdict", verdict)


def vocabulary_violations(df: DataFrame, column: str) -> DataFrame:
    """(rule, value, n) of a vocabulary's flaws: blank or null entries, entries that occur
    more than once (they would count double), and no entry at all."""
    x = F.col(column).cast("string")
    counted = df.groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    flawed = counted.withColumn("rules", F.array_compact(F.array(F.when(blank, F.lit("blank")), F.when(F.col("n") > 1, F.lit("repeated")))))
    flawed = flawed.select(F.explode("rules").alias("rule"), "value", "n")
    none = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("value"), "n")
    return flawed.unionByName(none)
