"""Mutation testing of the engine: plausible mistakes that the probes must notice.

The parts under test are passed in a dict. A mutant is made from the original part, which
it may call, so that it can't call itself. A mutant whose part answers as the original
does on its witness was NOT_APPLIED; one that no probe notices SURVIVED; it is KILLED only
by a failed assertion, never by another error.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bands as constants
from ..functions import geometry, scalars, stats
from ..operators import allocate, catchment, partitioning
from ..schemas import World

NOT_APPLIED, SURVIVED, KILLED = "NOT_APPLIED", "SURVIVED", "KILLED"


def small_world(spark: SparkSession, providers, tracts, edges) -> World:
    return World(
        spark.createDataFrame(providers, "provider_id string, supply int"),
        spark.createDataFrame(tracts, "tract_id string, population int"),
        spark.createDataFrame(edges, "provider_id string, tract_id string, minutes double"),
    )


def _column(spark: SparkSession, schema: str, rows: list[tuple], make) -> list:
    """A part on Columns, over a few rows in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    names = df.columns[1:]
    got = df.select("i", make(*[F.col(n) for n in names]).alias("out")).collect()
    return [r["out"] for r in sorted(got, key=lambda r: r["i"])]


def _by(df: DataFrame, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}


# --- parts ----------------------------------------------------------------------------


def _reached(edges, threshold):
    return catchment.reached(edges, threshold)


def _share(edges, tracts, threshold):
    return catchment.pop_share_by_band(edges, tracts, [threshold]).select("pop_share")


def _two_step(w: World, threshold):
    return catchment.two_step(w.edges, w.providers, w.tracts, [threshold])


def _chunked(w: World, threshold, n_chunks=1, scheme="even", order="original"):
    """(access by chunk, ratios, number of chunks accounted for); order is that in which
    chunks are emitted."""
    ratio = catchment.provider_ratio(w.edges, w.providers, w.tracts, [threshold])
    access = partitioning.chunked_access(w.edges, w.providers, w.tracts, threshold, n_chunks, scheme)
    return access, ratio, partitioning.chunk_accounting(access, n_chunks).count()


PARTS: dict[str, Callable] = {
    "reached": _reached,
    "pop_share": _share,
    "two_step": _two_step,
    "allocate": lambda df, total: allocate.allocate(df, total, "w"),
    "wald_ci": stats.wald_ci,
    "moe_factor": lambda: constants.MOE90_TO_CI95_FACTOR,
    "rurality": scalars.rurality,
    "safe_divide": scalars.safe_divide,
    "canon_id": scalars.canon_id,
    "contained": lambda inner, outer: geometry.disc_contained(inner, outer, F.lit(0.0), constants.TOL_GEOMETRY_FRACTION),
    "chunked": _chunked,
}


@dataclass(frozen=True)
class Mutant:
    description: str
    target: str
    make: Callable[[Callable], Callable]


def _unclamped(original):
    def part(x, n, confidence=0.95):
        z, p = constants.z_value(confidence), x / n
        half = z * F.sqrt(p * (1 - p) / n)
        return F.struct(p.alias("estimate"), (p - half).alias("lower"), (p + half).alias("upper"))

    return part


def _no_denominator(original):
    def part(w, threshold):
        ratio, _ = original(w, threshold)
        ratio = ratio.drop("ratio").join(w.providers.select("provider_id", F.col("supply").cast("double").alias("ratio")), "provider_id")
        return ratio, catchment.tract_access(w.edges, ratio, w.tracts, [threshold])

    return part


def _local_denominator(original):
    def part(w, threshold, n_chunks=1, scheme="even", order="original"):
        access, ratio, n = original(w, threshold, n_chunks, scheme, order)
        dealt = partitioning.assign_chunks(w.tracts, n_chunks, scheme)
        near = w.edges.where(F.col("minutes") <= threshold).join(dealt, "tract_id")
        own = near.groupBy("chunk", "provider_id").agg(F.sum("population").alias("people")).join(w.providers, "provider_id")
        own = own.select("chunk", "provider_id", F.try_divide("supply", "people").alias("r"))
        sums = near.join(own, ["chunk", "provider_id"]).groupBy("tract_id").agg(F.sum("r").alias("local"))
        return access.join(sums, "tract_id", "left").select("tract_id", "chunk", F.coalesce("local", F.lit(0.0)).alias("access")), ratio, n

    return part


def _edge_rows(access: DataFrame, last: bool) -> DataFrame:
    """The first or last tract of each chunk of more than one."""
    pick = F.max("tract_id") if last else F.min("tract_id")
    return access.groupBy("chunk").agg(pick.alias("tract_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("tract_id")


def _on_chunked(change):
    def make(original):
        def part(w, threshold, n_chunks=1, scheme="even", order="original"):
            return change(*original(w, threshold, n_chunks, scheme, order), order=order, n_chunks=n_chunks)

        return part

    return make


def _by_position(access, ratio, n, order, n_chunks):
    """Values in the order that chunks are emitted in, put beside identifiers in theirs."""
    emitted = F.col("chunk") if order == "original" else -F.col("chunk")
    values = partitioning.row_index(access.withColumn("__at", F.struct(emitted.alias("c"), "tract_id")), "__at", "pos").select("pos", "access")
    names = partitioning.row_index(access.select("tract_id", "chunk"), "tract_id", "pos")
    return names.join(values, "pos").select("tract_id", "chunk", "access"), ratio, n


def _first_provider(original):
    def part(w, threshold, n_chunks=1, scheme="even", order="original"):
        first = w.providers.agg(F.min("provider_id").alias("provider_id"))
        keep = w.providers.join(F.broadcast(first), "provider_id", "left_semi")
        return original(World(keep, w.tracts, w.edges.join(F.broadcast(first), "provider_id", "left_semi")), threshold, n_chunks, scheme, order)

    return part


CORE = {
    "strict_threshold": Mutant("a tract exactly on the threshold isn't reached", "reached", lambda o: lambda e, t: e.groupBy("tract_id").agg((F.min("minutes") < t).alias("reached"))),
    "swapped_bands": Mutant("the bands 30 and 60 are mixed up by the caller", "pop_share", lambda o: lambda e, tr, t: o(e, tr, {30: 60, 60: 30}.get(t, t))),
    "na_to_zero": Mutant("an undefined ratio becomes 0", "two_step", lambda o: lambda w, t: (o(w, t)[0].fillna(0.0, ["ratio"]), o(w, t)[1])),
    "dropped_denominator": Mutant("supply is taken for the ratio", "two_step", _no_denominator),
    "unweighted_mean": Mutant("the share counts tracts, not people", "pop_share", lambda o: lambda e, tr, t: tr.join(catchment.reached(e, t), "tract_id", "left").agg(F.avg(F.coalesce("reached", F.lit(False)).cast("double")).alias("pop_share"))),
    "lost_mass": Mutant("shares leak a thousandth", "allocate", lambda o: lambda df, total: o(df, total).withColumn("allocated", F.col("allocated") * 0.999)),
    "unclamped_ci": Mutant("an interval leaves 0..1", "wald_ci", _unclamped),
    "wrong_z": Mutant("the ratio of rounded quantiles", "moe_factor", lambda o: lambda: 1.96 / 1.65),
    "rurality_off_by_one": Mutant("code 4 counts as metropolitan", "rurality", lambda o: lambda c: F.when(c <= 4, "metro").when(c >= 5, "nonmetro")),
    "divide_by_zero_inf": Mutant("x / 0 is infinite", "safe_divide", lambda o: lambda n, d: F.when(d == 0, F.lit(float("inf"))).otherwise(o(n, d))),
    "id_drops_short": Mutant("short identifiers are rejected", "canon_id", lambda o: lambda x: F.when(~o(x).startswith("0"), o(x))),
    "containment_reversed": Mutant("the larger band is looked for in the smaller", "contained", lambda o: lambda inner, outer: o(outer, inner)),
}

CHUNKING = {
    "chunk_local_denominator": Mutant("step 1 sees one chunk's people", "chunked", _local_denominator),
    "drop_boundary_row": Mutant("each chunk loses its last tract", "chunked", _on_chunked(lambda a, r, n, **_: (a.join(_edge_rows(a, True), "tract_id", "left_anti"), r, n))),
    "duplicate_boundary_row": Mutant("each chunk gives its first tract twice", "chunked", _on_chunked(lambda a, r, n, **_: (a.unionByName(a.join(_edge_rows(a, False), "tract_id", "left_semi")), r, n))),
    "drop_empty_chunk": Mutant("empty chunks aren't accounted for", "chunked", _on_chunked(lambda a, r, n, **_: (a, r, a.select("chunk").distinct().count()))),
    "na_to_zero_on_bind": Mutant("an undefined ratio becomes 0 when parts are joined", "chunked", _on_chunked(lambda a, r, n, **_: (a, r.fillna(0.0, ["ratio"]), n))),
    "join_by_position": Mutant("parts are put together by place, not identifier", "chunked", _on_chunked(_by_position)),
    "first_chunk_providers_only": Mutant("one provider serves every chunk", "chunked", _first_provider),
    "reduction_overwrites": Mutant("only the last chunk is left", "chunked", _on_chunked(lambda a, r, n, **_: (a.join(a.agg(F.max("chunk").alias("chunk")), "chunk"), r, n))),
}


# --- probes ---------------------------------------------------------------------------


def _one_tract(spark, minutes, population=100):
    return small_world(spark, [("P1", 2)], [("T1", population)], [("P1", "T1", minutes)])


def _pair(spark):
    """Two tracts of unequal people, one in reach of each band."""
    return small_world(spark, [("P1", 3)], [("T1", 100), ("T2", 900)], [("P1", "T1", 20.0), ("P1", "T2", 50.0)])


def _line(spark):
    """Providers and tracts so that chunks matter: catchments cross every boundary."""
    tracts = [(f"T{i:02d}", 100 + 10 * i) for i in range(1, 13)]
    edges = [(p, t, float(10 * k + abs(5 * j - 3 * i))) for j, p in enumerate(("P1", "P2", "P3")) for i, (t, _) in enumerate(tracts) for k in (1,)]
    return small_world(spark, [("P1", 5), ("P2", 3), ("P3", 4), ("P9", 1)], tracts, edges)


def p_boundary(spark, x):
    assert _by(x["reached"](_one_tract(spark, 60.0).edges, 60.0), "tract_id", "reached") == {"T1": True}


def p_share_of_people(spark, x):
    w = _pair(spark)
    assert abs(x["pop_share"](w.edges, w.tracts, 30).first()[0] - 0.1) < 1e-12


def p_share_band(spark, x):
    w = _pair(spark)
    assert x["pop_share"](w.edges, w.tracts, 60).first()[0] == 1.0


def p_undefined_ratio(spark, x):
    assert _by(x["two_step"](_one_tract(spark, 10.0, 0), 60)[0], "provider_id", "ratio") == {"P1": None}


def p_ratio_has_denominator(spark, x):
    assert abs(_by(x["two_step"](_one_tract(spark, 10.0), 60)[1], "tract_id", "access")["T1"] - 0.02) < 1e-12


def p_allocation_conserves(spark, x):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 2.0)], "i int, w double")
    got = _by(x["allocate"](df, 30.0), "i", "allocated")
    assert abs(sum(got.values()) - 30) < 1e-9 and got[2] == 0


def p_interval_in_range(spark, x):
    for r in _column(spark, "x double, n double", [(0.0, 10.0), (1.0, 10.0), (10.0, 10.0)], x["wald_ci"]):
        assert 0 <= r["lower"] <= r["upper"] <= 1


def p_moe(spark, x):
    assert abs(x["moe_factor"]() - 1.1915735) < 1e-6


def p_rurality(spark, x):
    assert _column(spark, "c double", [(3.0,), (4.0,), (None,)], x["rurality"]) == ["metro", "nonmetro", None]


def p_division(spark, x):
    assert _column(spark, "n double, d double", [(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], x["safe_divide"]) == [None, None, 0.5]


def p_short_id(spark, x):
    assert _column(spark, "s string", [("123456789",), ("1234567890",)], x["canon_id"]) == ["0123456789", "1234567890"]


def p_containment(spark, x):
    assert _column(spark, "a double, b double", [(30.0, 60.0), (60.0, 30.0)], x["contained"]) == [True, False]


def _truth(spark):
    w = _line(spark)
    return w, _by(catchment.two_step(w.edges, w.providers, w.tracts, [25])[1], "tract_id", "access")


def _same(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 for k in want)


def c_invariant(spark, x):
    w, want = _truth(spark)
    assert _same(_by(x["chunked"](w, 25, 3)[0], "tract_id", "access"), want)


def c_once_each(spark, x):
    w, want = _truth(spark)
    assert sorted(r["tract_id"] for r in x["chunked"](w, 25, 4)[0].collect()) == sorted(want)


def c_reversed(spark, x):
    w, want = _truth(spark)
    assert _same(_by(x["chunked"](w, 25, 3, "even", "reversed")[0], "tract_id", "access"), want)


def c_all_chunks(spark, x):
    assert x["chunked"](_line(spark), 25, 5, "uneven")[2] == 5


def c_undefined_stays(spark, x):
    assert _by(x["chunked"](_line(spark), 25, 2)[1], "provider_id", "ratio")["P9"] is None


def c_every_provider(spark, x):
    w, want = _truth(spark)
    people = {r["tract_id"]: r["population"] for r in w.tracts.collect()}
    got = _by(x["chunked"](w, 25, 2)[0], "tract_id", "access")
    assert abs(sum(got.get(t, 0) * n for t, n in people.items()) - 12) < 1e-9


PROBES = {
    "boundary": (p_boundary, "reached"),
    "share_of_people": (p_share_of_people, "pop_share"),
    "share_band": (p_share_band, "pop_share"),
    "undefined_ratio": (p_undefined_ratio, "two_step"),
    "ratio_has_denominator": (p_ratio_has_denominator, "two_step"),
    "allocation_conserves": (p_allocation_conserves, "allocate"),
    "interval_in_range": (p_interval_in_range, "wald_ci"),
    "moe": (p_moe, "moe_factor"),
    "rurality": (p_rurality, "rurality"),
    "division": (p_division, "safe_divide"),
    "short_id": (p_short_id, "canon_id"),
    "containment": (p_containment, "contained"),
    "chunk_invariant": (c_invariant, "chunked"),
    "chunk_once_each": (c_once_each, "chunked"),
    "chunk_reversed": (c_reversed, "chunked"),
    "chunk_all": (c_all_chunks, "chunked"),
    "chunk_undefined": (c_undefined_stays, "chunked"),
    "chunk_every_provider": (c_every_provider, "chunked"),
}


# --- witnesses --------------------------------------------------------------------------


def _rows(df: DataFrame) -> list:
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def _witness(spark: SparkSession, target: str, part: Callable):
    """What a part answers on inputs on which its mutants must answer otherwise."""
    if target == "reached":
        return _rows(part(_one_tract(spark, 60.0).edges, 60.0))
    if target == "pop_share":
        w = _pair(spark)
        return _rows(part(w.edges, w.tracts, 30))
    if target == "two_step":
        return [_rows(df) for df in part(_one_tract(spark, 10.0, 0), 60)] + [_rows(df) for df in part(_one_tract(spark, 10.0), 60)]
    if target == "allocate":
        return _rows(part(spark.createDataFrame([(1, 1.0), (2, 3.0)], "i int, w double"), 8.0))
    if target == "moe_factor":
        return part()
    if target == "chunked":
        a, r, _ = part(_line(spark), 25, 3, "even", "reversed")
        return _rows(a), _rows(r), part(_line(spark), 25, 5, "uneven")[2]
    inputs = {
        "wald_ci": ("x double, n double", [(0.0, 10.0), (1.0, 10.0)]),
        "rurality": ("c double", [(4.0,), (3.5,), (3.0,)]),
        "safe_divide": ("n double, d double", [(1.0, 0.0)]),
        "canon_id": ("s string", [("12345",)]),
        "contained": ("a double, b double", [(30.0, 60.0)]),
    }
    return _column(spark, *inputs[target], part)


# --- runner -----------------------------------------------------------------------------


@contextmanager
def installed(parts: dict[str, Callable], mutant: Mutant):
    """parts with a mutant in its place, put back whatever happens."""
    original = parts[mutant.target]
    parts[mutant.target] = mutant.make(original)
    try:
        yield parts
    finally:
        parts[mutant.target] = original


def run(spark: SparkSession, mutants: dict[str, Mutant]) -> list[dict]:
    """A row (mutant, description, activated, killed, killed_by, outcome) for each mutant.
    Probes of its part must pass on the clean parts; an error that isn't a failed assertion
    is raised."""
    parts, rows = dict(PARTS), []
    clean: dict[str, object] = {}
    for name, m in mutants.items():
        probes = {k: f for k, (f, part) in PROBES.items() if part == m.target}
        if m.target not in clean:
            for f in probes.values():
                f(spark, parts)
            clean[m.target] = _witness(spark, m.target, parts[m.target])
        by = None
        with installed(parts, m):
            active = _witness(spark, m.target, parts[m.target]) != clean[m.target]
            for k, f in probes.items() if active else ():
                try:
                    f(spark, parts)
                except AssertionError:
                    by = k
                    break
        rows.append({"mutant": name, "description": m.description, "activated": active, "killed": by is not None, "killed_by": by, "outcome": KILLED if by else SURVIVED if active else NOT_APPLIED})
    return rows


def report(spark: SparkSession, mutants: dict[str, Mutant] | None = None) -> DataFrame:
    rows = run(spark, CORE | CHUNKING if mutants is None else mutants)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "mutant string, description string, activated boolean, killed boolean, killed_by string, outcome string")
