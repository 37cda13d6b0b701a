"""The analytics operators against hand-computed cases, goldens and invariants."""

import csv
import math
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catchment_engine import bands, schemas
from catchment_engine.functions import geometry, scalars, stats
from catchment_engine.operators import allocate, catchment, partitioning, quality, relational, survival, trend
from catchment_engine.plans import accounting, mutation
from catchment_engine.plans.mutation import small_world
from catchment_engine.sources import files, worlds

DATA = Path(__file__).parent / "data"


def column(spark, schema, rows, make):
    return mutation._column(spark, schema, rows, make)


def access_of(w, threshold):
    ratio, access = catchment.two_step(w.edges, w.providers, w.tracts, [threshold])
    return {r["provider_id"]: r["ratio"] for r in ratio.collect()}, {r["tract_id"]: r["access"] for r in access.collect()}


def one(spark, minutes, population=100, supply=2):
    return small_world(spark, [("P1", supply)], [("T1", population)], [("P1", "T1", minutes)])


# --- goldens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def golden_world(spark):
    return files.read_world(spark, str(DATA))


def test_golden_by_band(golden_world):
    w = golden_world
    got = {r["band_min"]: r for r in catchment.band_summary(w.edges, w.providers, w.tracts).collect()}
    for row in csv.DictReader((DATA / "golden_by_band.csv").open()):
        r = got[int(float(row["band_min"]))]
        for name, value in row.items():
            assert math.isclose(r[name], float(value), rel_tol=1e-12, abs_tol=1e-15), name


def test_golden_tracts(golden_world):
    w = golden_world
    _, got = access_of(w, bands.PRIMARY_ACCESS_BAND_MIN)
    rows = list(csv.DictReader((DATA / "golden_tracts_60.csv").open()))
    assert len(rows) == len(got) == 25
    assert all(math.isclose(got[r["tract_id"]], float(r["access_60"]), rel_tol=1e-12, abs_tol=1e-15) for r in rows)


def test_golden_world_keeps_its_contract(golden_world):
    assert quality.validate(golden_world, complete=True).collect() == []


def test_golden_drift(spark, golden_world):
    again = files.read_csv(spark, str(DATA / "tracts.csv"), schemas.TRACTS)
    assert not any(r["drifted"] for r in quality.drift_report(again, golden_world.tracts, ["tract_id"]).collect())
    moved = again.withColumn("population", F.col("population") + 1)
    assert [r["column"] for r in quality.drift_report(moved, golden_world.tracts, ["tract_id"]).collect() if r["drifted"]] == ["population"]


def test_haversine_of_golden_world(golden_world):
    w = golden_world
    p = w.providers.select("provider_id", F.col("lon").alias("a"), F.col("lat").alias("b"))
    t = w.tracts.select("tract_id", "lon", "lat")
    d = w.edges.join(p, "provider_id").join(t, "tract_id").select(F.abs(F.col("km") - geometry.haversine_km(F.col("a"), F.col("b"), F.col("lon"), F.col("lat"))).alias("d"))
    assert d.agg(F.max("d")).first()[0] < 1e-9


# --- small worlds -----------------------------------------------------------------------


@pytest.mark.parametrize(("threshold", "in_reach"), [(60.0, True), (59.999, False)])
def test_threshold_is_inclusive(spark, threshold, in_reach):
    assert catchment.reached(one(spark, 60.0).edges, threshold).first()["reached"] is in_reach


def test_thresholds_must_be_positive(spark):
    w = one(spark, 1.0)
    for f in (lambda: catchment.reached(w.edges, 0), lambda: catchment.provider_ratio(w.edges, w.providers, w.tracts, [-1])):
        with pytest.raises(ValueError):
            f()


def test_zero_isnt_undefined(spark):
    assert access_of(one(spark, 999.0), 60) == ({"P1": None}, {"T1": 0.0})
    assert access_of(one(spark, 10.0, 0), 60) == ({"P1": None}, {"T1": 0.0})
    w = one(spark, 999.0, 0)
    assert catchment.pop_share_by_band(w.edges, w.tracts, [60]).first()["pop_share"] is None
    w = one(spark, 999.0)
    assert catchment.pop_share_by_band(w.edges, w.tracts, [60]).first()["pop_share"] == 0.0


def test_two_providers_and_ties(spark):
    w = small_world(spark, [("P1", 2), ("P2", 3)], [("T1", 100)], [("P1", "T1", 5.0), ("P2", "T1", 5.0)])
    assert math.isclose(access_of(w, 60)[1]["T1"], 0.05)


def test_no_edges(spark):
    w = small_world(spark, [("P1", 1)], [("T1", 5)], [("P1", "T1", 1.0)])
    none = w.edges.where("minutes > 5")
    assert catchment.reached(none, 60).collect() == []
    assert [r["access"] for r in catchment.two_step(none, w.providers, w.tracts, [60])[1].collect()] == [0.0]


def test_tract_without_edges(spark):
    w = small_world(spark, [("P1", 1)], [("T1", 5), ("T2", 15)], [("P1", "T1", 1.0)])
    assert catchment.pop_share_by_band(w.edges, w.tracts, [60]).first()["pop_share"] == 0.25
    assert access_of(w, 60)[1] == {"T1": 0.2, "T2": 0.0}


@pytest.fixture(scope="module", params=[1, 2, 3])
def random_world(spark, request):
    w = worlds.make_world(spark, request.param, 6 + request.param, 20, 1, 2, request.param == 2)
    return worlds.World(w.providers.cache(), w.tracts.cache(), w.edges.cache(), w.meta)


def test_random_worlds(random_world):
    w = random_world
    assert quality.validate(w, complete=True).collect() == []
    shares = {r["band"]: r["pop_share"] for r in catchment.pop_share_by_band(w.edges, w.tracts).collect()}
    in_order = [shares[float(b)] for b in bands.CANONICAL_BANDS]
    assert in_order == sorted(in_order) and all(0 <= s <= 1 for s in in_order)
    ratio, access = catchment.two_step(w.edges, w.providers, w.tracts)
    for r in catchment.supply_conservation(ratio, access, w.providers).collect():
        assert (r["used_supply"] or 0) == pytest.approx(r["weighted_access"], rel=1e-9)
    assert catchment.isolation(w.edges, w.providers).where("isolated").count() >= 1
    lost = {r["provider_id"]: r["tracts_lost"] for r in catchment.leave_one_out(w.edges, w.tracts, 120).collect()}
    near = w.edges.where("minutes <= 120")
    before = near.select("tract_id").distinct().count()
    for p in list(lost)[:2]:
        assert before - catchment.without_provider(near, p).select("tract_id").distinct().count() == lost[p]


def test_worlds_depend_on_seed_and_keys_alone(spark):
    rows = lambda w: [sorted(map(tuple, df.collect())) for df in (w.providers, w.tracts, w.edges)]
    a, b, c = rows(worlds.make_world(spark, 5)), rows(worlds.make_world(spark, 5)), rows(worlds.make_world(spark, 6))
    assert a == b and a != c
    ratio = [r[2] * 70 / 60 / r[3] for r in a[2] if r[3]]
    assert 1.0 <= min(ratio) and max(ratio) <= 1.6
    with pytest.raises(ValueError):
        worlds.make_world(spark, 1, 2, 2, isolated=3)


def test_metamorphic(spark, random_world):
    w = random_world
    _, want = access_of(w, 120)
    shuffled = worlds.World(w.providers, relational.shuffled(w.tracts, 9, ["tract_id"]), w.edges.repartition(7))
    assert access_of(shuffled, 120)[1] == pytest.approx(want, rel=1e-12)
    names = w.tracts.select(F.col("tract_id").alias("old"), F.concat(F.lit("N"), F.col("tract_id")).alias("new"))
    renamed = worlds.World(w.providers, relational.relabel(w.tracts, names, "tract_id"), relational.relabel(w.edges, names, "tract_id"))
    assert {k[1:]: v for k, v in access_of(renamed, 120)[1].items()} == pytest.approx(want, rel=1e-12)
    scaled = worlds.World(w.providers, relational.scaled(w.tracts, "population", 3.0), w.edges)
    assert {k: 3 * v for k, v in access_of(scaled, 120)[1].items()} == pytest.approx(want, rel=1e-12)
    twice = worlds.World(w.providers, w.tracts, catchment.dedupe_edges(w.edges.unionByName(w.edges)))
    assert access_of(twice, 120)[1] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("scheme", partitioning.SCHEMES)
@pytest.mark.parametrize("k", [1, 2, 3, 30])
def test_chunks_cover_and_change_nothing(random_world, scheme, k):
    w = random_world
    dealt = partitioning.assign_chunks(w.tracts, k, scheme)
    sizes = {r["chunk"]: r["n_items"] for r in partitioning.chunk_accounting(dealt, k).collect()}
    assert sorted(sizes) == list(range(1, k + 1)) and sum(sizes.values()) == w.tracts.count()
    if scheme == "uneven" and k >= 2:
        assert sizes[1] == 0 and (k == 2 or sizes[2] == 1)
    if k == 3:
        got = {r["tract_id"]: r["access"] for r in partitioning.chunked_access(w.edges, w.providers, w.tracts, 120, k, scheme).collect()}
        assert got == pytest.approx(access_of(w, 120)[1], rel=1e-12)


def test_catchment_across_chunks(spark):
    tracts = [(f"T{i:02d}", 100) for i in range(60)]
    w = small_world(spark, [("P1", 10)], tracts, [("P1", t, 10.0) for t, _ in tracts])
    got = partitioning.chunked_access(w.edges, w.providers, w.tracts, 60, 7).collect()
    assert len(got) == 60 and all(math.isclose(r["access"], 10 / 6000) for r in got)


def test_validation_finds_everything(spark):
    w = small_world(spark, [("P1", 1), ("P1", 2), ("P2", -1)], [("T1", None), ("T2", 1)], [("P1", "T1", None), ("P9", "T1", 1.0), ("P1", "T9", float("nan")), ("P1", "T2", 1.0), ("P1", "T2", 2.0)])
    rules = {r["rule"] for r in quality.validate(w, complete=True).collect()}
    assert rules == {"duplicate_provider", "duplicate_edge", "bad_supply", "bad_population", "bad_minutes", "unknown_tract", "unknown_provider", "incomplete_matrix"}


# --- shares, statistics, survival -------------------------------------------------------


def test_allocation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 1.0), (4, 1.0)], "i int, w double")
    assert sum(r["allocated"] for r in allocate.allocate(df, 10.0, "w").collect()) == pytest.approx(10)
    whole = {r["i"]: r["allocated"] for r in allocate.allocate_integer(df, 10, "w", ["i"]).collect()}
    assert whole == {1: 4, 2: 0, 3: 3, 4: 3}
    for rows in ([(1, None), (2, 1.0)], [(1, -1.0), (2, 2.0)], [(1, 0.0)]):
        with pytest.raises(Exception, match="allocation"):
            allocate.allocate(spark.createDataFrame(rows, "i int, w double"), 1.0, "w").select("allocated").collect()


def test_normal_tail(spark):
    xs = [-8.0, -3.0, -0.5, 0.0, 0.1, 0.4, 0.46875, 0.5, 1.2, 3.9, 4.0, 4.1, 10.0, 26.0]
    for x, y in zip(xs, column(spark, "x double", [(x,) for x in xs], stats.erfc), strict=True):
        assert y == pytest.approx(math.erfc(x), rel=1e-13)


def test_intervals(spark):
    (w,) = column(spark, "x double, n double", [(10.0, 100.0)], stats.wilson_ci)
    assert (w["lower"], w["upper"]) == pytest.approx((0.0552291, 0.1743657), abs=1e-6)
    rows = column(spark, "x double, n double", [(0.0, 5.0), (5.0, 5.0), (6.0, 5.0), (0.0, 0.0)], stats.wald_ci)
    assert [r and (r["lower"], r["upper"]) for r in rows] == [(0.0, 0.0), (1.0, 1.0), None, None]


def test_two_proportions(spark):
    args = "a int, b int, c int, d int"
    (y,) = column(spark, args, [(10, 100, 20, 100)], stats.two_prop_yates)
    (z,) = column(spark, args, [(10, 100, 20, 100)], stats.two_prop_z)
    assert (y["p"], z["p"]) == pytest.approx((0.0747059, 0.0476704), abs=1e-7)
    (same,) = column(spark, args, [(5, 10, 5, 10)], stats.two_prop_yates)
    assert (same["chisq"], same["p"]) == (0.0, 1.0)
    none = column(spark, args, [(0, 10, 0, 10)], stats.two_prop_z) + column(spark, args, [(0, 10, 0, 10)], stats.two_prop_yates)
    assert all(v is None for r in none for v in r)
    (big,) = column(spark, args, [(40000, 90000, 41000, 90000)], stats.two_prop_yates)
    assert 0 < big["p"] < 1e-5


def test_trend(spark):
    df = spark.createDataFrame([(g, x, y) for g, ys in (("line", [3 * x for x in range(11)]), ("noise", [1, 3, 2, 5, 4, 6, 8, 7, 9, 9, 12])) for x, y in enumerate(ys)] + [("flat", 1, 2), ("flat", 1, 3), ("two", 0, 1), ("two", 1, 2)], "g string, x int, y int")
    got = {r["g"]: r for r in trend.annual_trend(df, "x", "y", ["g"]).collect()}
    assert got["line"]["slope"] == pytest.approx(3) and got["line"]["lo"] == pytest.approx(3) and got["line"]["p"] == 0
    n = got["noise"]
    exact = statistics.linear_regression(range(11), [1, 3, 2, 5, 4, 6, 8, 7, 9, 9, 12]).slope
    assert n["lo"] < n["slope"] < n["hi"] and n["slope"] == pytest.approx(exact) and 0 <= n["p"] < 1e-4
    assert got["flat"]["slope"] is None and got["two"]["slope"] == pytest.approx(1) and got["two"]["p"] is None
    slopes = {r["g"]: r["s"] for r in df.groupBy("g").agg(stats.ols_slope("x", "y").alias("s")).collect()}
    assert slopes["noise"] == pytest.approx(n["slope"]) and slopes["flat"] is None
    assert trend.t_quantile(5, 0.95) == pytest.approx(2.5705818, abs=1e-6) and trend.t_quantile(30, 0.95) == pytest.approx(2.0422725, abs=1e-6)


def test_monte_carlo(spark):
    df = spark.createDataFrame([(i, 0.1 * i, 0.05, 10.0 + i) for i in range(8)], "k int, est double, se double, w double")
    one, two, other = (trend.mc_weighted_ci(d, "est", "se", "w", 300, s, "k").first() for d, s in ((df, 1), (df.repartition(5), 1), (df, 2)))
    assert tuple(one) == pytest.approx(tuple(two)) and tuple(one) != tuple(other) and one["lo"] <= one["point"] <= one["hi"]


def test_survival(spark):
    h = [0.1, 0.2, 0.0, 0.5, 1.0]
    df = spark.createDataFrame([(60 + i, x) for i, x in enumerate(h)], "age int, annual_hazard double")
    curve = survival.survival_curve(df)
    got = [r["survival"] for r in curve.orderBy("age").collect()]
    assert got == pytest.approx([0.9, 0.72, 0.72, 0.36, 0.0])
    assert [r["hazard"] for r in survival.hazard_from_survival(curve).orderBy("age").collect()] == pytest.approx(h)
    assert survival.violations(curve).collect() == []
    assert survival.anchor_spread(curve).first()["spread"] < 1e-12
    with pytest.raises(Exception, match="hazard"):
        survival.survival_curve(df.withColumn("annual_hazard", F.lit(1.5))).collect()
    later = survival.survival_curve(survival.shift_hazard(df, 2))
    both = survival.align([curve, later], "survival", ["now", "later"]).collect()
    assert all(r["later"] >= r["now"] for r in both)


# --- scalars and geometry ---------------------------------------------------------------


def test_canon_id(spark):
    cases = {"1234567890": "1234567890", "123456789": "0123456789", " 12-34.56 7890 ": "1234567890", "(123)456": "0000123456"}
    cases |= dict.fromkeys(["abc1234567", "1.23e9", "", None, "12345678901", " ", "abc", "1.5e9", "-1234567890"])
    assert column(spark, "s string", [(k,) for k in cases], scalars.canon_id) == list(cases.values())


def test_rurality_and_division(spark):
    codes = [1.0, 2.0, 3.0, 3.5, 4.0, 5.0, 10.0, 99.0, 0.0, None, float("nan")]
    assert column(spark, "c double", [(c,) for c in codes], scalars.rurality) == ["metro"] * 3 + [None] + ["nonmetro"] * 4 + ["metro", None, None]
    rows = [(1.0, 2.0), (0.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (float("nan"), 1.0)]
    assert column(spark, "n double, d double", rows, scalars.safe_divide) == [0.5, 0.0, None, None, None, None, None]


def test_clip_and_discs(spark):
    square = lambda x: geometry.square(x, F.lit(0.0), 1.0)
    clipped = column(spark, "x double", [(0.0,), (1.0,), (2.5,)], lambda x: geometry.area(geometry.clip_convex(square(x), square(F.lit(0.0)))))
    assert clipped == pytest.approx([4.0, 2.0, 0.0])
    inside = column(spark, "a double, b double, d double", [(1.0, 2.0, 0.0), (2.0, 1.0, 0.0), (1.0, 2.0, 1.5), (0.0, 1.0, 9.0)], lambda a, b, d: geometry.disc_contained(a, b, d, 1e-6))
    assert inside == [True, False, False, True]
    (ring,) = column(spark, "r double", [(10.0,)], lambda r: geometry.area(geometry.disc(F.lit(0.0), F.lit(0.0), r)))
    assert ring == pytest.approx(60 * 100 * math.sin(math.pi / 60))


# --- quality and accounting -------------------------------------------------------------


def test_numeric_diff(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan")), ("d", 2.0), ("e", 1e-3), ("x", 1.0)], "k string, v double")
    b = spark.createDataFrame([("a", 1.0 + 1e-12), ("b", None), ("c", None), ("d", None), ("e", 1.001e-3), ("y", 1.0)], "k string, v double")
    assert {r["k"] for r in quality.numeric_diff(a, b, ["k"], "v").collect()} == {"d", "e", "x", "y"}
    assert {r["k"] for r in quality.numeric_diff(a, b, ["k"], "v", 1e-5).collect()} == {"d", "x", "y"}
    assert {r["k"] for r in quality.numeric_diff(a, b, ["k"], "v", 1e-5, relative=True).collect()} == {"d", "e", "x", "y"}
    assert quality.format_diff(quality.numeric_diff(a, a, ["k"], "v")) == "(no differences)"


def test_accounting(tmp_path):
    run = accounting.RunAccounting(str(tmp_path), ["a.py", "b.py"])
    run.start()
    assert accounting.verify_accounting(str(tmp_path))
    run.record("a.py", "t", passed=3)
    run.record("b.py", "t")
    run.finish()
    assert accounting.verify_accounting(str(tmp_path)) == ["b.py asserts nothing"]
    assert accounting.verify_accounting(str(tmp_path), 9)[-1].startswith("3 assertions")
    with pytest.raises(accounting.MissingDependency):
        accounting.require_dependency("no_such_module_here")


def test_golden_store(spark, tmp_path):
    store = files.GoldenStore(str(tmp_path))
    df = spark.createDataFrame([(2, 0.5), (1, None)], "k int, v double")
    text = store.render(df, ["k"])
    assert text == "k,v\n1,\n2,0.5\n"
    assert store.write("g.csv", text) and not (tmp_path / "g.csv").exists()
    store.write("g.csv", text, accept=True)
    assert store.write("g.csv", text) == [] and store.write("g.csv", "created: now\n" + text) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_csv(spark, str(tmp_path / "none.csv"), schemas.TRACTS).collect()


def test_constants():
    assert bands.get_canonical_bands() == bands.CANONICAL_BANDS and bands.PRIMARY_ACCESS_BAND_SEC == 3600
    assert len(set(bands.CONUS_STATE_ABBR)) == 49 and not {*bands.CONUS_STATE_ABBR} & {*bands.NON_CONTIGUOUS_CODES}
    assert bands.MOE90_TO_CI95_FACTOR == pytest.approx(1.1915735, abs=1e-7)


def test_every_mutant_is_noticed(spark):
    rows = mutation.run(spark, mutation.CORE | mutation.CHUNKING)
    assert len(rows) == 20 and {r["outcome"] for r in rows} == {mutation.KILLED}, [r for r in rows if r["outcome"] != mutation.KILLED]


def test_mutants_are_taken_out_again(spark):
    parts = dict(mutation.PARTS)
    with pytest.raises(RuntimeError), mutation.installed(parts, mutation.CORE["wrong_z"]):
        raise RuntimeError
    assert parts == mutation.PARTS
