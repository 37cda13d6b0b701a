"""Places, allocation, worker plans and validators: small cases with hot groups, ties and nulls."""

import json
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from catchment_engine import queries
from catchment_engine.functions import geometry
from catchment_engine.operators import allocate, catchment, partitioning, quality, relational, survival
from catchment_engine.sources import star_world, worlds

SF = "/root/testdata/sf0.001"


def test_places_within_groups(spark):
    """A hot group, small ones and a null one; ties in the first key."""
    r = random.Random(1)
    rows = [(g, r.randrange(50), k) for k, g in enumerate(["hot"] * 5000 + ["a", "b", None] * 20)]
    df = spark.createDataFrame(rows, "g string, x int, k int").repartition(7)
    got = {(row["g"], row["k"]): row["idx"] for row in partitioning.placed(df, [-F.col("x"), F.col("k")], ["g"]).collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        for place, (x, k) in enumerate(sorted(((-x, k) for h, x, k in rows if h == g)), 1):
            want[g, k] = place
    assert got == want
    whole = [row["k"] for row in partitioning.placed(df, [F.col("x"), F.col("k")]).orderBy("idx").collect()]
    assert whole == [k for _, k in sorted((x, k) for _, x, k in rows)]


def test_places_of_no_rows(spark):
    assert partitioning.row_index(spark.createDataFrame([], "k int"), "k").count() == 0


def test_allocation_without_a_group(spark):
    """Conserved, whole and by largest remainder, whatever the partitions."""
    rows = [(k, (k * 37) % 11) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, w int").repartition(9)
    total = 100_003
    out = {r["k"]: r["allocated"] for r in allocate.allocate_integer(df, total, "w", ["k"]).collect()}
    weight = sum(w for _, w in rows)
    exact = {k: float(total) * w / weight for k, w in rows}
    left = total - sum(int(x) for x in exact.values())
    first = {k for _, k in sorted((-(x - int(x)), k) for k, x in exact.items())[:left]}
    assert out == {k: int(x) + (k in first) for k, x in exact.items()}
    plan = allocate.allocate_integer(df, total, "w", ["k"])._jdf.queryExecution().executedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line]
    assert ranks and all("windowspecdefinition(__part#" in line for line in ranks)


@pytest.mark.parametrize("bad", [None, -1])
def test_allocation_refuses(spark, bad):
    df = spark.createDataFrame([(1, 2), (2, bad)], "k int, w int")
    with pytest.raises(Exception, match="allocation"):
        allocate.allocate(df, 5.0, "w").collect()


def test_weights(spark):
    check = lambda rows: allocate.weights_check(spark.createDataFrame(rows, "k string, w double"), "k", "w", 2).first()
    assert check([("a", 0.25), ("b", 0.75)])[3:] == (True, True)
    assert check([("a", 0.25), ("a", 0.75)])[3:] == (False, True)
    assert check([("a", 0.25), ("b", 0.5)])[3:] == (True, False)
    assert check([("a", 1.5), ("b", -0.5)])[3:] == (False, True)
    assert check([])[3:] == (False, False)


def test_providers_without_edges(spark):
    """Suppliers that nobody reaches: isolated, unused and without a ratio."""
    w = star_world.world(spark, SF)
    p = w.providers.unionByName(spark.createDataFrame([(-1, 3), (-2, 4)], "provider_id long, supply int"))
    alone = {r["provider_id"]: r["isolated"] for r in catchment.isolation(w.edges, p).collect()}
    assert alone[-1] and alone[-2] and len(alone) == p.count()
    ratio = {r["provider_id"]: r["ratio"] for r in catchment.provider_ratio(w.edges, p, w.tracts, [60]).collect()}
    assert ratio[-1] is None and ratio[-2] is None


def test_partitions_and_workers_have_no_say(spark):
    """Chunked scores with 1, 2, 7 and 60 shuffle partitions and chunks, in either order."""
    world = worlds.make_world(spark, 3, 12, 90, isolated=2, zero_pop=4)
    pairs = worlds.travel_matrix(world.providers, world.tracts, 5)
    _, whole = catchment.two_step(pairs, world.providers, world.tracts, [60])
    want = {r["tract_id"]: r["access"] for r in whole.collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r["tract_id"]: r["access"] for r in partitioning.chunked_access(pairs, world.providers, world.tracts, 60, n, "uneven").collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_worker_plan(spark):
    tracts = spark.range(1, 61).select(F.col("id").alias("tract_id"))
    for order in ("forward", "reverse"):
        rows = partitioning.worker_plan(tracts, 7, 3, order=order).collect()
        assert len(rows) == 60 and {r["worker"] for r in rows} == {1, 2, 3}
        assert {r["chunk"]: r["turn"] for r in rows} == {c: ((c if order == "forward" else 8 - c) - 1) // 3 + 1 for c in range(1, 8)}
    with pytest.raises(ValueError):
        partitioning.worker_plan(tracts, 7, 3, order="random")


def test_seeded_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    at = lambda seed: {r["k"]: r["place"] for r in relational.seeded_place(df.repartition(5), worlds.uniform(seed, F.col("k")), "k").collect()}
    assert at(1) == at(1) and at(1) != at(2) and sorted(at(2).values()) == list(range(1, 501))


def test_careers(spark):
    arc = lambda name, f: [(name, a, f(a)) for a in range(35, 81)]
    good = lambda a: 1 - abs(a - 48) / 40
    rows = arc("good", good) + arc("flat", lambda a: 0.5) + arc("late", lambda a: a / 80) + arc("big", lambda a: 2 * good(a)) + arc("zero", lambda a: good(a) if a < 80 else 0.0)
    got = {(r["who"], r["rule"]) for r in survival.career_violations(spark.createDataFrame(rows, "who string, age int, w double"), "w", ["who"]).collect()}
    assert got == {("flat", "peak_at_end"), ("flat", "peak_age"), ("flat", "no_ramp"), ("flat", "no_taper"), ("late", "peak_at_end"), ("late", "peak_age"), ("late", "no_taper"), ("big", "not_a_share"), ("zero", "not_a_share")}


def test_survival_look_up(spark):
    curve = survival.survival_curve(spark.createDataFrame([("f", 40, 0.1), ("f", 41, 0.2), ("m", 40, 0.5)], "sex string, age int, annual_hazard double"), ["sex"])
    ages = spark.createDataFrame([("f", 41), ("m", 40), ("m", 41)], "sex string, age int")
    got = {(r["sex"], r["age"]): r["survival"] for r in survival.survival_at(curve, ages, ["sex"]).collect()}
    assert got == {("f", 41): pytest.approx(0.72), ("m", 40): 0.5, ("m", 41): None}


def test_vocabulary(spark):
    flaws = lambda words: sorted(map(tuple, quality.vocabulary_violations(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()), key=str)
    assert flaws(["a", "b"]) == [] and flaws([]) == [("empty", None, 0)]
    assert flaws(["a", "a", " ", None, None]) == [("blank", " ", 1), ("blank", None, 2), ("repeated", "a", 2), ("repeated", None, 2)]


def test_ring_difference(spark):
    square = lambda h: geometry.square(F.lit(0.0), F.lit(0.0), h)
    empty = F.slice(square(1.0), 1, 0)
    moved = geometry.square(F.lit(1.0), F.lit(0.0), 1.0)
    shares = [geometry.outside_share(a, b) for a, b in ((square(1.0), square(2.0)), (square(2.0), square(1.0)), (square(1.0), moved), (empty, square(1.0)), (square(1.0), empty))]
    assert list(spark.range(1).select(*[s.alias(f"s{i}") for i, s in enumerate(shares)]).first()) == pytest.approx([0, 0.75, 0.5, 0, 1])
    assert spark.range(1).select(geometry.ring_contained(square(1.0), square(1.0 - 1e-8), 1e-6)).first()[0]


def test_rings_are_computed_once(spark):
    """A plan names each clip and area once: copies nested in lambdas multiply the work."""
    corner = lambda h: geometry.disc(F.col("id") * 1.0, F.lit(0.0), F.lit(h), 16)
    for shape, most in ((geometry.outside_share(corner(1.0), corner(2.0)), 3), (geometry.area(geometry.clip_convex(corner(1.0), corner(2.0))), 2)):
        plan = spark.range(1).select(shape.alias("s"))._jdf.queryExecution().optimizedPlan()
        assert plan.toString().count("aggregate(") <= most
    assert queries.band_containment(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 6
    assert queries.square_overlap(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4


def test_containment_of_a_repeated_provider(spark, tmp_path):
    """Three rows for each of a provider's rows, each by a band and the next one."""
    spark.createDataFrame([(1,), (1,), (2,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, queries.band_containment(spark, str(tmp_path)).collect()))
    want = [(30, 60, True, False, 0.75), (60, 120, True, False, 0.75), (120, 180, True, False, 0.555555556)]
    assert got == sorted((k, *w) for k in (1, 1, 2) for w in want)


def test_clips_of_any_ring(spark):
    """Rings that cross, touch, hold or miss a convex one, star-shaped ones too, as a plain
    Sutherland-Hodgman has them."""
    r = random.Random(5)

    def ring(n, size, spread):
        x, y = r.uniform(-spread, spread), r.uniform(-spread, spread)
        out = [(x + (f := size * r.uniform(0.4, 1.0) if n % 2 else size) * math.cos(2 * math.pi * k / n), y + f * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [*out, out[0]]

    def clip(ring, window):
        out = ring[:-1]
        for a, b in zip(window, window[1:], strict=False):
            side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
            left = []
            for i, p in enumerate(out):
                q, s, e = out[(i + 1) % len(out)], side[i], side[(i + 1) % len(out)]
                left += [p] if s >= 0 else []
                left += [(p[0] + s / (s - e) * (q[0] - p[0]), p[1] + s / (s - e) * (q[1] - p[1]))] if (s >= 0) != (e >= 0) else []
            out = left
        return [*out, out[0]] if out else []

    pairs = [(ring(r.choice((3, 5, 8, 9)), r.choice((0.3, 1.0, 3.0)), 1.2), ring(r.choice((4, 6, 16)), 1.0, 0.2)) for _ in range(300)]
    pairs += [(w, w) for _, w in pairs[:5]]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {row["k"]: (list(map(tuple, row["c"])), row["s"]) for row in df.select("k", geometry.clip_convex(F.col("a"), F.col("b")).alias("c"), geometry.outside_share(F.col("a"), F.col("b")).alias("s")).collect()}
    sizes = set()
    for k, (a, b) in enumerate(pairs):
        want = clip(a, b)
        assert got[k][0] == [pytest.approx(p, abs=1e-12) for p in want]
        shoelace = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))) / 2
        assert got[k][1] == pytest.approx(max(0.0, 1 - shoelace(want) / shoelace(a)), abs=1e-9)
        sizes.add(len(want))
    assert 0 in sizes and len(sizes) > 5


def test_skips_are_recorded(tmp_path):
    """A pytest run writes its account: results, skips with their reasons, a sentinel at the end."""
    (tmp_path / "test_x.py").write_text("import pytest\ndef test_a(): assert 1\ndef test_b(): pytest.skip('no engine')\ndef test_c(): assert 0\n")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": here, "RUN_ACCOUNT_DIR": str(tmp_path / "out")}
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "catchment_engine.plans.pytest_account", "--rootdir", str(tmp_path), str(tmp_path / "test_x.py")], env=env, capture_output=True, timeout=120, cwd=tmp_path)
    account = json.loads((tmp_path / "out" / "account.json").read_text())
    assert [(r["test"].split("::")[-1], r["passed"], r["failed"], r["skipped"]) for r in account["results"]] == [("test_a", 1, 0, 0), ("test_b", 0, 0, 1), ("test_c", 0, 1, 0)]
    assert len(account["skips"]) == 1 and "no engine" in account["skips"][0]["reason"] and account["files_missing"] == []
    assert (tmp_path / "out" / "RUN_COMPLETED").exists()


def test_queries_read_whole_tables(spark):
    """Every line counts: the edges are those of all suppliers with lines."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert star_world.edges(spark, SF).select("provider_id").distinct().count() == lines
    assert queries.provider_isolation(spark, SF).count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
