"""DuckDB SQL for the queries, written from their formulas.

Queries without one: mc_weighted_ci (its draws are hashes that DuckDB hasn't) and
mutation_report (it runs the engine itself).
"""

from __future__ import annotations

import math

from . import bands as constants

_EDGES = """
edges AS (
  SELECT l_suppkey AS provider_id, o_custkey AS tract_id,
         CAST(min(abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) AS DOUBLE) AS minutes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_WORLD = f"""{_EDGES},
providers AS (SELECT s_suppkey AS provider_id, 1 + s_suppkey % 5 AS supply FROM supplier),
tracts AS (SELECT c_custkey AS tract_id, CAST(floor(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS BIGINT) AS population FROM customer),
bands AS (SELECT CAST(unnest([30, 60, 120, 180]) AS INTEGER) AS band)"""
_SCORES = f"""{_WORLD},
people AS (
  SELECT band, provider_id, CAST(sum(population) AS BIGINT) AS pop
  FROM edges JOIN bands ON minutes <= band JOIN tracts USING (tract_id) GROUP BY 1, 2),
ratios AS (
  SELECT b.band, p.provider_id, p.supply, pop, CASE WHEN pop <> 0 THEN CAST(supply AS DOUBLE) / pop END AS ratio
  FROM providers p CROSS JOIN bands b LEFT JOIN people USING (band, provider_id)),
scores AS (
  SELECT b.band, t.tract_id, t.population, coalesce(sum(r.ratio), 0) AS access
  FROM tracts t CROSS JOIN bands b
  LEFT JOIN edges e ON e.tract_id = t.tract_id AND e.minutes <= b.band
  LEFT JOIN ratios r ON r.band = b.band AND r.provider_id = e.provider_id
  GROUP BY 1, 2, 3),
nearest AS (SELECT tract_id, min(minutes) AS nearest FROM edges GROUP BY 1)"""
_NUMBERED = "numbered AS (SELECT c_custkey AS tract_id, row_number() OVER (ORDER BY c_custkey) AS idx, count(*) OVER () AS n FROM customer)"
_NATIONS = """
nations AS (
  SELECT n_nationkey, coalesce(sum(CAST(floor(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS BIGINT)), 0) AS people
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"""
_BY_NATION = f"""{_EDGES},
near AS (SELECT tract_id FROM edges GROUP BY 1 HAVING min(minutes) <= 60),
counts AS (
  SELECT c_nationkey, CAST(count(tract_id) AS BIGINT) AS x, count(*) AS n
  FROM customer LEFT JOIN near ON tract_id = c_custkey GROUP BY 1)"""
_Z = repr(constants.z_value(0.95))
_PAIRS = """
per AS (SELECT event_type, CAST(count(*) FILTER (WHERE value > 250) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
pairs AS (SELECT a.event_type AS type_1, b.event_type AS type_2, a.x AS x1, a.n AS n1, b.x AS x2, b.n AS n2 FROM per a JOIN per b ON a.event_type < b.event_type)"""
#: Two-sided normal tail of column z by Simpson's rule.
_TAIL = """
(SELECT 1 - 2 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(abs(z) * k / 2000.0) * (abs(z) * k / 2000.0) / 2)) * abs(z) / 2000.0 / 3 / sqrt(2 * pi())
 FROM range(0, 2001) t(k))"""
_REVENUE = "revenue AS (SELECT CAST(year(o_orderdate) AS DOUBLE) AS x, o_orderstatus, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1, 2)"
_LIFE = """
sizes AS (SELECT p_size AS age, count(*) AS n FROM part GROUP BY 1),
life AS (SELECT age, CAST(n AS DOUBLE) / sum(n) OVER (ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h FROM sizes),
curve AS (SELECT age, h, product(1 - h) OVER (ORDER BY age) AS s FROM life)"""


def _lon(k: str) -> str:
    return f"(-109e0 + 7e0 * (({k} * 7919) % 10007) / 10007e0)"


def _lat(k: str) -> str:
    return f"(37e0 + 4e0 * (({k} * 104729) % 10007) / 10007e0)"


_POINTS = f"points AS (SELECT c_custkey AS tract_id, {_lon('c_custkey')} AS lon, {_lat('c_custkey')} AS lat FROM customer)"
_STANDS = f"stands AS (SELECT s_suppkey AS provider_id, {_lon('(s_suppkey + 500000)')} AS lon, {_lat('(s_suppkey + 500000)')} AS lat FROM supplier)"


def _km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    hav = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * 6371.0088e0 * asin(least(1e0, sqrt({hav})))"


def _uniform(seed: int, *keys: str) -> str:
    m, state = 2147483647, str(seed % 2147483647 + 1)
    for k in keys:
        for _ in range(2):
            state = f"((({state}) + {k}) * 48271 + 11) % {m}"
    return f"((CAST(({state}) AS BIGINT) * 16807) % {m}) / {m}e0"


def _albers(lon: str, lat: str) -> tuple[str, str]:
    f = 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(sin: float) -> float:
        return (1 - e2) * (sin / (1 - e2 * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    def m(deg: float) -> float:
        return math.cos(math.radians(deg)) / math.sqrt(1 - e2 * math.sin(math.radians(deg)) ** 2)

    sines = [math.sin(math.radians(d)) for d in (29.5, 45.5, 23.0)]
    n = (m(29.5) ** 2 - m(45.5) ** 2) / (q(sines[1]) - q(sines[0]))
    c = m(29.5) ** 2 + n * q(sines[0])
    rho0 = 6378137 * math.sqrt(c - n * q(sines[2])) / n
    sin = f"sin(radians({lat}))"
    qs = f"({1 - e2!r} * ({sin} / (1 - {e2!r} * {sin} * {sin}) - ln((1 - {e!r} * {sin}) / (1 + {e!r} * {sin})) / {2 * e!r}))"
    rho = f"(6378137e0 * sqrt({c!r} - {n!r} * {qs}) / {n!r})"
    theta = f"({n!r} * radians({lon} + 96e0))"
    return f"({rho} * sin({theta}))", f"({rho0!r} - {rho} * cos({theta}))"


def _square_area() -> str:
    """Shoelace of the four projected corners, in square metres."""
    corners = [(f"(lon + {i * 0.08!r})", f"(lat + {j * 0.08!r})") for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    xy = [_albers(*c) for c in corners]
    terms = [f"({xy[k][0]} * {xy[(k + 1) % 4][1]} - {xy[(k + 1) % 4][0]} * {xy[k][1]})" for k in range(4)]
    return f"abs({' + '.join(terms)}) / 2"


_X, _Y = _albers("lon", "lat")

_TREND = f"""WITH {_REVENUE},
fit AS (
  SELECT o_orderstatus, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM revenue GROUP BY 1),
lines AS (SELECT *, sxy / sxx AS slope, sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) AS se, n - 2 AS df FROM fit),
dfs AS (SELECT DISTINCT CAST(df AS DOUBLE) AS df FROM lines),
cells AS (
  SELECT df, CAST(k AS DOUBLE) * 1e-4 AS a, CAST(k + 1 AS DOUBLE) * 1e-4 AS b,
    exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS f0
  FROM dfs, range(0, 400000) t(k)),
mass AS (
  SELECT df, a, b, f0 * 1e-4 / 6 * (power(1 + a * a / df, -(df + 1) / 2e0) + 4 * power(1 + (a + b) * (a + b) / 4 / df, -(df + 1) / 2) + power(1 + b * b / df, -(df + 1) / 2)) AS w FROM cells),
grid AS (SELECT df, a, b, w, sum(w) OVER (PARTITION BY df ORDER BY a) AS below FROM mass),
quantiles AS (SELECT df, arg_min(a + (b - a) * (0.475e0 - (below - w)) / w, a) AS t FROM grid WHERE below >= 0.475e0 GROUP BY df),
tails AS (
  SELECT l.o_orderstatus, 1 - 2 * max(g.below - g.w + g.w * (abs(l.slope / l.se) - g.a) / (g.b - g.a)) AS p
  FROM lines l JOIN grid g ON g.df = l.df AND abs(l.slope / l.se) >= g.a AND abs(l.slope / l.se) < g.b GROUP BY 1)
SELECT o_orderstatus, n, round(slope, 6) AS slope, round(slope - t * se, 6) AS lo, round(slope + t * se, 6) AS hi, round(p, 6) AS p
FROM lines JOIN quantiles USING (df) JOIN tails USING (o_orderstatus)"""

_CANON_RAW = """
raw AS (
  SELECT c_custkey, CASE c_custkey % 8
    WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '1') WHEN 1 THEN CAST(c_custkey AS VARCHAR)
    WHEN 2 THEN ' 12-34.' || c_custkey || ' ' WHEN 3 THEN 'abc' || c_custkey WHEN 4 THEN c_custkey || 'e9'
    WHEN 5 THEN '-' || c_custkey WHEN 6 THEN '1234567890' || c_custkey
    ELSE CASE WHEN c_custkey % 16 = 7 THEN '' ELSE '(' || c_custkey || ')' END END AS x FROM customer),
digits AS (SELECT c_custkey, x, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM raw)"""

_DRIFT = """
WITH o AS (
  SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 20 = 0 THEN s_acctbal + 0.5 ELSE s_acctbal END AS s_acctbal,
         CASE WHEN s_suppkey % 25 = 0 THEN 'changed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 50 <> 0),
j AS (
  SELECT e.s_suppkey AS k, o.s_suppkey IS NULL AS gone, o.s_name AS o_name, e.s_name AS e_name,
         o.s_nationkey AS o_nat, e.s_nationkey AS e_nat, o.s_acctbal AS o_bal, e.s_acctbal AS e_bal
  FROM supplier e LEFT JOIN o USING (s_suppkey)),
a AS (
  SELECT CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_rows,
         CAST(sum(CAST(o_name IS DISTINCT FROM e_name AS INT)) AS BIGINT) AS n_name,
         CAST(sum(CAST(o_nat IS DISTINCT FROM e_nat AS INT)) AS BIGINT) AS n_nat, CAST(max(abs(o_nat - e_nat)) AS DOUBLE) AS d_nat,
         CAST(sum(CAST(o_bal IS DISTINCT FROM e_bal AS INT)) AS BIGINT) AS n_bal, max(abs(o_bal - e_bal)) AS d_bal FROM j)
SELECT '(rows)' AS "column", 'rows' AS kind, n_rows AS n_changed, CAST(NULL AS DOUBLE) AS max_abs_diff, n_rows > 0 AS drifted FROM a
UNION ALL SELECT 's_name', 'text', n_name, NULL, n_name > 0 FROM a
UNION ALL SELECT 's_nationkey', 'number', n_nat, round(d_nat, 9), d_nat > 1e-9 FROM a
UNION ALL SELECT 's_acctbal', 'number', n_bal, round(d_bal, 9), d_bal > 1e-9 FROM a
UNION ALL SELECT 'extra', 'column', NULL, NULL, TRUE"""

_VIOLATIONS = f"""WITH {_WORLD},
p AS (SELECT * FROM providers UNION ALL SELECT * FROM providers WHERE provider_id % 40 = 1),
t AS (SELECT * FROM tracts WHERE tract_id % 100 <> 3),
e AS (SELECT provider_id, tract_id, CASE WHEN tract_id % 500 = 5 THEN NULL ELSE minutes END AS minutes FROM edges)
SELECT 'duplicate_provider' AS rule, CAST(provider_id AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail FROM p GROUP BY provider_id HAVING count(*) > 1
UNION ALL SELECT 'bad_minutes', provider_id || '|' || tract_id, NULL FROM e WHERE minutes IS NULL
UNION ALL SELECT 'unknown_tract', provider_id || '|' || tract_id, NULL FROM e WHERE tract_id NOT IN (SELECT tract_id FROM t)"""


def oracle_sql() -> dict[str, str]:
    chunked = lambda expression: f"WITH {_NUMBERED} SELECT tract_id, idx, CAST({expression} AS INTEGER) AS chunk FROM numbered"
    uneven = "CASE WHEN idx = 1 THEN 2 ELSE least(ceil((idx - 1) / ((n - 1) / 5.0)), 5) + 2 END"
    return {
        "band_summary": f"""WITH {_SCORES}
            SELECT s.band AS band_min, count(*) FILTER (WHERE nearest <= s.band) AS n_tracts_reached,
              round(CAST(coalesce(sum(population) FILTER (WHERE nearest <= s.band), 0) AS DOUBLE) / CAST(sum(population) AS DOUBLE), 9) AS pop_share_within,
              CAST(sum(population) AS BIGINT) AS total_population,
              (SELECT count(ratio) FROM ratios r WHERE r.band = s.band) AS n_providers_used,
              round(sum(access), 9) AS access_sum, round(avg(access), 9) AS access_mean, round(max(access), 9) AS access_max,
              count(*) FILTER (WHERE access = 0) AS n_zero_access
            FROM scores s LEFT JOIN nearest USING (tract_id) GROUP BY s.band""",
        "reached_by_band": f"WITH {_WORLD} SELECT band, tract_id, min(minutes) <= band AS reached FROM edges CROSS JOIN bands GROUP BY band, tract_id",
        "pop_share_by_band": f"""WITH {_SCORES}
            SELECT band, CAST(sum(CASE WHEN nearest <= band THEN population ELSE 0 END) AS BIGINT) AS reached_population,
              CAST(sum(population) AS BIGINT) AS total_population,
              round(CAST(sum(CASE WHEN nearest <= band THEN population ELSE 0 END) AS DOUBLE) / CAST(sum(population) AS DOUBLE), 9) AS pop_share
            FROM tracts LEFT JOIN nearest USING (tract_id) CROSS JOIN bands GROUP BY band""",
        "provider_ratio": f"WITH {_SCORES} SELECT band, provider_id, pop AS catchment_population, round(ratio, 9) AS ratio FROM ratios",
        "tract_access": f"WITH {_SCORES} SELECT band, tract_id, round(access, 9) AS access FROM scores",
        "tract_access_60": f"WITH {_SCORES} SELECT tract_id, round(access, 9) AS access_60, population FROM scores WHERE band = 60",
        "leave_one_out_coverage": f"""WITH {_WORLD},
            near AS (SELECT * FROM edges WHERE minutes <= 60),
            lost AS (SELECT e.provider_id, e.tract_id FROM near e WHERE NOT EXISTS (SELECT 1 FROM near o WHERE o.tract_id = e.tract_id AND o.provider_id <> e.provider_id))
            SELECT p.provider_id, count(l.tract_id) AS tracts_lost, CAST(coalesce(sum(population), 0) AS BIGINT) AS population_lost
            FROM (SELECT DISTINCT provider_id FROM edges) p LEFT JOIN lost l USING (provider_id) LEFT JOIN tracts t ON t.tract_id = l.tract_id GROUP BY 1""",
        "supply_conservation": f"""WITH {_SCORES}
            SELECT band, (SELECT CAST(sum(supply) AS BIGINT) FROM ratios r WHERE r.band = s.band AND ratio IS NOT NULL) AS used_supply,
              round(sum(access * population), 6) AS weighted_access FROM scores s GROUP BY band""",
        "provider_isolation": f"""WITH {_WORLD} SELECT p.provider_id, min(minutes) AS nearest, coalesce(min(minutes) > 180, TRUE) AS isolated
            FROM providers p LEFT JOIN edges USING (provider_id) GROUP BY 1""",
        "zero_access_share": f"""WITH {_SCORES} SELECT band, round(100e0 * CAST(sum(CASE WHEN access = 0 THEN population ELSE 0 END) AS DOUBLE) / CAST(sum(population) AS DOUBLE), 9) AS zero_share_pct
            FROM scores GROUP BY band""",
        "nearest_provider_ranks": f"""WITH {_EDGES} SELECT tract_id, provider_id, minutes, CAST(r AS INTEGER) AS rank FROM
            (SELECT *, row_number() OVER (PARTITION BY tract_id ORDER BY minutes, provider_id) AS r FROM edges) WHERE r <= 3""",
        "chunks_even": chunked("least(ceil(idx / (n / 7.0)), 7)"),
        "chunks_interleaved": chunked("(idx - 1) % 7 + 1"),
        "chunks_uneven": chunked(uneven),
        "chunks_by_size": f"WITH {_NUMBERED} SELECT tract_id, CAST(ceil(idx / 10.0) AS INTEGER) AS chunk FROM numbered",
        "chunked_access": f"""WITH {_SCORES}, {_NUMBERED}
            SELECT tract_id, CAST((idx - 1) % 7 + 1 AS INTEGER) AS chunk, round(access, 9) AS access FROM numbered JOIN scores USING (tract_id) WHERE band = 60""",
        "chunk_accounting": f"""WITH {_NUMBERED}, dealt AS (SELECT CAST({uneven} AS INTEGER) AS chunk FROM numbered)
            SELECT CAST(k AS INTEGER) AS chunk, count(dealt.chunk) AS n_items, CAST((k - 1) % 3 + 1 AS INTEGER) AS worker
            FROM range(1, 8) t(k) LEFT JOIN dealt ON dealt.chunk = k GROUP BY k""",
        "worker_plan": f"""WITH {_NUMBERED}, dealt AS (SELECT tract_id, (idx - 1) % 7 + 1 AS c FROM numbered)
            SELECT tract_id, CAST(c AS INTEGER) AS chunk, CAST((c - 1) % 3 + 1 AS INTEGER) AS worker, CAST((7 - c) // 3 + 1 AS INTEGER) AS turn FROM dealt""",
        "chunk_invariance": f"""WITH {_SCORES} SELECT scheme, k AS n_chunks, count(*) AS n_tracts, round(sum(access), 9) AS access_sum, CAST(0 AS BIGINT) AS n_differ
            FROM scores CROSS JOIN (VALUES ('even', 1), ('uneven', 2), ('interleaved', 7), ('even', 60)) v(scheme, k) WHERE band = 60 GROUP BY 1, 2""",
        "allocation_weights": f"""WITH {_NATIONS}, s AS (SELECT n_nationkey, CAST(people AS DOUBLE) / sum(people) OVER () AS w FROM nations)
            SELECT count(*) AS n_units, count(DISTINCT n_nationkey) AS n_keys, round(sum(w), 9) AS total, count(*) = 25 AND min(w) >= 0 AS complete, abs(sum(w) - 1) <= 1e-12 AS normalised FROM s""",
        "allocate_proportional": f"WITH {_NATIONS} SELECT n_nationkey, round(1306e0 * people / sum(people) OVER (), 9) AS allocated FROM nations",
        "allocate_largest_remainder": f"""WITH {_NATIONS},
            exact AS (SELECT n_nationkey, 1306e0 * CAST(people AS DOUBLE) / CAST(sum(people) OVER () AS DOUBLE) AS x FROM nations),
            ranked AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, n_nationkey) AS r, 1306 - sum(floor(x)) OVER () AS rest FROM exact)
            SELECT n_nationkey, CAST(floor(x) + CASE WHEN r <= round(rest) THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM ranked""",
        "allocation_deviation": f"""WITH {_NATIONS}, totals AS (SELECT CAST(unnest([1, 7, 49, 1000, 1306, 100000]) AS INTEGER) AS total),
            exact AS (SELECT total, n_nationkey, CAST(total AS DOUBLE) * CAST(people AS DOUBLE) / CAST(sum(people) OVER (PARTITION BY total) AS DOUBLE) AS x FROM nations CROSS JOIN totals),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY x - floor(x) DESC, n_nationkey) AS r, total - sum(floor(x)) OVER (PARTITION BY total) AS rest FROM exact),
            whole AS (SELECT total, x, floor(x) + CASE WHEN r <= round(rest) THEN 1 ELSE 0 END AS o FROM ranked)
            SELECT total, round(max(abs(o - x)), 9) AS max_abs_deviation, count(*) FILTER (WHERE o <> 0) AS n_nonzero, sum(o) = total AS conserved FROM whole GROUP BY total""",
        "wald_ci": f"""WITH {_BY_NATION}, p AS (SELECT *, CAST(x AS DOUBLE) / n AS p FROM counts)
            SELECT c_nationkey, x, n, round(p, 9) AS estimate, round(greatest(0e0, p - {_Z} * sqrt(p * (1 - p) / n)), 9) AS lower,
              round(least(1e0, p + {_Z} * sqrt(p * (1 - p) / n)), 9) AS upper FROM p""",
        "wilson_ci": f"""WITH {_BY_NATION}, p AS (SELECT *, CAST(x AS DOUBLE) / n AS p, {_Z} AS z FROM counts)
            SELECT c_nationkey, x, n, round(p, 9) AS estimate,
              round(greatest(0e0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS lower,
              round(least(1e0, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS upper FROM p""",
        "moe_to_ci95": f"WITH {_BY_NATION} SELECT c_nationkey, round(n * {constants.MOE90_TO_CI95_FACTOR!r}::DOUBLE, 9) AS half_width FROM counts",
        "two_prop_z": f"""WITH {_PAIRS},
            t AS (SELECT *, (x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM pairs)
            SELECT type_1, type_2, round(z, 9) AS z, round({_TAIL}, 9) AS p FROM t""",
        "two_prop_yates": f"""WITH {_PAIRS}, d AS (SELECT *, abs(x1 * (n2 - x2) - (n1 - x1) * x2) AS dev, n1 + n2 AS n FROM pairs),
            c AS (SELECT *, CASE WHEN dev < n / 2 THEN 0e0 ELSE n * power(dev - n / 2, 2) / (n1 * n2 * (x1 + x2) * (n - x1 - x2)) END AS chisq FROM d),
            t AS (SELECT *, sqrt(chisq) AS z FROM c)
            SELECT type_1, type_2, round(chisq, 9) AS chisq, round({_TAIL}, 9) AS p FROM t""",
        "ols_slope": f"WITH {_REVENUE} SELECT o_orderstatus, round(covar_pop(y, x) / var_pop(x), 6) AS slope FROM revenue GROUP BY 1",
        "annual_trend": _TREND,
        "column_aggregates": "SELECT event_type, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, round(sum(value), 4) AS sum_value, count(value) AS n FROM events GROUP BY 1",
        "survival_curve": f"WITH {_LIFE} SELECT age, round(h, 9) AS annual_hazard, round(s, 9) AS survival FROM curve",
        "hazard_from_survival": f"""WITH {_LIFE}, l AS (SELECT age, s, lag(s, 1, 1e0) OVER (ORDER BY age) AS b FROM curve)
            SELECT age, round(CASE WHEN b <> 0 THEN 1 - s / b END, 9) AS hazard FROM l""",
        "survival_at_age": f"WITH {_LIFE} SELECT CAST(k AS INTEGER) AS age, round(s, 9) AS survival FROM range(0, 80, 10) t(k) LEFT JOIN curve ON age = k",
        "career_violations": """WITH c AS (SELECT p_brand, p_size AS age, count(*) AS n FROM part GROUP BY 1, 2),
            w AS (SELECT p_brand, age, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY p_brand) * CASE WHEN p_brand LIKE '%5' THEN 1.5e0 ELSE 1e0 END AS w,
              row_number() OVER (PARTITION BY p_brand ORDER BY age DESC) AS back, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, age) AS best FROM c),
            a AS (SELECT p_brand, count(*) FILTER (WHERE NOT (w > 0 AND w <= 1)) AS bad, min(age) AS a, max(age) AS z, max(age) FILTER (WHERE best = 1) AS peak,
              max(w) AS top, arg_min(w, age) AS f, avg(w) FILTER (WHERE back <= 5) AS tail FROM w GROUP BY 1)
            SELECT p_brand, 'not_a_share' AS rule, CAST(bad AS DOUBLE) AS detail FROM a WHERE bad > 0
            UNION ALL SELECT p_brand, 'peak_at_end', peak FROM a WHERE peak IN (a.a, z) UNION ALL SELECT p_brand, 'peak_age', peak FROM a WHERE peak < 40 OR peak > 60
            UNION ALL SELECT p_brand, 'no_ramp', round(f, 9) FROM a WHERE f >= top UNION ALL SELECT p_brand, 'no_taper', round(tail, 9) FROM a WHERE tail >= 0.6e0 * top""",
        "survival_anchor_spread": f"""WITH {_LIFE}, r AS (SELECT 0.9e0 * s / s AS a FROM curve WHERE s <> 0)
            SELECT round(min(a), 9) AS anchor_min, round(max(a), 9) AS anchor_max, max(a) - min(a) < 1e-12 AS "constant" FROM r""",
        "survival_violations": f"""WITH {_LIFE}, b AS (SELECT age, CASE WHEN age % 5 = 0 THEN s + 1 ELSE s END AS s FROM curve WHERE age % 7 <> 0),
            l AS (SELECT age, s, lag(s) OVER (ORDER BY age) AS s0, lag(age) OVER (ORDER BY age) AS a0 FROM b)
            SELECT age, 'increasing' AS rule FROM l WHERE s > s0 UNION ALL SELECT age, 'out_of_range' FROM l WHERE s < 0 OR s > 1
            UNION ALL SELECT age, 'age_gap' FROM l WHERE age <> a0 + 1""",
        "hazard_direction": f"""WITH {_LIFE}, k AS (SELECT h, row_number() OVER (ORDER BY age) AS a, row_number() OVER (ORDER BY age DESC) AS d FROM life)
            SELECT round(avg(h) FILTER (WHERE a <= 5), 9) AS head_mean, round(avg(h) FILTER (WHERE d <= 5), 9) AS tail_mean,
              avg(h) FILTER (WHERE d <= 5) > avg(h) FILTER (WHERE a <= 5) AS rises FROM k""",
        "hazard_peak": """WITH c AS (SELECT p_brand, p_size AS age, count(*) AS n FROM part GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, age) AS r FROM c)
            SELECT p_brand, age AS peak_age, n AS peak_value FROM r WHERE r = 1""",
        "aligned_curves": f"""WITH {_LIFE} SELECT b.age, round(b.s, 9) AS base, round(l.s, 9) AS later, round(e.s, 9) AS earlier
            FROM curve b JOIN curve l ON l.age + 2 = b.age JOIN curve e ON e.age - 2 = b.age""",
        "canon_id": f"""WITH {_CANON_RAW}
            SELECT c_custkey, CASE WHEN x = '' OR regexp_matches(x, '[eE][+-]?[0-9]+') OR regexp_matches(x, '^\\s*[-+]')
              OR regexp_matches(regexp_replace(x, '[\\s.-]', '', 'g'), '[A-Za-z]') OR length(d) = 0 OR length(d) > 10 THEN NULL
              ELSE repeat('0', 10 - length(d)) || d END AS canon FROM digits""",
        "rurality": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 3.5 ELSE 1 + c_custkey % 10 END AS r FROM customer)
            SELECT c_custkey, CASE WHEN r <= 3 THEN 'metro' WHEN r >= 4 THEN 'nonmetro' END AS rurality,
              CASE WHEN r <= 3 THEN 'Metropolitan' WHEN r >= 4 THEN 'Rural' END AS label FROM c""",
        "safe_divide": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN NULL
            ELSE round(c_acctbal / (c_custkey % 5), 9) END AS quotient FROM customer""",
        "haversine": f"""WITH {_EDGES}, {_POINTS}, {_STANDS}
            SELECT provider_id, tract_id, round({_km('s.lon', 's.lat', 'p.lon', 'p.lat')}, 6) AS km
            FROM edges JOIN stands s USING (provider_id) JOIN points p USING (tract_id)""",
        "tract_squares": f"""WITH {_POINTS}, corners(pos, i, j) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1))
            SELECT tract_id, pos, round(lon + 0.08e0 * i, 9) AS x, round(lat + 0.08e0 * j, 9) AS y, 4326 AS srid FROM points CROSS JOIN corners""",
        "albers_xy": f"WITH {_POINTS} SELECT tract_id, round({_X}, 4) AS x, round({_Y}, 4) AS y FROM points",
        "tract_area": f"""WITH {_POINTS}, a AS (SELECT tract_id, {_square_area()} AS area FROM points)
            SELECT tract_id, round(area / 1e6, 6) AS km2, area BETWEEN 1e7 AND 1e9 AS plausible FROM a""",
        "band_discs": f"""SELECT s_suppkey AS provider_id, CAST(band AS INTEGER) AS band, 120 AS n_points,
            round(60 * power(band / 60.0 * 70e0 * 1000, 2) * sin({2 * math.pi / 120!r}) / 1e6, 4) AS km2
            FROM supplier CROSS JOIN (SELECT unnest([30, 60, 120, 180]) AS band)""",
        "band_containment": """SELECT s_suppkey AS provider_id, CAST(a AS INTEGER) AS band, CAST(b AS INTEGER) AS outer_band, a <= b AS inside, 1 - power(a * 1e0 / b, 2) <= 1e-6 AS "reversed",
              round(1 - power(a * 1e0 / b, 2), 9) AS outside FROM supplier CROSS JOIN (VALUES (30, 60), (60, 120), (120, 180)) v(a, b)""",
        "bbox": f"""WITH {_POINTS} SELECT round(min(lon) - 0.08e0, 9) AS xmin, round(min(lat) - 0.08e0, 9) AS ymin, round(max(lon) + 0.08e0, 9) AS xmax,
            round(max(lat) + 0.08e0, 9) AS ymax, NOT (max(lon) + 0.08e0 < 0 AND min(lat) - 0.08e0 > 0) AS swapped FROM points""",
        "point_in_polygon": "SELECT c_custkey AS tract_id, TRUE AS own, FALSE AS beside FROM customer",
        "shape_validity": """SELECT c_custkey AS tract_id, c_custkey % 4 = 2 AS "empty", c_custkey % 4 <> 1 AS "valid", c_custkey % 4 <> 3 AS known_srid FROM customer""",
        "repaired_parts": """SELECT c_custkey AS tract_id, CAST(k AS INTEGER) AS part, TRUE AS "valid", round(CASE c_custkey % 4 WHEN 0 THEN 0.16e0 * 0.16e0 WHEN 1 THEN 0.25e0 ELSE 4e-18 END, 9) AS area
            FROM customer CROSS JOIN range(0, 2) t(k) WHERE c_custkey % 4 <> 2 AND (k = 0 OR c_custkey % 4 = 1)""",
        "square_overlap": "SELECT c_custkey AS tract_id, round(1.5e0 * 0.16e0 * 0.16e0, 9) AS union_area, round(0.5e0 * 0.16e0 * 0.16e0, 9) AS difference_area FROM customer",
        "duplicate_keys": "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "set_algebra": """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders),
            c AS (SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_only_a,
                         (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_only_b)
            SELECT *, n_only_a = 0 AND n_only_b = 0 AS equal FROM c""",
        "semi_anti": "SELECT c_custkey, c_nationkey, c_custkey IN (SELECT o_custkey FROM orders) AS buys FROM customer",
        "relabelled_access": f"WITH {_SCORES} SELECT tract_id, round(access, 9) AS access FROM scores WHERE band = 60",
        "scaled_access": f"WITH {_SCORES} SELECT tract_id, round(access, 9) AS access_times_10 FROM scores WHERE band = 60",
        "numeric_diff": f"""WITH {_SCORES}
            SELECT o.tract_id, round(o.access, 9) AS observed, round(e.access, 9) AS expected, round(abs(o.access - e.access) / greatest(abs(e.access), 1e0), 9) AS rel_diff, '60 against 120' AS label
            FROM scores o JOIN scores e USING (tract_id) WHERE o.band = 60 AND e.band = 120 AND abs(o.access - e.access) / greatest(abs(e.access), 1e0) > 1e-9""",
        "drift_report": _DRIFT,
        "run_verdicts": """SELECT o_orderpriority AS file, CAST(sum(CAST(o_orderstatus = 'O' AS INT)) AS BIGINT) AS passed,
              CAST(sum(CAST(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS INT)) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS error,
              CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS skipped,
              CASE WHEN sum(CAST(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS INT)) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
            FROM orders GROUP BY 1 UNION ALL SELECT 'never', NULL, NULL, NULL, NULL, 'NOT RUN'""",
        "world_contract_violations": _VIOLATIONS,
        "travel_matrix": f"""WITH {_STANDS}, grounds AS (SELECT n_nationkey AS tract_id, {_lon('n_nationkey')} AS lon, {_lat('n_nationkey')} AS lat FROM nation),
            d AS (SELECT provider_id, tract_id, {_km('s.lon', 's.lat', 'g.lon', 'g.lat')} AS km FROM stands s CROSS JOIN grounds g)
            SELECT provider_id, tract_id, round(km * (1e0 + (1.6e0 - 1e0) * ({_uniform(99, '(provider_id % 1000003)', '(tract_id % 1000003)')})) / 70e0 * 60, 6) AS minutes, round(km, 6) AS km FROM d""",
        "vocabulary_violations": """WITH w AS (SELECT r_name AS w FROM region UNION ALL SELECT r_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_regionkey > 2 UNION ALL SELECT ' ' UNION ALL SELECT NULL),
            c AS (SELECT w, count(*) AS n FROM w GROUP BY 1)
            SELECT 'blank' AS rule, w AS value, n FROM c WHERE w IS NULL OR trim(w) = '' UNION ALL SELECT 'repeated', w, n FROM c WHERE n > 1""",
        "prevalence_contract": """WITH v(condition, a, b) AS (VALUES ('any_PFD', 0.368e0, 0.497e0), ('UI', 0.272e0, 0.382e0), ('FI', 0.154e0, 0.210e0), ('POP', 0.047e0, 0.040e0)),
            r AS (SELECT * FROM v UNION ALL SELECT condition || ' x 3', 3 * a, 3 * b FROM v)
            SELECT condition, round(a, 9) AS p_65_79, round(b, 9) AS p_80plus, a BETWEEN 0 AND (SELECT a FROM v WHERE condition = 'any_PFD') AND b BETWEEN 0 AND (SELECT b FROM v WHERE condition = 'any_PFD') AS holds FROM r""",
        "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
        "shuffled_order": f"SELECT c_custkey, row_number() OVER (ORDER BY {_uniform(11, 'c_custkey')}, c_custkey) AS place FROM customer",
        "shuffled_rank": f"SELECT s_suppkey, round({_uniform(7, 's_suppkey')}, 9) AS u FROM supplier",
    }
