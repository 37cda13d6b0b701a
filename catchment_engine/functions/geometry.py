"""Planar geometry on arrays of points: rings are array<struct<x:double,y:double>>, closed.

General overlays of polygons aren't built in; containment and intersection areas take
convex clips, which squares, discs and their like need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in km.
EARTH_KM = 6371.0088
GEOGRAPHIC_SRID, PROJECTED_SRID = 4326, 5070
#: GRS80 ellipsoid, and the parallels and origin of the equal-area projection.
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257222101
_PHI1, _PHI2, _PHI0, _LON0 = (math.radians(v) for v in (29.5, 45.5, 23.0, -96.0))
#: Points on a disc's ring, the last equal to the first left out.
DISC_POINTS = 120


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def square(lon: Column, lat: Column, half_side: float) -> Column:
    """A closed ring of five points around a centre."""
    h = F.lit(half_side)
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(*[point(lon + h * i, lat + h * j) for i, j in corners])


def _authalic(sin_phi):
    """Snyder's q, for floats and Columns alike."""
    e2 = _FLATTENING * (2 - _FLATTENING)
    e = math.sqrt(e2)
    log = math.log if isinstance(sin_phi, float) else F.log
    return (1 - e2) * (sin_phi / (1 - e2 * sin_phi * sin_phi) - log((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e))


def _cone() -> tuple[float, float, float]:
    e2 = _FLATTENING * (2 - _FLATTENING)
    m1, m2 = (math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2) for p in (_PHI1, _PHI2))
    q0, q1, q2 = (_authalic(math.sin(p)) for p in (_PHI0, _PHI1, _PHI2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    return n, c, _AXIS * math.sqrt(c - n * q0) / n


def albers(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres: the conic equal-area projection of the contiguous states."""
    n, c, rho0 = _cone()
    rho = F.lit(_AXIS / n) * F.sqrt(F.lit(c) - F.lit(n) * _authalic(F.sin(F.radians(lat))))
    theta = F.lit(n) * (F.radians(lon) - F.lit(_LON0))
    return point(rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta))


def project(ring: Column) -> Column:
    return F.transform(ring, lambda p: albers(p["x"], p["y"]))


def disc(x: Column, y: Column, radius: Column, points: int = DISC_POINTS) -> Column:
    """A regular closed ring on a circle."""
    at = lambda k: k * F.lit(2 * math.pi / points)
    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: point(x + radius * F.cos(at(k)), y + radius * F.sin(at(k))))
    return F.concat(ring, F.slice(ring, 1, 1))


def band_radius(band: Column, kph: float = 70.0) -> Column:
    """Metres that a speed covers in a band's minutes."""
    return band / 60 * F.lit(kph) * 1000


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body and its lambdas name it: an
    expression named twice is computed twice, and one named in a lambda once an element."""
    return F.get(F.transform(F.array(value), body), 0)


def signed_area(ring: Column) -> Column:
    """Shoelace sum from the first point, positive for a counter-clockwise ring; 0 if empty."""

    def whole(ring: Column) -> Column:
        first = F.get(ring, 0)

        def step(acc: Column, p: Column) -> Column:
            x, y = p["x"] - first["x"], p["y"] - first["y"]
            return F.struct(x.alias("x"), y.alias("y"), (acc["sum"] + acc["x"] * y - x * acc["y"]).alias("sum"))

        start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sum"))
        return F.aggregate(ring, start, step, lambda acc: acc["sum"] / 2)

    return _bound(ring, whole)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def is_empty(ring: Column) -> Column:
    return F.coalesce(F.size(ring) == 0, F.lit(True))


def bbox(ring: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); null fields if empty."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting over a ring's edges; false for an empty ring."""
    edges = F.slice(F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, F.greatest(F.size(ring) - 1, F.lit(0)))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def is_valid(ring: Column) -> Column:
    """Closed, of four points at least, not flat, and no two edges that aren't neighbours
    cross (each pair of edges once). An empty ring is valid."""
    n = F.size(ring) - 1
    at = lambda i: F.get(ring, i)

    def crossing(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        return (_cross(a, b, c) * _cross(a, b, d) < 0) & (_cross(c, d, a) * _cross(c, d, b) < 0)

    pairs = F.exists(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.exists(F.when(i + 2 <= n - 1, F.sequence(i + 2, n - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.coalesce(crossing(i, j), F.lit(False))),
    )
    closed = (F.get(ring, 0)["x"] == F.get(ring, n)["x"]) & (F.get(ring, 0)["y"] == F.get(ring, n)["y"])
    return F.when(F.size(ring) == 0, True).otherwise(F.coalesce((n >= 3) & closed & ~pairs & (F.size(F.array_distinct(ring)) >= 3), F.lit(False)))


def make_valid_bowtie(ring: Column) -> Column:
    """Rings of a four-cornered ring whose sides cross once, split at the crossing; others as
    they are. Repair of general rings isn't offered."""
    a, b, c, d = (F.get(ring, i) for i in range(4))

    def meet(p: Column, q: Column, r: Column, s: Column) -> Column:
        t = F.try_divide(_cross(r, s, p), _cross(r, s, p) - _cross(r, s, q))
        return point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))

    def cut(p: Column, q: Column, r: Column, s: Column) -> Column:
        return (_cross(p, q, r) * _cross(p, q, s) < 0) & (_cross(r, s, p) * _cross(r, s, q) < 0)

    x, y = meet(a, b, c, d), meet(b, c, d, a)
    one = F.array(F.array(x, b, c, x), F.array(a, x, d, a))
    two = F.array(F.array(y, c, d, y), F.array(b, y, a, b))
    four = F.size(ring) == 5
    return F.when(four & cut(a, b, c, d), one).when(four & cut(b, c, d, a), two).otherwise(F.array(ring))


def clip_convex(subject: Column, window: Column) -> Column:
    """Part of a ring inside a convex counter-clockwise ring (Sutherland and Hodgman), as a
    closed ring, empty if nothing is left. Each ring is computed once, each point's side of an
    edge too, and a ring wholly on an edge's inner side stays as it is."""
    pair = F.struct(subject.alias("subject"), window.alias("window"))
    return _bound(_bound(pair, lambda v: _clip(v["subject"], v["window"])), lambda out: F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out))


def _clip(subject: Column, window: Column) -> Column:
    """The open ring that clip_convex closes."""

    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def by_edge(ring: Column, e: Column) -> Column:
        def side(p: Column) -> Column:
            return e["dx"] * (p["y"] - e["y"]) - e["dy"] * (p["x"] - e["x"])

        def part(p: Column, q: Column) -> Column:
            t = F.try_divide(p["side"], p["side"] - q["side"])
            hit = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            return F.array(F.when(p["side"] >= 0, point(p["x"], p["y"])), F.when((p["side"] >= 0) != (q["side"] >= 0), hit))

        def cut(points: Column) -> Column:
            after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
            return F.filter(F.flatten(F.zip_with(points, after, part)), lambda p: p.isNotNull())

        def left(sides: Column) -> Column:
            points = F.zip_with(ring, sides, lambda p, s: F.struct(p["x"].alias("x"), p["y"].alias("y"), s.alias("side")))
            return F.when(F.forall(sides, lambda s: s >= 0), ring).otherwise(_bound(points, cut))

        return _bound(F.transform(ring, side), left)

    open_ring = F.slice(subject, 1, F.greatest(F.size(subject) - 1, F.lit(0)))
    edges = F.slice(F.zip_with(window, F.slice(window, 2, F.size(window)), edge), 1, F.greatest(F.size(window) - 1, F.lit(0)))
    return F.aggregate(edges, open_ring, by_edge)


def outside_share(inner: Column, outer: Column) -> Column:
    """Share of a ring's area in its difference with a convex counter-clockwise ring; 0 for
    an empty ring or one without area, 1 if the other is empty."""

    def share(v: Column) -> Column:
        common = F.when(is_empty(v["outer"]), 0.0).otherwise(area(clip_convex(v["inner"], v["outer"])))
        return F.when(is_empty(v["inner"]) | (v["whole"] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - common / v["whole"]))

    return _bound(F.struct(inner.alias("inner"), outer.alias("outer"), area(inner).alias("whole")), share)


def ring_contained(inner: Column, outer: Column, tolerance: float) -> Column:
    """Whether the part of a ring outside a convex one is at most a share of its own area."""
    return outside_share(inner, outer) <= tolerance


def disc_contained(inner_radius: Column, outer_radius: Column, distance: Column, tolerance: float) -> Column:
    """Whether a disc's area outside another is at most a share of its own; an empty one is inside."""
    r, big, d = inner_radius, outer_radius, distance
    angle = lambda u, v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(d * d + u * u - v * v, 2 * d * u))))
    lens = r * r * angle(r, big) + big * big * angle(big, r) - F.sqrt(F.greatest(F.lit(0.0), (-d + r + big) * (d + r - big) * (d - r + big) * (d + r + big))) / 2
    common = F.when(d + r <= big, math.pi * r * r).when(d + big <= r, math.pi * big * big).when(d >= r + big, 0.0).otherwise(lens)
    return F.when(r <= 0, True).otherwise(1 - common / (math.pi * r * r) <= tolerance)
