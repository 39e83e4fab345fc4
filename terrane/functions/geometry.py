"""Geometry as Column expressions. A point is struct<x,y>, a line or ring an array of points (rings aren't closed), in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.lit(0.0)


def point(x: Column | str, y: Column | str) -> Column:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a counter-clockwise ring."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def parse_points(text: Column, scale: float = 1.0) -> Column:
    """``"x,y;x,y"`` to an array of points."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: point(F.split(p, ",")[0].cast("double") * scale, F.split(p, ",")[1].cast("double") * scale))


def _next(p: Column) -> Column:
    return F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))


def _around(p: Column) -> Column:
    return F.concat(_next(p), F.slice(p, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda a, v: a + v)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(p: Column) -> Column:
    """Length of a polyline."""
    return _sum(F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), _next(p), hypot))


def _cross(p: Column) -> Column:
    """Shoelace terms about the first vertex, which keeps their precision far from the origin."""
    o = p[0]
    return F.zip_with(p, _around(p), lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))


def signed_area(p: Column) -> Column:
    return _sum(_cross(p)) / 2


def area(p: Column, holes: Column | None = None) -> Column:
    """Area of a ring, without its holes (an array of rings)."""
    whole = F.abs(signed_area(p))
    return whole if holes is None else whole - _sum(F.transform(holes, lambda h: F.abs(signed_area(h))))


def centroid(p: Column) -> Column:
    """Of a ring; the mean of its vertices if it has no area."""
    o, a = p[0], signed_area(p)
    term = lambda k: _sum(F.zip_with(p, _around(p), lambda u, v: (u[k] - o[k] + v[k] - o[k]) * ((u["x"] - o["x"]) * (v["y"] - o["y"]) - (v["x"] - o["x"]) * (u["y"] - o["y"]))))
    mean = lambda k: _sum(F.transform(p, lambda u: u[k])) / F.size(p)
    return F.when(a == 0, point(mean("x"), mean("y"))).otherwise(point(o["x"] + term("x") / (6 * a), o["y"] + term("y") / (6 * a)))


def bounds(p: Column) -> Column:
    xs, ys = F.transform(p, lambda u: u["x"]), F.transform(p, lambda u: u["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def along(q: Column, a: Column, b: Column) -> Column:
    """Where the foot of q lies on the segment a to b, from 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    return F.when(n == 0, _zero()).otherwise(F.least(F.greatest(((q["x"] - a["x"]) * dx + (q["y"] - a["y"]) * dy) / n, _zero()), F.lit(1.0)))


def segment_distance(q: Column, a: Column, b: Column) -> Column:
    t = along(q, a, b)
    dx, dy = q["x"] - a["x"] - t * (b["x"] - a["x"]), q["y"] - a["y"] - t * (b["y"] - a["y"])
    return F.sqrt(dx * dx + dy * dy)


def line_distance(q: Column, p: Column) -> Column:
    return F.array_min(F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), _next(p), lambda a, b: segment_distance(q, a, b)))


def contains(p: Column, q: Column) -> Column:
    """Ray casting; points on the lower or left edge are inside, those on the upper or right edge are not."""
    hits = F.zip_with(p, _around(p), lambda a, b: F.when(((a["y"] > q["y"]) != (b["y"] > q["y"])) & (q["x"] < (b["x"] - a["x"]) * (q["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda n, h: n + h) % 2 == 1


def ring_distance(p: Column, q: Column) -> Column:
    """0 inside."""
    edge = F.array_min(F.zip_with(p, _around(p), lambda a, b: segment_distance(q, a, b)))
    return F.when(contains(p, q), _zero()).otherwise(edge)


def interpolate(p: Column, share: Column) -> Column:
    """The point of a two-vertex line at a share of its length."""
    return point(p[0]["x"] + share * (p[1]["x"] - p[0]["x"]), p[0]["y"] + share * (p[1]["y"] - p[0]["y"]))


def nearest_point(p: Column, q: Column) -> Column:
    """The point of a polyline nearest to q, on the first of several segments."""
    feet = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), _next(p), lambda a, b: F.struct(segment_distance(q, a, b).alias("d"), (a["x"] + along(q, a, b) * (b["x"] - a["x"])).alias("x"), (a["y"] + along(q, a, b) * (b["y"] - a["y"])).alias("y")))
    best = F.aggregate(feet, feet[0], lambda s, f: F.when(f["d"] < s["d"], f).otherwise(s))
    return point(best["x"], best["y"])


def project(p: Column, q: Column) -> Column:
    """The distance along a polyline of the place nearest to q, the first of several."""
    n = F.size(p)
    steps = F.zip_with(F.slice(p, F.lit(1), n - 1), _next(p), lambda a, b: F.struct(segment_distance(q, a, b).alias("d"), (along(q, a, b) * hypot(a, b)).alias("at"), hypot(a, b).alias("l")))
    start = F.struct(_zero().alias("run"), F.lit(float("inf")).alias("d"), _zero().alias("at"))
    walk = F.aggregate(steps, start, lambda s, x: F.struct((s["run"] + x["l"]).alias("run"), F.least(s["d"], x["d"]).alias("d"), F.when(x["d"] < s["d"], s["run"] + x["at"]).otherwise(s["at"]).alias("at")))
    return walk["at"]


def affine(p: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + e, y' = c x + d y + f for each point."""
    return F.transform(p, lambda u: point(a * u["x"] + b * u["y"] + e, c * u["x"] + d * u["y"] + f))


def clip_share(a: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The share of the segment a to b inside a box (Liang-Barsky); 0 if it misses."""
    lo, hi, ok = _zero(), F.lit(1.0), F.lit(True)
    for d, inside, outside in ((b["x"] - a["x"], a["x"] - x0, x1 - a["x"]), (b["y"] - a["y"], a["y"] - y0, y1 - a["y"])):
        # Where a direction has no extent, the segment is inside the slab or misses it.
        enter = F.when(d == 0, _zero()).otherwise(F.least(-inside / F.nullif(d, _zero()), outside / F.nullif(d, _zero())))
        leave = F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(-inside / F.nullif(d, _zero()), outside / F.nullif(d, _zero())))
        lo, hi, ok = F.greatest(lo, enter), F.least(hi, leave), ok & ((d != 0) | ((inside >= 0) & (outside >= 0)))
    return F.when(ok & (hi > lo), hi - lo).otherwise(_zero())


def half_plane(p: Column, nx: Column, ny: Column, c: Column) -> Column:
    """The part of a convex ring where nx x + ny y >= c (Sutherland-Hodgman)."""
    side = lambda u: nx * u["x"] + ny * u["y"] - c

    def edge(u: Column, v: Column) -> Column:
        su, sv = side(u), side(v)
        t = su / F.nullif(su - sv, _zero())
        cut = point(u["x"] + t * (v["x"] - u["x"]), u["y"] + t * (v["y"] - u["y"]))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.concat(F.when(su >= 0, F.array(u)).otherwise(none), F.when((su >= 0) != (sv >= 0), F.array(cut)).otherwise(none))

    return F.flatten(F.zip_with(p, _around(p), edge))


def convex_intersection(p: Column, q: Column) -> Column:
    """The intersection of a convex ring with a counter-clockwise convex ring, whose edges cut it one after the other."""
    edges = F.zip_with(q, _around(q), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), (a["y"] - b["y"]).alias("nx"), (b["x"] - a["x"]).alias("ny")))
    kind = "array<struct<x:double,y:double>>"
    return F.aggregate(edges, p.cast(kind), lambda ring, e: half_plane(ring, e["nx"], e["ny"], e["nx"] * e["ax"] + e["ny"] * e["ay"]).cast(kind))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common length of two intervals, 0 if they are apart."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), _zero())


def angle_difference(a: Column, b: Column) -> Column:
    """Between two directions in degrees, modulo 180."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def unit(a: Column, b: Column) -> Column:
    n = hypot(a, b)
    return point((b["x"] - a["x"]) / n, (b["y"] - a["y"]) / n)


def equal_within(p: Column, q: Column, tolerance: float) -> Column:
    return (F.size(p) == F.size(q)) & F.forall(F.zip_with(p, q, lambda a, b: F.coalesce(hypot(a, b) <= tolerance, F.lit(False))), lambda ok: ok)


def share_within(p: Column, q: Column, tolerance: float, step: float) -> Column:
    """The share of points, ``step`` apart along the two-vertex line p, that lie within ``tolerance`` of the polyline q."""
    n = F.greatest(F.lit(2), (length(p) / step).cast("int") + 1)
    near = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(line_distance(interpolate(p, i / (n - 1)), q) <= tolerance, 1.0).otherwise(0.0))
    return _sum(near) / n


def split_parallel(p: Column, degrees: Column) -> tuple[Column, Column]:
    """The two parts of a convex ring on either side of the line through its centroid in a direction."""
    c = centroid(p)
    nx, ny = -F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    at = nx * c["x"] + ny * c["y"]
    return half_plane(p, nx, ny, at), half_plane(p, -nx, -ny, -at)


def utm(longitude: Column, latitude: Column, zone: int) -> Column:
    """Degrees on WGS 84 to metres of a northern UTM zone, by the Krueger series to the third order (under a millimetre in the zone)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    lat, lon = F.radians(latitude), F.radians(longitude - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return point(500000 + 0.9996 * radius * x, 0.9996 * radius * y)
