"""Folds over rings and paths, arrays of STRUCT<x DOUBLE, y DOUBLE>, in Catalyst alone.

A closing vertex equal to the first does no harm to sums over edges. Empty rings give null
where no value makes sense. Folds take the ring as an argument more than once, so select it
as a column before applying several of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def rotated(ring: Column) -> Column:
    """The ring from its second vertex on, the first one last."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))).otherwise(ring)


def before(ring: Column) -> Column:
    """The ring from its last vertex on."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1))).otherwise(ring)


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def signed_area(ring: Column) -> Column:
    """Positive for a counter-clockwise ring."""
    return total(F.zip_with(ring, rotated(ring), cross)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return total(F.zip_with(ring, rotated(ring), distance))


def length(path: Column) -> Column:
    """Of an open path."""
    legs = F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path)), distance)
    return F.when(F.size(path) > 1, total(legs)).otherwise(0.0)


def mean_point(ring: Column) -> Column:
    n = F.size(ring)
    of = lambda c: total(F.transform(ring, lambda p: p[c])) / n
    return F.when(n > 0, point(of("x"), of("y")))


def centroid(ring: Column) -> Column:
    """The area-weighted centroid; of a ring without area the mean point."""
    a = signed_area(ring)
    of = lambda c: total(F.zip_with(ring, rotated(ring), lambda p, q: (p[c] + q[c]) * cross(p, q))) / (6 * a)
    return F.when(F.abs(a) > 1e-12, point(of("x"), of("y"))).otherwise(mean_point(ring))


def bounds(ring: Column) -> Column:
    of = lambda c, f: f(F.transform(ring, lambda p: p[c]))
    return F.struct(of("x", F.array_min).alias("min_x"), of("y", F.array_min).alias("min_y"), of("x", F.array_max).alias("max_x"), of("y", F.array_max).alias("max_y"))


def bbox_centre(ring: Column, decimals: int = 10) -> Column:
    b = bounds(ring)
    return point(F.round((b["min_x"] + b["max_x"]) / 2, decimals), F.round((b["min_y"] + b["max_y"]) / 2, decimals))


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end; under three vertices null."""
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(F.size(ring) < 3, None).when(same & (F.size(ring) > 3), ring).when(same, None).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def reversed_ring(ring: Column) -> Column:
    """A closed ring the other way round, with its first vertex still first and last."""
    return F.concat(F.slice(ring, 1, 1), F.reverse(F.slice(ring, F.lit(2), F.size(ring) - 2)), F.slice(ring, 1, 1))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """From a point to a segment, its ends included."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / squared))).otherwise(0.0)
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def boundary_distance(p: Column, ring: Column) -> Column:
    return F.array_min(F.zip_with(ring, rotated(ring), lambda a, b: segment_distance(p, a, b)))


def odd_crossings(ring: Column, p: Column) -> Column:
    """Whether a ray to the right of a point meets the boundary an odd number of times; of a point on the boundary either may hold."""
    crossing = F.zip_with(ring, rotated(ring), lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(crossing, lambda c: c)) % 2 == 1


def contains(ring: Column, p: Column) -> Column:
    """Whether a point lies inside; the boundary is outside."""
    return odd_crossings(ring, p) & (boundary_distance(p, ring) > 1e-12)


def polygon_distance(p: Column, ring: Column) -> Column:
    """Zero inside, else the distance to the boundary."""
    return F.when(contains(ring, p), 0.0).otherwise(boundary_distance(p, ring))


def same_point(p: Column, q: Column, epsilon: float = EPSILON) -> Column:
    return (F.abs(p["x"] - q["x"]) < epsilon) & (F.abs(p["y"] - q["y"]) < epsilon)


def merged_points(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """The points of two rings by x and y, of which one goes that equals the last one kept."""
    ordered = F.array_sort(F.concat(a, b))
    kept = lambda acc, p: F.when((F.size(acc) > 0) & same_point(F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(p)), -1), p, epsilon), acc).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), kept)


def turn_degrees(p: Column, q: Column, r: Column) -> Column:
    """The angle at ``q`` between ``p`` and ``r``, 0 to 180."""
    ux, uy, vx, vy = p["x"] - q["x"], p["y"] - q["y"], r["x"] - q["x"], r["y"] - q["y"]
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / size)))))


def curvatures(ring: Column) -> Column:
    """At each vertex, by how many degrees the boundary turns."""
    return F.zip_with(F.zip_with(before(ring), ring, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), rotated(ring), lambda pq, r: 180 - turn_degrees(pq["p"], pq["q"], r))


def smooth_curve_vertices(ring: Column, low: float = 5, high: float = 30) -> Column:
    """For each vertex whether it turns as on a smooth curve."""
    return F.transform(curvatures(ring), lambda c: F.coalesce((c > low) & (c < high), F.lit(False)))


def is_circular(ring: Column, most_variance: float = 0.05, least_vertices: int = 8) -> Column:
    """At least eight vertices at much the same distance from their mean point."""
    radii = F.transform(ring, lambda p: distance(p, mean_point(ring)))
    mean = total(radii) / F.size(ring)
    variance = total(F.transform(radii, lambda r: F.pow(r - mean, 2))) / F.size(ring)
    return (F.size(ring) >= least_vertices) & (F.sqrt(variance) / mean < most_variance)


def signature(ring: Column, decimals: int = 2) -> Column:
    """A hash that rings share which differ by rotation or direction alone."""
    c = mean_point(ring)
    return F.xxhash64(F.round(area(ring), decimals), F.round(perimeter(ring), decimals), F.round(c["x"], decimals), F.round(c["y"], decimals), F.size(ring))


def same_ring(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """As many vertices, the same area and the same distances from the mean point."""
    radii = lambda ring: F.array_sort(F.transform(ring, lambda p: distance(p, mean_point(ring))))
    close = F.forall(F.zip_with(radii(a), radii(b), lambda p, q: F.abs(p - q) < tolerance), lambda x: x)
    return (F.size(a) == F.size(b)) & (F.abs(area(a) - area(b)) < tolerance) & close


def farthest_distance(points: Column) -> Column:
    return F.array_max(F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: distance(p, q)))))


def farthest_pair(points: Column) -> Column:
    """The two points of a short array that lie farthest apart, with their distance."""
    pairs = F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: F.struct(distance(p, q).alias("d"), p.alias("a"), q.alias("b")))))
    return F.array_max(pairs)


def nearest_points(points: Column, p: Column, k: int = 10) -> Column:
    """The ``k`` points nearest to ``p``, the nearest first."""
    return F.transform(F.slice(F.array_sort(F.transform(points, lambda q: F.struct(distance(p, q).alias("d"), q.alias("q")))), 1, k), lambda s: s["q"])


def point_at(path: Column, along: Column) -> Column:
    """The point of a path at a distance along it; its ends beyond."""
    state = F.struct(F.lit(0.0).alias("done"), F.element_at(path, 1).alias("last"), F.lit(None).cast("struct<x double,y double>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        leg = distance(s["last"], p)
        share = F.when(leg > 0, (along - s["done"]) / leg).otherwise(0.0)
        here = point(s["last"]["x"] + share * (p["x"] - s["last"]["x"]), s["last"]["y"] + share * (p["y"] - s["last"]["y"]))
        hit = s["found"].isNull() & (s["done"] + leg >= along)
        return F.struct((s["done"] + leg).alias("done"), p.alias("last"), F.when(hit, here).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.slice(path, F.lit(2), F.size(path)), state, step, lambda s: F.coalesce(s["found"], s["last"]))


def vector_degrees(p: Column, q: Column) -> Column:
    """The direction from ``p`` to ``q``, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(360.0))


def clockwise_radians(a: Column, b: Column) -> Column:
    """The clockwise angle from direction ``a`` to direction ``b``, both in radians."""
    return F.pmod(a - b, F.lit(6.283185307179586))


def entity_points(kind: Column, points: Column, centre: Column, radius: Column, start: Column, end: Column) -> Column:
    """Points that bound a drawing's entity: a circle gives eight, an arc nine, others their own."""
    on = lambda angle: point(centre["x"] + radius * F.cos(angle), centre["y"] + radius * F.sin(angle))
    circle = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: on(i * 0.7853981633974483))
    sweep = F.radians(F.pmod(end - start, F.lit(360.0)))
    arc = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: on(F.radians(start) + sweep * i / 8))
    return F.when(kind == "CIRCLE", circle).when(kind == "ARC", arc).otherwise(points)
