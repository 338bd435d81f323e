"""Column functions on rings: arrays of points (x, y). A polygon is an array of rings, the outer one first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: in lambdas and in filters Spark computes a column as often as it is written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_closed(ring: Column, near: float = 1e-6) -> Column:
    """At least four points, and the first and last one alike; false for null and empty rings."""
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((F.size(ring) >= 4) & (F.abs(a["x"] - b["x"]) <= near) & (F.abs(a["y"] - b["y"]) <= near), F.lit(False))


def close_ring(ring: Column) -> Column:
    return let(ring, lambda r: F.when(is_closed(r) | (F.size(r) == 0), r).otherwise(F.concat(r, F.slice(r, 1, 1))))


def _edges(ring: Column, edge) -> Column:
    """``edge(p, q)`` for each pair of neighbours."""
    n = lambda r: F.greatest(F.size(r) - 1, F.lit(0))
    return let(ring, lambda r: F.zip_with(F.slice(r, F.lit(1), n(r)), F.slice(r, F.lit(2), n(r)), edge))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def ring_area_signed(ring: Column) -> Column:
    """Shoelace area of the closed ring, counter-clockwise positive."""
    return _sum(_edges(close_ring(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_area_abs(ring: Column) -> Column:
    """Area of the ring as stored; 0 below four points."""
    area = lambda r: F.abs(_sum(_edges(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2
    return let(ring, lambda r: F.when(F.size(r) >= 4, area(r)).otherwise(0.0))


def polygon_area(rings: Column) -> Column:
    """Outer ring less holes, not below 0."""
    holes = F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.abs(ring_area_signed(r)))
    return F.greatest(F.abs(ring_area_signed(F.get(rings, F.lit(0)))) - _sum(holes), F.lit(0.0))


def ring_perimeter(ring: Column) -> Column:
    return _sum(_edges(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def bbox(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bbox_area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def bbox_overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: edges that cross the height of the point strictly right of it."""
    crosses = lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).cast("int")).otherwise(0)
    return F.pmod(F.aggregate(_edges(close_ring(ring), crosses), F.lit(0), lambda s, c: s + c), F.lit(2)) == 1


def small_angles(ring: Column, degrees: float = 18.0) -> Column:
    """Corners of at most ``degrees``; 0 for rings below five points."""
    n = F.size(ring) - 1

    def angle(i: Column) -> Column:
        at, a, b = F.get(ring, i), F.get(ring, F.pmod(i - 1, n).cast("int")), F.get(ring, F.pmod(i + 1, n).cast("int"))
        ux, uy, vx, vy = a["x"] - at["x"], a["y"] - at["y"], b["x"] - at["x"], b["y"] - at["y"]
        cos = (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy))
        return F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))) <= degrees

    return F.when(F.size(ring) >= 5, F.size(F.filter(F.sequence(F.lit(0), n - 1), angle))).otherwise(0)


def label_point(ring: Column) -> Column:
    """The mean of the stored points, the closing one included."""
    n = F.size(ring)
    return point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)
