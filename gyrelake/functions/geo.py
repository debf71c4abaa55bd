"""Scalar geometry as column expressions; all of it stays in generated code or higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius (km), gravity, the sidereal day.
RADIUS, GRAVITY, SIDEREAL = 6370.997, 9.807, 86164.1


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * RADIUS * 1000 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: by zero it is infinite, or not a number for 0 / 0, and no error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def near_haversine_km(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The distance in km, null beyond 15 degrees of latitude or 20 of longitude."""
    return F.when((F.abs(lat1 - lat0) <= 15) & (F.abs(lon1 - lon0) <= 20), haversine(lon0, lat0, lon1, lat1) / 1000)


def wrapped(lon: Column, west: Column | float) -> Column:
    """Longitude within [west, west + 360)."""
    west = west if isinstance(west, Column) else F.lit(float(west))
    return F.pmod(lon - west, F.lit(360.0)) + west


def bearing(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Initial bearing from the first to the second point, degrees from east, 90 added."""
    a, b, d = F.radians(lat0), F.radians(lat1), F.radians(lon1 - lon0)
    return F.degrees(F.atan2(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), F.cos(b) * F.sin(d))) + 90


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre, keeping distance and direction from it."""
    a, b, d = F.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    r = haversine(lon0, lat0, lon, lat)
    angle = F.atan2(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), F.cos(b) * F.sin(d))
    return r * F.cos(angle), r * F.sin(angle)


def from_local(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """The inverse of `to_local`."""
    d = F.sqrt(x * x + y * y) / (RADIUS * 1000)
    angle, a = F.atan2(y, x), F.radians(lat0)
    lat = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.sin(angle))
    lon = F.radians(lon0) + F.atan2(F.sin(d) * F.cos(angle), F.cos(a) * F.cos(d) - F.sin(a) * F.sin(d) * F.sin(angle))
    return F.degrees(lon), F.degrees(lat)


def circle(lon0: Column, lat0: Column, radius: Column, points: int) -> Column:
    """An array of (x, y) on the circle, the first point again at the end."""

    def at(k: Column) -> Column:
        angle = k.cast("double") * (2 * 3.141592653589793 / (points - 1))
        lon, lat = from_local(radius * F.cos(angle), radius * F.sin(angle), lon0, lat0)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once a row, however often f names it: column expressions are copied, and those within
    higher-order functions are worked out anew for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def cross_sum(ring: Column) -> Column:
    """Twice the signed area of a closed ring of (x, y)."""
    return once(ring, _cross_sum)


def _cross_sum(ring: Column) -> Column:
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a.x * b.y - b.x * a.y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    return F.abs(cross_sum(ring)) / 2


def winding(ring: Column, x: Column, y: Column) -> Column:
    """How often a closed ring goes round a point; 0 outside."""

    def turns(v: Column) -> Column:
        def turn(a: Column, b: Column) -> Column:
            side = (b.x - a.x) * (v.y - a.y) - (v.x - a.x) * (b.y - a.y)
            return F.when((a.y <= v.y) & (b.y > v.y) & (side > 0), 1).when((a.y > v.y) & (b.y <= v.y) & (side < 0), -1).otherwise(0)

        return F.zip_with(F.slice(v.ring, 1, F.size(v.ring) - 1), F.slice(v.ring, 2, F.size(v.ring) - 1), turn)

    return F.aggregate(once(F.struct(ring.alias("ring"), x.alias("x"), y.alias("y")), turns), F.lit(0), lambda s, v: s + v)


def is_convex(ring: Column) -> Column:
    """Whether all turns of a closed ring go the same way."""

    def turns(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        sides = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct((b.x - a.x).alias("x"), (b.y - a.y).alias("y")))
        return once(sides, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.slice(s, 1, 1)), lambda a, b: a.x * b.y - a.y * b.x))

    return once(once(ring, turns), lambda found: F.forall(found, lambda t: t >= 0) | F.forall(found, lambda t: t <= 0))


def vertex_mean(ring: Column) -> tuple[Column, Column]:
    """Mean of a closed ring's vertices, the repeated first one left out."""
    open_ring = F.slice(ring, 2, F.size(ring) - 1)
    n = F.size(open_ring)
    return _mean(open_ring, "x") / n, _mean(open_ring, "y") / n


def _mean(ring: Column, key: str) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[key])


def coriolis(lat: Column) -> Column:
    return 4 * 3.141592653589793 / SIDEREAL * F.sin(F.radians(lat))


def on_segment_path(i0: Column, j0: Column, i1: Column, j1: Column) -> Column:
    """Cells crossed between two cells: one per step of the longer axis, the other rounded toward zero."""
    steps = F.greatest(F.abs(i1 - i0), F.abs(j1 - j0))
    way = lambda a, b, k: (a + F.when(steps == 0, 0).otherwise((b - a) * k / steps)).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(way(i0, i1, k).alias("i"), way(j0, j1, k).alias("j")))
