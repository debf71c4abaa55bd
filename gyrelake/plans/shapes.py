"""Queries on shapes of rings around the view's rows, whose results are known from how the rings are made; and nearest cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.functions import geo
from gyrelake.operators import networks, outlines, pairs, shapes
from gyrelake.plans.network import place_edges
from gyrelake.plans.observation import box_ring, ring_of, rounded, simple
from gyrelake.plans.registry import ORACLE
from gyrelake.sources.tables import written


def _circled(o: DataFrame) -> DataFrame:
    """Twenty points on a circle in the local plane of each row, the last one the first."""
    k = F.sequence(F.lit(0), F.lit(19))
    metre = 180 / (3.141592653589793 * geo.RADIUS * 1000)
    angle = lambda i: i.cast("double") * (2 * 3.141592653589793 / 19)
    # every ring is symmetrical about its row's latitude, which is the middle of its points
    at = lambda i: F.struct((F.col("lon") + F.col("radius_s") * F.sin(angle(i)) * metre / F.cos(F.radians("lat"))).alias("x"), (F.col("lat") + F.col("radius_s") * F.cos(angle(i)) * metre).alias("y"))
    return o.withColumn("ring", F.transform(k, at))


def _fitted(o: DataFrame) -> DataFrame:
    c = shapes.fits(_circled(o)).select("obs_id", F.col("circle.lon").alias("lon"), F.col("circle.lat").alias("lat"), F.col("circle.radius").alias("radius"), F.col("circle.error").alias("error"), (F.col("circle.area") / 1e6).alias("area"))
    return c.select("obs_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.round("radius", 2).alias("radius"), F.round("error", 4).alias("error"), F.round("area", 2).alias("area"))


simple("circle_fits", _fitted, "SELECT obs_id, round(lon, 5) AS lon, round(lat, 5) AS lat, round(radius_s, 2) AS radius, round(100 * (1 - 19 * sin(2 * pi() / 19) / (2 * pi())), 4) AS error, round(9.5 * sin(2 * pi() / 19) * radius_s * radius_s / 1e6, 2) AS area FROM obs")


def _tilted(o: DataFrame) -> DataFrame:
    """Sixteen points on an ellipse of half axes 2 and nb + 2, the long one to the east or (odd tracks) to the north."""
    k = F.sequence(F.lit(0), F.lit(16))
    a, b = F.when(F.col("track") % 2 == 0, F.col("nb") + 2).otherwise(F.lit(2)), F.when(F.col("track") % 2 == 0, F.lit(2)).otherwise(F.col("nb") + 2)
    angle = lambda i: i.cast("double") * (2 * 3.141592653589793 / 16)
    return o.withColumn("ring", F.transform(k, lambda i: F.struct((F.col("lon") + a * F.cos(angle(i))).alias("x"), (F.col("lat") + b * F.sin(angle(i))).alias("y"))))


def _ellipses(o: DataFrame) -> DataFrame:
    e = shapes.ellipse(_tilted(o)).select("obs_id", "ellipse.*")
    return e.select("obs_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(F.greatest("a", "b"), 5).alias("long"), F.round(F.least("a", "b"), 5).alias("short"))


simple("ellipse_fits", _ellipses, "SELECT obs_id, round(lon, 5) AS x, round(lat, 5) AS y, CAST(nb + 2 AS DOUBLE) AS long, 2.0e0 AS short FROM obs")


def _notched(o: DataFrame) -> DataFrame:
    """A rectangle of two by nb + 1 with a notch in its upper side."""
    x, y, h = F.col("lon"), F.col("lat"), F.col("nb") + 1
    return o.withColumn("ring", ring_of((x, y), (x + 2, y), (x + 2, y + h), (x + 1, y + h / 2), (x, y + h), (x, y)))


simple("convex_hulls", lambda o: _notched(o).select("obs_id", shapes.convex_hull("ring").alias("hull")).select("obs_id", F.size("hull").alias("points"), F.round(geo.ring_area(F.col("hull")), 5).alias("area"), geo.is_convex(F.col("hull")).alias("convex")), "SELECT obs_id, 5 AS points, round(2.0 * (nb + 1), 5) AS area, true AS convex FROM obs")


def _sides(o: DataFrame) -> DataFrame:
    """A square of two degrees with three points more on each side, a hundredth of a degree inside of it."""
    x, y = F.col("lon"), F.col("lat")
    side = [(-1 + k * 0.5, -1 + (0.01 * k if 0 < k < 4 else 0)) for k in range(4)]
    turned = [p for turn in range(4) for p in [(a, b) if turn == 0 else (-b, a) if turn == 1 else (-a, -b) if turn == 2 else (b, -a) for a, b in side]]
    return o.withColumn("ring", ring_of(*[(x + a, y + b) for a, b in [*turned, turned[0]]]))


simple("simplified_rings", lambda o: _sides(o).select("obs_id", shapes.simplified("ring", 5).alias("r")).select("obs_id", F.size("r").alias("points"), F.round(geo.ring_area(F.col("r")), 6).alias("area")), "SELECT obs_id, 5 AS points, 4.0e0 AS area FROM obs")
simple("thinned_rings", lambda o: o.withColumn("ring", box_ring(0.5)).select("obs_id", shapes.resampled("ring", size=41).alias("r")).select("obs_id", F.size(shapes.thinned("r", 0.35)).alias("points")), "SELECT obs_id, 10 AS points FROM obs")


def _even(o: DataFrame) -> DataFrame:
    r = o.withColumn("ring", box_ring(0.5)).select("obs_id", "lon", "lat", shapes.resampled("ring", size=9).alias("r"))
    return r.select("obs_id", F.posexplode("r").alias("k", "p")).select("obs_id", "k", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


simple("resampled_rings", _even, "SELECT obs_id, CAST(k AS INTEGER) AS k, round(lon + [-0.5, -0.5, -0.5, 0.0, 0.5, 0.5, 0.5, 0.0, -0.5][k + 1], 5) AS x, round(lat + [-0.5, 0.0, 0.5, 0.5, 0.5, 0.0, -0.5, -0.5, -0.5][k + 1], 5) AS y FROM obs, range(9) r(k)")


def _padded(o: DataFrame) -> DataFrame:
    ring = F.concat(box_ring(0.5), F.array_repeat(F.struct((F.col("lon") - 0.5).alias("x"), (F.col("lat") - 0.5).alias("y")), F.col("nb").cast("int")))
    return o.withColumn("ring", ring).select("obs_id", F.size("ring").alias("before"), F.size(shapes.without_repeats(F.col("ring"))).alias("after"))


simple("reduced_rings", _padded, "SELECT obs_id, CAST(5 + nb AS INTEGER) AS before, 4 AS after FROM obs")
simple("ring_centres", lambda o: o.withColumn("ring", box_ring(0.5)).select("obs_id", *[F.round(c, 6).alias(n) for c, n in zip(geo.vertex_mean(F.col("ring")), ("x", "y"), strict=True)]), "SELECT obs_id, round(lon, 6) AS x, round(lat, 6) AS y FROM obs")
simple("notched_areas", lambda o: _notched(o).select("obs_id", F.round(geo.ring_area(F.col("ring")), 6).alias("area"), geo.is_convex(F.col("ring")).alias("convex")), "SELECT obs_id, round(1.5 * (nb + 1), 6) AS area, false AS convex FROM obs")


def _world(o: DataFrame) -> DataFrame:
    """Places all over the sphere, poles and the seam included, that lie on no grid."""
    return o.withColumns({"lon": F.pmod(F.col("lon") * 37.123 + F.col("lat") * 11.7, F.lit(360.0)), "lat": F.degrees(F.asin(F.sin(F.col("lon") * 1.7 + F.col("lat") * 5.3)))})


def _nearest(o: DataFrame) -> DataFrame:
    world = _world(o)
    cells = world.where("track % 2 = 0").select(F.col("obs_id").alias("cid"), "lon", "lat")
    return rounded(pairs.nearest(world.where("track % 2 = 1").select(F.col("obs_id").alias("pid"), "lon", "lat"), cells), "metres", digits=2)


simple("nearest_cells", _nearest, "w AS (SELECT obs_id, track, radians(lon * 37.123e0 + lat * 11.7e0 - 360 * floor((lon * 37.123e0 + lat * 11.7e0) / 360)) AS x, asin(sin(lon * 1.7e0 + lat * 5.3e0)) AS y FROM obs), s AS (SELECT obs_id, track, cos(y) * cos(x) AS px, cos(y) * sin(x) AS py, sin(y) AS pz FROM w), d AS (SELECT p.obs_id AS pid, c.obs_id AS cid, pow(p.px - c.px, 2) + pow(p.py - c.py, 2) + pow(p.pz - c.pz, 2) AS far FROM s p JOIN s c ON p.track % 2 = 1 AND c.track % 2 = 0) SELECT pid, cid, round(2 * 6370997.0 * asin(least(sqrt(far) / 2, 1.0)), 2) AS metres FROM d QUALIFY row_number() OVER (PARTITION BY pid ORDER BY far, cid) = 1")


def _by_batches(o: DataFrame) -> DataFrame:
    """Neighbours of every third day at a time, each batch joined with what is known from those before."""
    p = written(place_edges(o).select("a", "b", (F.col("time") % 3).alias("batch")).distinct())
    known = o.sparkSession.createDataFrame([], "node long, component long")
    for batch in range(3):
        known, _ = networks.grown(known, p.where(F.col("batch") == batch))
    return known


simple("components_by_batches", _by_batches, None)
ORACLE["components_by_batches"] = ORACLE["components"]  # as from all edges at once


def _unions(o: DataFrame) -> DataFrame:
    pieces = outlines.outline(o.select("track", F.col("obs_id").alias("rid"), box_ring(0.5).alias("ring")))
    return outlines.areas(pieces).select("track", F.round("area", 6).alias("area"))


# corners lie on sixteenths of a degree, so cells of that size fill every union
simple("track_unions", _unions, "c AS (SELECT DISTINCT track, i, j FROM (SELECT track, unnest(range(CAST((lon - 0.5) * 16 AS BIGINT), CAST((lon + 0.5) * 16 AS BIGINT))) AS i, lat FROM obs), range(-200, 200) q(j) WHERE j >= (lat - 0.5) * 16 AND j < (lat + 0.5) * 16) SELECT track, round(count(*) / 256.0, 6) AS area FROM c GROUP BY 1")
