"""Queries on gridded fields, over grids binned from the observation view: derivatives, currents, interpolation, filters, spectra, ring statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.operators import grids
from gyrelake.plans.observation import box_ring, rounded, view
from gyrelake.plans.registry import VIEW, query

#: 32 tracks by every other day make a grid: i 0 to 47, j 0 to 31, a quarter of a degree from (0, 20); n is the number of
#: observations in a cell, from which the cell's values come; one cell in 37 is masked. With more tracks there are more grids.
CUBE = """seen AS (SELECT CAST(2 * floor(track / 32) + time % 2 AS BIGINT) AS t, CAST(floor(lon * 4) AS BIGINT) % 48 AS i, CAST(floor((lat + 8) * 4) AS BIGINT) % 32 AS j, count(*) AS n FROM obs GROUP BY 1, 2, 3),
c AS (SELECT t, i, j, coalesce(n, 0) AS n FROM (SELECT t, i, j FROM (SELECT DISTINCT t FROM seen) a, range(48) b(i), range(32) d(j)) LEFT JOIN seen USING (t, i, j)),
g AS (SELECT t, i, j, n, i * 0.25e0 AS lon, 20 + j * 0.25e0 AS lat, CASE WHEN (i * 32 + j + n) % 37 <> 5 THEN ((i * 7 + j * 3 + t * 11 + n * 13) % 50) * 0.01e0 END AS h, ((i * 5 + j * j + n * 3) % 23) * 0.0625e0 - 0.5 AS u, ((i * i + 3 * j + n * 5) % 19) * 0.0625e0 - 0.5 AS v FROM c)"""
GRID = VIEW.rstrip() + ", " + CUBE
METRE = 3.141592653589793 / 180 * 6370997.0


def cube(o: DataFrame) -> DataFrame:
    """The observation view binned to grids (t, i, j), every cell of every grid with its number of observations."""
    t = (2 * F.floor(F.col("track") / 32) + F.col("time") % 2).cast("long")
    seen = o.select(t.alias("t"), F.pmod(F.floor(F.col("lon") * 4), F.lit(48)).cast("int").alias("i"), F.pmod(F.floor((F.col("lat") + 8) * 4), F.lit(32)).cast("int").alias("j"))
    seen = seen.groupBy("t", "i", "j").agg(F.count("*").alias("n"))
    cells = o.select(t.alias("t")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return cells.join(seen, ["t", "i", "j"], "left").fillna(0, ["n"])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, t, n = (F.col(c) for c in ("i", "j", "t", "n"))
    return cube(view(spark, sf_dir)).select("t", "i", "j", "n", (i * 0.25).alias("lon"), (20 + j * 0.25).alias("lat"), F.when((i * 32 + j + n) % 37 != 5, (i * 7 + j * 3 + t * 11 + n * 13) % 50 * 0.01).alias("h"), ((i * 5 + j * j + n * 3) % 23 * 0.0625 - 0.5).alias("u"), ((i * i + 3 * j + n * 5) % 19 * 0.0625 - 0.5).alias("v"))


def on_grid(name: str, f, sql: str | None) -> None:
    """sql: what follows the grid's own statement; it begins with a comma where it adds to that."""
    query(name, GRID + " " + sql if sql else None, view=False)(lambda spark, sf_dir: f(grid(spark, sf_dir)))


LINES = "WINDOW x AS (PARTITION BY t, j ORDER BY i), y AS (PARTITION BY t, i ORDER BY j)"
on_grid("grid_rows", lambda g: g.groupBy("t").agg(F.count("*").alias("cells"), F.count("h").alias("valid"), F.min("lon").alias("west"), F.max("lat").alias("north")), "SELECT t, count(*) AS cells, count(h) AS valid, min(lon) AS west, max(lat) AS north FROM g GROUP BY 1")
on_grid("grid_tile", lambda g: g.where("t = 1 and i between 10 and 19 and j between 5 and 9").select("i", "j", "u"), "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, u FROM g WHERE t = 1 AND i BETWEEN 10 AND 19 AND j BETWEEN 5 AND 9")
on_grid("finite_diff", lambda g: rounded(grids.differences(g, "h", "d").select("t", "i", "j", "d"), "d"), f"SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN h IS NOT NULL THEN coalesce((lead(h) OVER x - lag(h) OVER x) / 2, lead(h) OVER x - h, h - lag(h) OVER x) END, 6) AS d FROM g {LINES}")
on_grid("finite_diff_circular", lambda g: rounded(grids.differences(g, "u", "d", size=48).select("t", "i", "j", "d"), "d"), "SELECT a.t, CAST(a.i AS INTEGER) AS i, CAST(a.j AS INTEGER) AS j, round((b.u - c.u) / 2, 6) AS d FROM g a JOIN g b ON b.t = a.t AND b.j = a.j AND b.i = (a.i + 1) % 48 JOIN g c ON c.t = a.t AND c.j = a.j AND c.i = (a.i + 47) % 48")
on_grid("stencil5", lambda g: rounded(grids.stencil(g, "h", "d", "j", 2).select("t", "i", "j", "d"), "d"), f"SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN h IS NOT NULL THEN coalesce((lag(h, 2) OVER y - lead(h, 2) OVER y + 8 * (lead(h) OVER y - lag(h) OVER y)) / 12, (lead(h) OVER y - lag(h) OVER y) / 2, lead(h) OVER y - h, h - lag(h) OVER y) END, 6) AS d FROM g {LINES}")
on_grid("geostrophic_currents", lambda g: rounded(grids.with_currents(g.drop("u", "v"), "h", 0.25, 1).select("t", "i", "j", "u", "v"), "u", "v", digits=5), f"SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(-9.807 / (4 * pi() / 86164.1 * sin(radians(lat))) * dy / {METRE * 0.25}, 5) AS u, round(9.807 / (4 * pi() / 86164.1 * sin(radians(lat))) * dx / ({METRE * 0.25} * cos(radians(lat))), 5) AS v FROM (SELECT *, CASE WHEN h IS NOT NULL THEN coalesce((lead(h) OVER x - lag(h) OVER x) / 2, lead(h) OVER x - h, h - lag(h) OVER x) END AS dx, CASE WHEN h IS NOT NULL THEN coalesce((lead(h) OVER y - lag(h) OVER y) / 2, lead(h) OVER y - h, h - lag(h) OVER y) END AS dy FROM g {LINES})")
SLOPE = "coalesce((lead({0}) OVER {1} - lag({0}) OVER {1}) / 2, lead({0}) OVER {1} - {0}, {0} - lag({0}) OVER {1})"
on_grid("okubo_weiss", lambda g: grids.okubo_weiss(g, 0.25).select("t", "i", "j", F.round(F.col("ow") * 1e12, 4).alias("ow"), F.round(F.col("vorticity") * 1e6, 4).alias("vorticity")), f"SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round((pow(ux - vy, 2) + pow(vx + uy, 2) - pow(vx - uy, 2)) * 1e12, 4) AS ow, round((vx - uy) * 1e6, 4) AS vorticity FROM (SELECT *, {SLOPE.format('u', 'x')} / ({METRE * 0.25} * cos(radians(lat))) AS ux, {SLOPE.format('v', 'x')} / ({METRE * 0.25} * cos(radians(lat))) AS vx, {SLOPE.format('u', 'y')} / {METRE * 0.25} AS uy, {SLOPE.format('v', 'y')} / {METRE * 0.25} AS vy FROM g {LINES})")
on_grid("ow_threshold", lambda g: grids.okubo_weiss(g, 0.25).withColumn("cut", F.lit(-0.2) * F.stddev_pop("ow").over(Window.partitionBy("t"))).groupBy("t").agg(F.count_if(F.col("ow") < F.col("cut")).alias("n")), f"SELECT t, count(*) FILTER (WHERE ow < -0.2 * s) AS n FROM (SELECT *, stddev_pop(ow) OVER (PARTITION BY t) AS s FROM (SELECT *, pow(ux - vy, 2) + pow(vx + uy, 2) - pow(vx - uy, 2) AS ow FROM (SELECT *, {SLOPE.format('u', 'x')} / ({METRE * 0.25} * cos(radians(lat))) AS ux, {SLOPE.format('v', 'x')} / ({METRE * 0.25} * cos(radians(lat))) AS vx, {SLOPE.format('u', 'y')} / {METRE * 0.25} AS uy, {SLOPE.format('v', 'y')} / {METRE * 0.25} AS vy FROM g {LINES}))) GROUP BY 1")
POINTS = "pts AS (SELECT obs_id AS pid, CAST(2 * floor(track / 32) + time % 2 AS BIGINT) AS t, lon * 0.4 AS x, 22 + lat * 0.3 AS y FROM obs)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select(F.col("obs_id").alias("pid"), (2 * F.floor(F.col("track") / 32) + F.col("time") % 2).cast("long").alias("t"), (F.col("lon") * 0.4).alias("x"), (22 + F.col("lat") * 0.3).alias("y"))


GRID_CTE = CUBE


@query("bilinear_interp", VIEW.rstrip() + f", {POINTS}, {GRID_CTE}, q AS (SELECT *, x / 0.25 AS fi, (y - 20) / 0.25 AS fj FROM pts), w AS (SELECT *, floor(fi) AS i0, floor(fj) AS j0, fi - floor(fi) AS p, fj - floor(fj) AS r FROM q) SELECT pid, round((1 - p) * (1 - r) * a.h + (1 - p) * r * b.h + p * (1 - r) * c.h + p * r * d.h, 6) AS value FROM w LEFT JOIN g a ON a.t = w.t AND a.i = i0 AND a.j = j0 LEFT JOIN g b ON b.t = w.t AND b.i = i0 AND b.j = j0 + 1 LEFT JOIN g c ON c.t = w.t AND c.i = i0 + 1 AND c.j = j0 LEFT JOIN g d ON d.t = w.t AND d.i = i0 + 1 AND d.j = j0 + 1", view=False)
def bilinear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grids.at_points(_points(spark, sf_dir), grid(spark, sf_dir), "h", 0.0, 20.0, 0.25).select("pid", "value"), "value")


@query("nearest_interp", VIEW.rstrip() + f", {POINTS}, {GRID_CTE} SELECT pid, h AS value FROM pts LEFT JOIN g ON g.t = pts.t AND g.i = round(x / 0.25) AND g.j = round((y - 20) / 0.25)", view=False)
def nearest_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.at_points(_points(spark, sf_dir), grid(spark, sf_dir), "h", 0.0, 20.0, 0.25, "nearest").select("pid", "value")


CORNERS = "LEFT JOIN g a{0} ON a{0}.t = w.t + {0} AND a{0}.i = i0 AND a{0}.j = j0 LEFT JOIN g b{0} ON b{0}.t = w.t + {0} AND b{0}.i = i0 AND b{0}.j = j0 + 1 LEFT JOIN g c{0} ON c{0}.t = w.t + {0} AND c{0}.i = i0 + 1 AND c{0}.j = j0 LEFT JOIN g d{0} ON d{0}.t = w.t + {0} AND d{0}.i = i0 + 1 AND d{0}.j = j0 + 1"
BETWEEN = "((1 - p) * (1 - r) * a{0}.u + (1 - p) * r * b{0}.u + p * (1 - r) * c{0}.u + p * r * d{0}.u)"
# places and a share of time whose results do not end at the digit that is rounded
SPOTS = "pts AS (SELECT obs_id AS pid, CAST(2 * floor(track / 32) AS BIGINT) AS t, lon * 0.3771 + 0.0131 AS x, 22 + lat * 0.3113 AS y FROM obs)"


@query("time_interp", VIEW.rstrip() + f", {SPOTS}, {GRID_CTE}, q AS (SELECT *, x / 0.25 AS fi, (y - 20) / 0.25 AS fj FROM pts), w AS (SELECT *, floor(fi) AS i0, floor(fj) AS j0, fi - floor(fi) AS p, fj - floor(fj) AS r FROM q) SELECT pid, round({BETWEEN.format(0)} * (1 - 0.3e0) + {BETWEEN.format(1)} * 0.3e0, 6) AS value FROM w {CORNERS.format(0)} {CORNERS.format(1)}", view=False)
def time_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir)
    spots = o.select(F.col("obs_id").alias("pid"), (2 * F.floor(F.col("track") / 32) + 0.3).alias("t"), (F.col("lon") * 0.3771 + 0.0131).alias("x"), (22 + F.col("lat") * 0.3113).alias("y"))
    g = grid(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    return rounded(grids.between_times(spots, g, "u", 0.0, 20.0, 0.25).select("pid", "value"), "value")


@query("grid_in_rings", VIEW.rstrip() + f", {GRID_CTE} SELECT obs_id, count(h) AS n, round(avg(h), 6) AS mean, min(h) AS least, max(h) AS most FROM (SELECT obs_id, lon * 0.4 AS x, 22 + lat * 0.3 AS y FROM obs) o JOIN g ON g.t = 0 AND g.lon >= x - 0.51 AND g.lon < x + 0.51 AND g.lat >= y - 0.51 AND g.lat < y + 0.51 GROUP BY 1", view=False)
def grid_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir).select("obs_id", F.lit(0).cast("long").alias("t"), (F.col("lon") * 0.4).alias("lon"), (22 + F.col("lat") * 0.3).alias("lat"))
    return rounded(grids.in_rings(o.withColumn("ring", box_ring(0.51)), grid(spark, sf_dir), "h", 0.0, 20.0, 0.25), "mean")


on_grid("bessel_filter", lambda g: rounded(grids.low_pass(g, "h", 0.25, 120.0, 48).select("t", "i", "j", "low"), "low"), None)
on_grid("lanczos_high_filter", lambda g: rounded(grids.high_pass(g, "h", 0.25, 120.0, 48, kind="lanczos").select("t", "i", "j", "high"), "high"), None)
on_grid("bessel_band_filter", lambda g: rounded(grids.band_pass(g, "h", 0.25, 100.0, 220.0, 48).select("t", "i", "j", "band"), "band"), None)
TAPER = "(0.5 - 0.5 * cos(2 * pi() * i / 48))"
on_grid("spectrum_lon", lambda g: rounded(grids.spectrum(g, "u"), "power"), f", m AS (SELECT t, i, j, (u - avg(u) OVER (PARTITION BY t, j)) * {TAPER} AS x FROM g), p AS (SELECT t, j, k, pow(sum(x * cos(2 * pi() * i * k / 48)), 2) + pow(sum(x * sin(2 * pi() * i * k / 48)), 2) AS e FROM m, range(25) r(k) GROUP BY 1, 2, 3) SELECT k AS wave, round(avg(e) / (SELECT sum(pow({TAPER}, 2)) FROM range(48) q(i)) * CASE WHEN k BETWEEN 1 AND 23 THEN 2 ELSE 1 END, 6) AS power FROM p GROUP BY k")
on_grid("regrid", lambda g: rounded(grids.at_points(g.where("i < 40 and j < 24").select("t", (F.col("lon") + 0.1).alias("x"), (F.col("lat") + 0.05).alias("y")), g, "u", 0.0, 20.0, 0.25), "value"), "SELECT a.t, a.lon + 0.1e0 AS x, a.lat + 0.05e0 AS y, round(0.6 * 0.8 * a.u + 0.6 * 0.2 * b.u + 0.4 * 0.8 * c.u + 0.4 * 0.2 * d.u, 6) AS value FROM g a JOIN g b ON b.t = a.t AND b.i = a.i AND b.j = a.j + 1 JOIN g c ON c.t = a.t AND c.i = a.i + 1 AND c.j = a.j JOIN g d ON d.t = a.t AND d.i = a.i + 1 AND d.j = a.j + 1 WHERE a.i < 40 AND a.j < 24")


IJ = "CAST(a.i AS INTEGER) AS i, CAST(a.j AS INTEGER) AS j"
on_grid("second_difference", lambda g: rounded(grids.second_difference(g, "u", "d", "j", 2).select("t", "i", "j", "d"), "d"), f"SELECT a.t, {IJ}, round(b.u + c.u - 2 * a.u, 6) AS d FROM g a LEFT JOIN g b ON b.t = a.t AND b.i = a.i AND b.j = a.j + 2 LEFT JOIN g c ON c.t = a.t AND c.i = a.i AND c.j = a.j - 2")
MIRROR = "CASE WHEN {0} < 0 THEN -{0} - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - {0} ELSE {0} END"
on_grid("gaussian_filter", lambda g: rounded(grids.gaussian(g, "h", "smooth", 1.0, (48, 32)).select("t", "i", "j", "smooth"), "smooth"), f"SELECT a.t, {IJ}, round(sum(coalesce(b.h, 0) * exp(-(p * p + q * q) / 2.0)) / sum(CASE WHEN b.h IS NOT NULL THEN exp(-(p * p + q * q) / 2.0) END), 6) AS smooth FROM g a, range(-4, 5) x(p), range(-4, 5) y(q), g b WHERE b.t = a.t AND b.i = {MIRROR.format('(a.i + p)', 48)} AND b.j = {MIRROR.format('(a.j + q)', 32)} GROUP BY 1, 2, 3")


def _land(g: DataFrame) -> DataFrame:
    coarse = g.where("t = 0").groupBy(F.floor(F.col("i") / 4).cast("int").alias("i"), F.floor(F.col("j") / 4).cast("int").alias("j")).agg(F.sum("n").alias("n"))
    land = coarse.select("i", "j", ((F.col("i") + F.col("j") + F.col("n")) % 3 == 0).cast("int").alias("mask"))
    return grids.without_land(g, land, "u", 0.05, 20.05, 1.0).select("t", "i", "j", "u")


on_grid("land_mask", _land, f", land AS (SELECT i // 4 AS x, j // 4 AS y, sum(n) AS k FROM g WHERE t = 0 GROUP BY 1, 2) SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN (x + y + k) % 3 = 0 THEN NULL ELSE u END AS u FROM (SELECT *, CAST(round(lon - 0.05) AS INTEGER) AS x, CAST(round(lat - 20.05) AS INTEGER) AS y FROM g) LEFT JOIN land USING (x, y)")


@query("equatorial_currents", GRID.replace("20 + j", "-4 + j") + f", s AS (SELECT g.*, (lead(h) OVER x - lag(h) OVER x) / 2 AS hx FROM (SELECT * REPLACE (((i * 7 + j * 3 + t * 11 + n * 13) % 50) * 0.01e0 AS h) FROM g) g WINDOW x AS (PARTITION BY t, j ORDER BY i)), d AS (SELECT *, (lead(h) OVER y - lag(h) OVER y) / 2 AS hy, lead(h, 2) OVER y + lag(h, 2) OVER y - 2 * h AS hyy, (lead(hx) OVER y - lag(hx) OVER y) / 2 AS hxy FROM s WINDOW y AS (PARTITION BY t, i ORDER BY j)), k AS (SELECT *, 4 * pi() / 86164.1 * sin(radians(lat)) AS f, 4 * pi() / 86164.1 * cos(radians(lat)) / 6370997.0 AS beta, CASE WHEN abs(lat) <= 5 THEN exp(-pow(lat / 2.2, 2)) ELSE 0 END AS w FROM d WHERE i BETWEEN 3 AND 44 AND j BETWEEN 3 AND 28) SELECT t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN lat = 0 THEN un ELSE uo * (1 - w) + un * w END, 4) + 0.0e0 AS u, round(CASE WHEN lat = 0 THEN vn ELSE vo * (1 - w) + vn * w END, 4) + 0.0e0 AS v FROM (SELECT *, -9.807 / beta * hyy / pow({METRE * 0.25} * 2, 2) AS un, 9.807 / beta * hxy / (pow({METRE * 0.25}, 2) * cos(radians(lat))) AS vn, CASE WHEN lat <> 0 THEN -9.807 / f * hy / {METRE * 0.25} END AS uo, CASE WHEN lat <> 0 THEN 9.807 / f * hx / ({METRE * 0.25} * cos(radians(lat))) END AS vo FROM k)", view=False)
def equatorial_currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumns({"lat": F.col("lat") - 24, "h": (F.col("i") * 7 + F.col("j") * 3 + F.col("t") * 11 + F.col("n") * 13) % 50 * 0.01}).drop("u", "v")
    out = grids.with_equatorial_currents(g, "h", 0.25, 2, 1).where("i between 3 and 44 and j between 3 and 28")
    return rounded(out.select("t", "i", "j", "u", "v"), "u", "v", digits=4).withColumns({c: F.col(c) + 0.0 for c in "uv"})  # no negative zero


@query("ring_flags", VIEW.rstrip() + f", {GRID_CTE} SELECT obs_id, bool_or(h IS NULL) AS masked, coalesce(bool_or(h > 0.45), false) AS beyond FROM (SELECT obs_id, lon * 0.4 AS x, 22 + lat * 0.3 AS y FROM obs) o JOIN g ON g.t = 0 AND g.lon >= x - 0.51 AND g.lon < x + 0.51 AND g.lat >= y - 0.51 AND g.lat < y + 0.51 GROUP BY 1", view=False)
def ring_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir).select("obs_id", F.lit(0).cast("long").alias("t"), (F.col("lon") * 0.4).alias("lon"), (22 + F.col("lat") * 0.3).alias("lat"))
    return grids.flags_in_rings(o.withColumn("ring", box_ring(0.51)), grid(spark, sf_dir), "h", 0.0, 20.0, 0.25, 0.45)
