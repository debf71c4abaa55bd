"""Queries on single observations and tracks: scans, projections, filters, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrelake.functions import geo
from gyrelake.operators import cells, tracks
from gyrelake.plans.registry import METRES, query
from gyrelake.sources import observations as src

KEYS = "obs_id, track, time, nb, amplitude, n, lon, lat, radius_s"


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.day_observations(spark, sf_dir)


def simple(name: str, f, sql: str | None) -> None:
    query(name, sql)(lambda spark, sf_dir: f(view(spark, sf_dir)))


def ring_of(*points) -> Column:
    """A ring of (x, y) from numbers or columns."""
    column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.struct(column(x).alias("x"), column(y).alias("y")) for x, y in points])


def box_ring(half: float) -> Column:
    """A square ring around the centre."""
    x, y = F.col("lon"), F.col("lat")
    return ring_of((x - half, y - half), (x - half, y + half), (x + half, y + half), (x + half, y - half), (x - half, y - half))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


NEXT = METRES.format(a="", b="x_").replace("x_lat", "lead(lat) OVER w").replace("x_lon", "lead(lon) OVER w")

query("scan_events", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' AND value > 10", view=False)(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click' and value > 10").select("event_id", "user_id", "event_type", "value")
)
simple("obs_view", lambda o: o, f"SELECT {KEYS} FROM obs")
simple("alias_rename", lambda o: src.with_field_names(o.select("obs_id", F.col("lon").alias("longitude"), F.col("lat").alias("Lat"), F.col("amplitude").alias("A"), F.col("radius_s").alias("L"))), "SELECT obs_id, lon, lat, amplitude, radius_s FROM obs")
simple("field_projection", lambda o: o.drop("nb", "n").withColumn("type_cyc", F.lit(-1)), "SELECT obs_id, track, time, amplitude, lon, lat, radius_s, -1 AS type_cyc FROM obs")
simple("sign_name", lambda o: o.select("obs_id", src.sign_name(F.when(F.col("track") % 2 == 0, 1).otherwise(-1)).alias("sign")), "SELECT obs_id, CASE WHEN track % 2 = 0 THEN 'Anticyclonic' ELSE 'Cyclonic' END AS sign FROM obs")
simple("time_to_date", lambda o: o.select("obs_id", F.date_format(src.to_date(F.col("time")), "yyyy-MM-dd").alias("day")), "SELECT obs_id, strftime(DATE '1950-01-01' + CAST(time AS INTEGER), '%Y-%m-%d') AS day FROM obs")
simple("pack_unpack", lambda o: rounded(src.unpacked(src.packed(o.select("obs_id", "amplitude", "radius_s"))).withColumns({c: F.col(c).cast("double") for c in ("amplitude", "radius_s")}), "amplitude", "radius_s", digits=3), "SELECT obs_id, round(CAST(CAST(round(amplitude / 0.0001) * 0.0001 AS FLOAT) AS DOUBLE), 3) AS amplitude, round(CAST(CAST(round(radius_s / 50.0) * 50.0 AS FLOAT) AS DOUBLE), 3) AS radius_s FROM obs")
simple("area_box", lambda o: tracks.in_box(o, 5, 15, -4, 4), f"SELECT {KEYS} FROM obs WHERE lon > 5 AND lon < 15 AND lat > -4 AND lat < 4")
simple("period_abs", lambda o: tracks.in_period(o, 27035, 27045), f"SELECT {KEYS} FROM obs WHERE time BETWEEN 27035 AND 27045")
simple("period_rel", lambda o: tracks.in_period(o, -5, -5), f"SELECT {KEYS} FROM obs WHERE time BETWEEN (SELECT min(time) + 5 FROM obs) AND (SELECT max(time) - 5 FROM obs)")
simple("time_subsample", lambda o: tracks.each_step(o, 27028, 3), f"SELECT {KEYS} FROM obs WHERE (time - 27028) % 3 = 0")
simple("ids_subset", lambda o: tracks.with_ids(o, o.select("track").where("track % 7 = 0").distinct()), f"SELECT {KEYS} FROM obs WHERE track % 7 = 0")
simple("ids_complement", lambda o: tracks.with_ids(o, o.select("track").where("track % 7 = 0").distinct(), others=True), f"SELECT {KEYS} FROM obs WHERE track % 7 <> 0")
simple("track_length", lambda o: tracks.by_length(o, 20, 28), f"SELECT {KEYS} FROM obs WHERE track IN (SELECT track FROM obs GROUP BY 1 HAVING count(*) BETWEEN 20 AND 28)")
simple("full_path", lambda o: tracks.masked(o, F.col("nb") > 5, whole=True), f"SELECT {KEYS} FROM obs WHERE track IN (SELECT track FROM obs WHERE nb > 5)")
simple("remove_incomplete", lambda o: tracks.masked(o, F.col("lat") < 4, drop_partial=True), f"SELECT {KEYS} FROM obs WHERE track NOT IN (SELECT track FROM obs WHERE NOT lat < 4)")
simple("compress_ids", lambda o: tracks.masked(o, F.col("track") % 3 == 0, dense=True).select("obs_id", "track"), "SELECT obs_id, dense_rank() OVER (ORDER BY track) AS track FROM obs WHERE track % 3 = 0")
simple("direction_east", lambda o: tracks.toward(o, west=False, least=3.0), f"SELECT {KEYS} FROM obs WHERE track IN (SELECT track FROM obs GROUP BY 1 HAVING arg_max(lon, time) - arg_min(lon, time) > 3)")
simple("direction_west", lambda o: tracks.toward(o.withColumn("lon", F.when(F.col("track") % 3 == 0, -F.col("lon")).otherwise(F.col("lon"))), west=True).select("obs_id"), "m AS (SELECT obs_id, track, time, CASE WHEN track % 3 = 0 THEN -lon ELSE lon END AS lon FROM obs) SELECT obs_id FROM m WHERE track IN (SELECT track FROM m GROUP BY 1 HAVING arg_min(lon, time) - arg_max(lon, time) > 0)")
simple("first_in_box", lambda o: tracks.first_in_cells(o, 1.0), f"SELECT {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY track, floor(lon), floor(lat) ORDER BY time) AS r FROM obs) WHERE r = 1")
simple("first_last", tracks.first_and_last, f"SELECT {KEYS} FROM (SELECT *, lead(n) OVER (PARTITION BY track ORDER BY time) AS z FROM obs) WHERE n = 0 OR z IS NULL")
simple("keep_tracks_by_date", lambda o: tracks.present_on(o, 27030, 10), f"SELECT {KEYS} FROM obs WHERE track IN (SELECT track FROM obs WHERE time = 27030) AND track IN (SELECT track FROM obs WHERE time = 27040)")
simple("merged_filters", lambda o: tracks.combined(o, F.col("nb") > 1, None, lambda df: F.col("lat") > 0), f"SELECT {KEYS} FROM obs WHERE nb > 1 AND lat > 0")
simple("hist_count", lambda o: cells.histogram(o, "lat", -8, 2, 8), "bins AS (SELECT unnest(range(8)) AS bin) SELECT bin, bin * 2 - 8e0 AS low, CAST((SELECT count(*) FROM obs WHERE lat >= bin * 2 - 8 AND (lat < bin * 2 - 6 OR bin = 7 AND lat = 8)) AS DOUBLE) AS value FROM bins")
simple("hist_percent", lambda o: rounded(cells.histogram(o, "lat", -8, 2, 8, how="percent"), "value"), "inside AS (SELECT * FROM obs WHERE lat >= -8 AND lat <= 8), bins AS (SELECT unnest(range(8)) AS bin) SELECT bin, bin * 2 - 8e0 AS low, round((SELECT count(*) FROM inside WHERE lat >= bin * 2 - 8 AND (lat < bin * 2 - 6 OR bin = 7)) * 100.0 / (SELECT count(*) FROM inside), 6) AS value FROM bins")
simple("hist_mean", lambda o: rounded(cells.histogram(o, "lat", -8, 2, 8, "amplitude", "mean"), "value"), "bins AS (SELECT unnest(range(8)) AS bin) SELECT bin, bin * 2 - 8e0 AS low, round(coalesce((SELECT avg(amplitude) FROM obs WHERE lat >= bin * 2 - 8 AND (lat < bin * 2 - 6 OR bin = 7 AND lat = 8)), 0.0), 6) AS value FROM bins")
simple("bins_std", lambda o: rounded(cells.histogram(o, "lon", 0, 4, 7, "radius_s", "std"), "value", digits=4), "bins AS (SELECT unnest(range(7)) AS bin) SELECT bin, bin * 4e0 AS low, round(coalesce((SELECT stddev_pop(radius_s) FROM obs WHERE lon >= bin * 4 AND (lon < bin * 4 + 4 OR bin = 6 AND lon = 28)), 0.0), 4) AS value FROM bins")
simple("reverse_cumulative", lambda o: cells.cumulative_share(o, "lat", -8, 2, 8).select("bin", "above"), "bins AS (SELECT unnest(range(8)) AS bin) SELECT bin, CAST((SELECT count(*) FROM obs WHERE lat >= bin * 2 - 8 AND lat <= 8) AS DOUBLE) AS above FROM bins")
simple("grid_center_count", lambda o: cells.cell_count(o, 2), "SELECT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j, count(*) AS n FROM obs GROUP BY 1, 2")
simple("grid_mean", lambda o: rounded(cells.cell_mean(o, 2, "amplitude"), "mean"), "SELECT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j, round(avg(amplitude), 6) AS mean FROM obs GROUP BY 1, 2")
simple("grid_percentile", lambda o: rounded(cells.cell_percentile(o, 2, "amplitude", 25), "percentile"), "SELECT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j, round(quantile_cont(amplitude, 0.25), 6) AS percentile FROM obs GROUP BY 1, 2")
simple("grid_share", lambda o: rounded(cells.cell_share(o, 2, F.col("nb") > 3), "share"), "SELECT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j, count(*) AS n, round(avg(CASE WHEN nb > 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM obs GROUP BY 1, 2")
simple("period_span", lambda o: o.agg(F.min("time").alias("t0"), F.max("time").alias("t1"), (F.max("time") - F.min("time") + 1).alias("days"), F.count_distinct("track").alias("tracks"), F.count("*").alias("rows")), "SELECT min(time) AS t0, max(time) AS t1, max(time) - min(time) + 1 AS days, count(DISTINCT track) AS tracks, count(*) AS rows FROM obs")
simple("track_index", lambda o: o.groupBy("track").agg(F.min("obs_id").alias("first"), F.count("*").alias("n")), "SELECT track, min(obs_id) AS first, count(*) AS n FROM obs GROUP BY 1")
simple("count_by_track", lambda o: o.groupBy("track").agg(F.count_if(F.col("nb") > 2).alias("n")), "SELECT track, count(*) FILTER (nb > 2) AS n FROM obs GROUP BY 1")
simple("track_summary", lambda o: rounded(rounded(tracks.summary(o), "path", digits=3), *[f"{n}_{c}" for c in ("amplitude", "radius_s") for n in ("min", "max", "mean", "std")], digits=5), f"d AS (SELECT *, coalesce({NEXT}, 0.0) AS d FROM obs WINDOW w AS (PARTITION BY track ORDER BY time)) SELECT track, count(*) AS n_obs, max(time) - min(time) + 1 AS span, round(sum(d), 3) AS path, round(min(amplitude), 5) AS min_amplitude, round(max(amplitude), 5) AS max_amplitude, round(avg(amplitude), 5) AS mean_amplitude, round(stddev_pop(amplitude), 5) AS std_amplitude, round(min(radius_s), 5) AS min_radius_s, round(max(radius_s), 5) AS max_radius_s, round(avg(radius_s), 5) AS mean_radius_s, round(stddev_pop(radius_s), 5) AS std_radius_s FROM d GROUP BY 1")
simple("distance_next", lambda o: rounded(tracks.with_distance(o), "distance_next", digits=4).select("obs_id", "distance_next"), f"SELECT obs_id, round(coalesce({NEXT}, 0.0), 4) AS distance_next FROM obs WINDOW w AS (PARTITION BY track ORDER BY time)")
simple("cumsum_track", lambda o: tracks.running_sum(o, "nb", "total").select("obs_id", "total"), "SELECT obs_id, CAST(sum(nb) OVER (PARTITION BY track ORDER BY time) AS BIGINT) AS total FROM obs")
simple("consecutive_run", lambda o: tracks.run_length(o, F.col("nb") >= 2, "run").select("obs_id", "run"), "h AS (SELECT *, CAST(nb >= 2 AS INTEGER) AS hit, sum(1 - CAST(nb >= 2 AS INTEGER)) OVER (PARTITION BY track ORDER BY time) AS isle FROM obs) SELECT obs_id, CAST(sum(hit) OVER (PARTITION BY track, isle ORDER BY time) AS BIGINT) AS run FROM h")
simple("lifetime_age", lambda o: rounded(tracks.with_lifetime(o), "age").select("obs_id", "lifetime", "age"), "SELECT obs_id, count(*) OVER w AS lifetime, round(CASE WHEN count(*) OVER w > 1 THEN n * 100.0 / (count(*) OVER w - 1) END, 6) AS age FROM obs WINDOW w AS (PARTITION BY track)")
simple("loess", lambda o: rounded(tracks.loess(o, 5, "time", "lat", "smooth"), "smooth").select("obs_id", "smooth"), "SELECT a.obs_id, round(sum(pow(1 - pow(abs(b.time - a.time) / 5.0, 3), 3) * b.lat) / sum(pow(1 - pow(abs(b.time - a.time) / 5.0, 3), 3)), 6) AS smooth FROM obs a JOIN obs b ON a.track = b.track AND abs(a.time - b.time) < 5 GROUP BY 1")
simple("median_filter", lambda o: rounded(tracks.median(o, 2, "time", "lat", "middle"), "middle").select("obs_id", "middle"), "SELECT obs_id, round(median(lat) OVER (PARTITION BY track ORDER BY time RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS middle FROM obs")
simple("gap_fill", lambda o: tracks.with_gaps_filled(o).where("virtual = 1").select("track", "time"), "g AS (SELECT *, lead(time) OVER (PARTITION BY track ORDER BY time) AS nxt FROM obs), s AS (SELECT track, median(nxt - time) AS step FROM g GROUP BY 1), u AS (SELECT g.track, g.time, s.step, unnest(generate_series(1, CAST(floor((g.nxt - g.time) / s.step) AS BIGINT) - 1)) AS k FROM g JOIN s USING (track) WHERE g.nxt - g.time >= 2 * s.step) SELECT track, CAST(time + k * step AS INTEGER) AS time FROM u")
simple("fill_linear", lambda o: rounded(tracks.interpolated(tracks.with_gaps_filled(o), ["lat"]).where("virtual = 1").select("track", "time", "lat"), "lat"), "g AS (SELECT *, lead(time) OVER w AS nxt, lead(lat) OVER w AS nlat FROM obs WINDOW w AS (PARTITION BY track ORDER BY time)), s AS (SELECT track, median(nxt - time) AS step FROM g GROUP BY 1), u AS (SELECT g.track, g.time, g.lat, g.nlat, s.step, floor((g.nxt - g.time) / s.step) AS m, unnest(generate_series(1, CAST(floor((g.nxt - g.time) / s.step) AS BIGINT) - 1)) AS k FROM g JOIN s USING (track) WHERE g.nxt - g.time >= 2 * s.step) SELECT track, CAST(time + k * step AS INTEGER) AS time, round(lat + (nlat - lat) * k / m, 6) AS lat FROM u")
simple("azimuth", lambda o: rounded(tracks.azimuth(o), "azimuth"), "e AS (SELECT track, radians(arg_min(lat, time)) AS a, radians(arg_max(lat, time)) AS b, radians(arg_max(lon, time) - arg_min(lon, time)) AS d FROM obs GROUP BY 1) SELECT track, round(degrees(atan2(cos(a) * sin(b) - sin(a) * cos(b) * cos(d), cos(b) * sin(d))) + 90, 6) AS azimuth FROM e")
simple("unwrap_lon", lambda o: tracks.unwrapped(o.withColumn("lon", F.pmod(F.col("lon") * 40, F.lit(360.0)))).select("obs_id", "lon"), "m AS (SELECT obs_id, track, time, lon * 40 - 360 * floor(lon * 40 / 360) AS x FROM obs), f AS (SELECT *, first_value(x) OVER (PARTITION BY track ORDER BY time, obs_id) - 180 AS w FROM m) SELECT obs_id, x - w - 360 * floor((x - w) / 360) + w AS lon FROM f")
simple("moving_window", lambda o: tracks.window_groups(o, o.sparkSession.range(27030, 27058, 7).withColumnRenamed("id", "centre"), 3).groupBy("centre").agg(F.count("*").alias("n")), "c AS (SELECT unnest(range(27030, 27058, 7)) AS centre) SELECT centre, count(*) AS n FROM c JOIN obs ON time > centre - 3 AND time <= centre + 3 GROUP BY 1")
simple("normalised_profile", lambda o: rounded(tracks.normalised_profile(o, "nb", 10), "mean"), "l AS (SELECT *, count(*) OVER (PARTITION BY track) AS life, lead(nb) OVER (PARTITION BY track ORDER BY time) AS nxt FROM obs), s AS (SELECT *, unnest(range(11)) AS slot FROM l WHERE life > 1), p AS (SELECT *, slot * (life - 1.0) / 10 AS pos FROM s) SELECT CAST(slot AS INTEGER) AS slot, round(avg(nb + coalesce((nxt - nb) * (pos - n), 0.0)), 6) AS mean, count(*) AS tracks FROM p WHERE pos >= n AND pos < n + 1 GROUP BY 1")
simple("sort_time", lambda o: o.orderBy("time", "lon", "lat").select("time", "lon", "lat", "obs_id"), "SELECT time, lon, lat, obs_id FROM obs ORDER BY time, lon, lat")
simple("union_missing", lambda o: o.where("track % 2 = 0").select("track", "time", "nb").unionByName(o.where("track % 2 = 1").select("track", "time"), allowMissingColumns=True).fillna(0), "SELECT track, time, nb FROM obs WHERE track % 2 = 0 UNION ALL SELECT track, time, 0 FROM obs WHERE track % 2 = 1")


def _concat(o: DataFrame) -> DataFrame:
    a, b = o.where("time < 27040"), o.where("time >= 27040")
    last = a.agg(F.max("track").alias("last"))
    return a.select("track", "time").unionByName(b.crossJoin(F.broadcast(last)).select((F.col("track") + F.col("last") + 1).alias("track"), "time"))  # one row


simple("concat_offset", _concat, "SELECT track, time FROM obs WHERE time < 27040 UNION ALL SELECT track + (SELECT max(track) + 1 FROM obs WHERE time < 27040), time FROM obs WHERE time >= 27040")
simple("set_equality", lambda o: o.exceptAll(o.where("nb > 1")).unionByName(o.where("nb > 1").exceptAll(o)).agg(F.count("*").alias("differing")), "SELECT count(*) AS differing FROM obs WHERE nb <= 1")


def _poly_area(o: DataFrame) -> DataFrame:
    """A ring with a notch around each row, nb times as large."""
    x, y, k = F.col("lon"), F.col("lat"), F.col("nb")
    ring = ring_of((x + 2 * k, y - 10 * k), (x + 2 * k, y - 9 * k), (x + 2.5 * k, y - 9.5 * k), (x + 3 * k, y - 9 * k), (x + 3 * k, y - 10 * k), (x + 2 * k, y - 10 * k))
    return o.select("obs_id", F.round(geo.ring_area(ring), 6).alias("area"), geo.is_convex(ring).alias("convex"))


simple("poly_area", _poly_area, "SELECT obs_id, CAST(0.75 * nb * nb AS DOUBLE) AS area, false AS convex FROM obs")
simple("point_in_polygon", lambda o: o.where(geo.winding(ring_of((2.01, -6.03), (2.01, 6.03), (9.01, 0.03), (16.01, 6.03), (16.01, -6.03), (2.01, -6.03)), F.col("lon"), F.col("lat")) != 0).agg(F.count("*").alias("inside")), "SELECT count(*) AS inside FROM obs WHERE lon > 2.01 AND lon < 16.01 AND lat > -6.03 AND (CASE WHEN lon <= 9.01 THEN lat < 6.03 - (lon - 2.01) * 6.0 / 7 ELSE lat < 0.03 + (lon - 9.01) * 6.0 / 7 END)")


def _circles(o: DataFrame) -> DataFrame:
    ring = o.withColumn("ring", geo.circle(F.col("lon"), F.col("lat"), F.col("radius_s"), 20))
    return ring.select("obs_id", F.size("ring").alias("points"), F.round(geo.haversine(F.col("lon"), F.col("lat"), F.get("ring", 7).x, F.get("ring", 7).y), 3).alias("r"))


simple("ring_circle", _circles, "SELECT obs_id, 20 AS points, round(radius_s, 3) AS r FROM obs")
simple("ring_circle_whole", _circles, "SELECT obs_id, 20 AS points, round(radius_s, 3) AS r FROM obs")


def _local(o: DataFrame) -> DataFrame:
    x, y = geo.to_local(F.col("lon") + 0.5, F.col("lat") + 0.25, F.col("lon"), F.col("lat"))
    lon, lat = geo.from_local(x, y, F.col("lon"), F.col("lat"))
    return o.select("obs_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


simple("local_frame_round_trip", _local, "SELECT obs_id, round(lon + 0.5, 6) AS lon, round(lat + 0.25, 6) AS lat FROM obs")
simple("pixel_path", lambda o: o.where("n = 0").select("obs_id", F.explode(geo.on_segment_path(F.lit(0), F.lit(0), F.col("nb").cast("int") + 3, F.lit(2))).alias("c")).select("obs_id", "c.i", "c.j"), "SELECT obs_id, CAST(k AS INTEGER) AS i, CAST(trunc(2.0 * k / (nb + 3)) AS INTEGER) AS j FROM (SELECT obs_id, nb, unnest(range(nb + 4)) AS k FROM obs WHERE n = 0)")
simple("birth_map", lambda o: cells.cell_count(o.where("n = 0"), 2), "SELECT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j, count(*) AS n FROM obs WHERE n = 0 GROUP BY 1, 2")


def _pixels(o: DataFrame) -> DataFrame:
    return cells.covered_cells(o.withColumn("ring", box_ring(1.0)), 0.5, "ring")


simple("pixel_frequency", _pixels, "c AS (SELECT i, j FROM range(-100, 200) a(i), range(-100, 100) b(j)) SELECT i, j, count(*) AS n FROM obs JOIN c ON (i + 0.5) * 0.5 >= lon - 1 AND (i + 0.5) * 0.5 < lon + 1 AND (j + 0.5) * 0.5 >= lat - 1 AND (j + 0.5) * 0.5 < lat + 1 GROUP BY 1, 2")
simple("pixel_frequency_whole", _pixels, "c AS (SELECT i, j FROM range(-100, 200) a(i), range(-100, 100) b(j)) SELECT i, j, count(*) AS n FROM obs JOIN c ON (i + 0.5) * 0.5 >= lon - 1 AND (i + 0.5) * 0.5 < lon + 1 AND (j + 0.5) * 0.5 >= lat - 1 AND (j + 0.5) * 0.5 < lat + 1 GROUP BY 1, 2")


simple("field_table", src.described_fields, "SELECT 'time' AS field, 'time' AS file_name, 'days' AS unit, count(time) AS n, CAST(min(time) AS DOUBLE) AS least, CAST(max(time) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'amplitude' AS field, 'amplitude' AS file_name, 'm' AS unit, count(amplitude) AS n, CAST(min(amplitude) AS DOUBLE) AS least, CAST(max(amplitude) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'n' AS field, 'observation_number' AS file_name, '' AS unit, count(n) AS n, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'lon' AS field, 'longitude' AS file_name, 'degrees_east' AS unit, count(lon) AS n, CAST(min(lon) AS DOUBLE) AS least, CAST(max(lon) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'lat' AS field, 'latitude' AS file_name, 'degrees_north' AS unit, count(lat) AS n, CAST(min(lat) AS DOUBLE) AS least, CAST(max(lat) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'track' AS field, 'track' AS file_name, '' AS unit, count(track) AS n, CAST(min(track) AS DOUBLE) AS least, CAST(max(track) AS DOUBLE) AS most FROM obs UNION ALL SELECT 'radius_s' AS field, 'speed_radius' AS file_name, 'm' AS unit, count(radius_s) AS n, CAST(min(radius_s) AS DOUBLE) AS least, CAST(max(radius_s) AS DOUBLE) AS most FROM obs")
simple("unit_conversion", lambda o: rounded(src.converted(o.select("obs_id", "radius_s", "amplitude"), {"radius_s": "km", "amplitude": "cm"}), "radius_s", "amplitude", digits=4), "SELECT obs_id, round(radius_s * 0.001e0, 4) AS radius_s, round(amplitude * 100e0, 4) AS amplitude FROM obs")


simple("age_classes", lambda o: rounded(tracks.with_lifetime(o).withColumn("class", F.ntile(4).over(Window.partitionBy("track").orderBy("time"))).groupBy("class").agg(F.avg("radius_s").alias("mean")), "mean"), "SELECT class, round(avg(radius_s), 6) AS mean FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY track ORDER BY time) AS INTEGER) AS class FROM obs) GROUP BY 1")


def _places(o: DataFrame) -> DataFrame:
    """Rows of a track in its own order, as a table with places."""
    return o.select(F.col("n").alias("pos"), "obs_id", "lat")


simple("insert_rows", lambda o: tracks.inserted(_places(o.where("track = 3")), _places(o.where("track = 4")), 2), "s AS (SELECT count(*) AS k FROM obs WHERE track = 4) SELECT CASE WHEN n >= 2 THEN n + k ELSE n END AS pos, obs_id, lat FROM obs, s WHERE track = 3 UNION ALL SELECT n + 2, obs_id, lat FROM obs WHERE track = 4")
simple("first_places", lambda o: tracks.first_places(o.select("nb", F.col("obs_id").alias("pos")), o.select((F.col("nb") + 1).alias("nb")), "nb"), "SELECT nb, (SELECT min(obs_id) FROM obs o WHERE o.nb = i.nb) AS pos FROM (SELECT DISTINCT nb + 1 AS nb FROM obs) i")
simple("astype_common", lambda o: src.as_fields(o, ["time", "lon", "lat", "amplitude", "segment", "next_id"]), "SELECT time, lon, lat, amplitude FROM obs")
simple("light_extract", lambda o: tracks.light(o.withColumn("ring", box_ring(0.5)), F.col("nb") > 2, ["track"]).select("time", F.size("ring").alias("points"), "track"), "SELECT time, 5 AS points, track FROM obs WHERE nb > 2")
simple("dataset_attributes", src.attributes, "SELECT count(*) AS n_obs, strftime(DATE '1950-01-01' + min(time), '%Y-%m-%d') AS start, strftime(DATE '1950-01-01' + max(time), '%Y-%m-%d') AS \"end\", 'P' || (max(time) - min(time) + 1) || 'D' AS duration FROM obs")
simple("atlas_label", lambda o: src.label(o, "{t0} to {t1}: {nb_obs} rows, {nb_tracks} tracks"), "SELECT min(time) || ' to ' || max(time) || ': ' || count(*) || ' rows, ' || count(DISTINCT track) || ' tracks' AS label FROM obs")
simple("version_flags", lambda o: o.select("obs_id", src.is_older(F.when(F.col("track") % 5 != 0, F.concat(F.lit("3."), F.col("nb"), F.lit(".1"))), "3.4").alias("older")), "SELECT obs_id, track % 5 = 0 OR nb < 4 AS older FROM obs")
simple("inner_ring_fields", lambda o: o.select("obs_id", *[F.lit(src.ring_fields(flag)[0]).alias(n) for flag, n in ((True, "inner_x"), (False, "outer_x"))]), "SELECT obs_id, 'contour_lon_s' AS inner_x, 'contour_lon_e' AS outer_x FROM obs")
simple("axis_by_latitude", lambda o: rounded(o.select("obs_id", pairs_axis(F.col("lat")).alias("axis")), "axis"), "SELECT obs_id, round(CASE WHEN abs(lat) < 2 THEN 1.5 WHEN abs(lat) > 6 THEN 1.05 ELSE -0.1125 * (abs(lat) - 6) + 1.05 END, 6) AS axis FROM obs")
simple("convex_rings", lambda o: o.select("obs_id", geo.is_convex(F.when(F.col("track") % 2 == 0, box_ring(0.5)).otherwise(_arrow())).alias("convex")), "SELECT obs_id, track % 2 = 0 AS convex FROM obs")


def _arrow() -> Column:
    """A ring with one vertex turned inward."""
    x, y = F.col("lon"), F.col("lat")
    return ring_of((x - 1, y - 1), (x - 1, y + 1), (x, y), (x + 1, y + 1), (x + 1, y - 1), (x - 1, y - 1))


def pairs_axis(lat: Column) -> Column:
    from gyrelake.operators.pairs import axis_by_latitude

    return axis_by_latitude(lat, 1.05, 1.5, 6.0, 2.0, degrees=True)
