"""Queries on pairs of observations: boxes, centres, overlaps, links, assignment, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.operators import closest, networks, pairs
from gyrelake.plans.observation import KEYS, box_ring, rounded, simple
from gyrelake.plans.registry import METRES

IDS = ("a_obs_id", "b_obs_id")
SAME_DAY = "FROM obs a JOIN obs b ON a.time = b.time AND a.obs_id < b.obs_id"
META = "abs(a.lon - b.lon) <= {0} AND abs(a.lat - b.lat) <= {0}"


def _day_pairs(o: DataFrame, delta: float, *more: str) -> DataFrame:
    at = o.select("obs_id", "time", "lon", "lat", *more)
    return pairs.near_centres(at, at, delta, ["time"]).where("a_obs_id < b_obs_id")


def _box_groups(o: DataFrame, half: float) -> DataFrame:
    b = pairs.with_box(o, half).select("obs_id", "time", *pairs.BOX)
    return pairs.group_pairs(b, b, 1.0, ["time"])


def _boxes(o: DataFrame, half: float = 0.5) -> DataFrame:
    return pairs.expanded(_box_groups(o, half)).where("a_obs_id < b_obs_id")


def _box_scores(o: DataFrame, kind: str = "union") -> DataFrame:
    scored = _box_groups(o, 0.5).withColumn("score", F.round(pairs.box_score(kind), 6))
    return pairs.expanded(scored).where("a_obs_id < b_obs_id").select(*IDS, "score")


simple("close_center_join", lambda o: _day_pairs(o, 0.5).select(*IDS), f"SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id {SAME_DAY} WHERE {META.format(0.5)}")
simple("bbox_join", lambda o: _boxes(o).select(*IDS), f"SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id {SAME_DAY} WHERE {META.format(1.0)}")


def _seam(o: DataFrame) -> DataFrame:
    east = o.withColumn("lon", F.pmod(F.col("lon") - 14.0, F.lit(360.0)))
    return _day_pairs(east, 0.5).select(*IDS)


simple("close_center_across_seam", _seam, f"SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id {SAME_DAY} WHERE {META.format(0.5)}")
SHARED = "greatest(least(a.lon, b.lon) + 1 - greatest(a.lon, b.lon), 0.0) * greatest(least(a.lat, b.lat) + 1 - greatest(a.lat, b.lat), 0.0)"
for _kind, _under in (("union", "(2.0 - s)"), ("smaller", "1.0"), ("first", "1.0")):
    simple(f"box_score_{_kind}", lambda o, k=_kind: _box_scores(o, k), f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {SHARED} AS s {SAME_DAY} WHERE {META.format(1.0)}) SELECT a_obs_id, b_obs_id, round(s / {_under}, 6) AS score FROM p")


def _ellipse_pairs(o: DataFrame) -> DataFrame:
    at = o.select("obs_id", "time", "lon", "lat")
    groups = pairs.near_groups(at, at.withColumn("time", F.col("time") - 1), 1.5, ["time"])
    return pairs.expanded(groups.where(pairs.in_search_ellipse(0.5, 1.5))).select(*IDS)


def _followed(o: DataFrame, delta: float) -> DataFrame:
    """a: rows with a row of a larger id near; that is told by the largest id at each place around."""
    place = ["time", "lon", "lat"]
    top = o.groupBy(*place).agg(F.max("obs_id").alias("top"))
    near = pairs.near_centres(top, top, delta, ["time"]).groupBy(*[F.col(f"a_{c}").alias(c) for c in place[1:]], F.col("a_time").alias("time")).agg(F.max("b_top").alias("most"))
    return o.select("obs_id", *place).join(near.hint("merge"), place).where("obs_id < most").select(F.col("obs_id").alias("a"))


def _never_candidates(o: DataFrame) -> DataFrame:
    """Rows that are in no pair of candidates, which depends on their places alone."""
    members = networks.places(o)
    reps = o.join(members.where("rep = obs_id").select("obs_id").hint("merge"), "obs_id", "left_semi")
    used = pairs.step_candidates(reps).select(F.explode(F.array("a", "b")).alias("rep"))
    return members.join(used.hint("merge"), "rep", "left_anti").select("obs_id")


D = METRES.format(a="a.", b="b.")
CAND = f"c AS (SELECT a.time AS step, a.obs_id AS a, b.obs_id AS b, sqrt(pow((a.amplitude - b.amplitude) / a.amplitude, 2) + pow((a.radius_s - b.radius_s) / a.radius_s, 2) + pow(({D}) / 125000.0, 2)) AS cost, {D} AS d FROM obs a JOIN obs b ON b.time = a.time + 1 AND abs(a.lon - b.lon) <= 1 AND abs(a.lat - b.lat) <= 1)"
simple("step_link_candidates", lambda o: rounded(pairs.step_candidates(o), "cost"), f"{CAND} SELECT step, a, b, round(cost, 6) AS cost FROM c WHERE d < 125000")
simple("topk_candidates", lambda o: closest.cheapest_steps(o, 2).select("a", "rank", "b"), f"{CAND} SELECT a, CAST(rank AS INTEGER) AS rank, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS rank FROM c WHERE d < 125000) WHERE rank <= 2")
simple("search_ellipse", lambda o: _ellipse_pairs(o), "SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id FROM obs a JOIN obs b ON b.time = a.time + 1 AND pow((b.lon - a.lon + 0.5) / 1.0, 2) + pow((b.lat - a.lat) / 0.5, 2) < 1")
simple("ratio_filter", lambda o: _day_pairs(o, 0.5, "radius_s").where(pairs.ratios_within(["radius_s"], 0.8, 1.25)).select(*IDS), f"SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id {SAME_DAY} WHERE {META.format(0.5)} AND b.radius_s / a.radius_s BETWEEN 0.8 AND 1.25")
simple("best_target", lambda o: pairs.nearest_targets(o, 0.5).select("a", "b"), f"SELECT a, b FROM (SELECT a.obs_id AS a, b.obs_id AS b, row_number() OVER (PARTITION BY a.obs_id ORDER BY abs(a.lon - b.lon), b.amplitude DESC, b.obs_id) AS r {SAME_DAY} WHERE {META.format(0.5)}) WHERE r = 1")
simple("close_tracks_semi", lambda o: pairs.close_tracks(o.where("track < 30"), o.where("track >= 30"), 0.5, 5).select("obs_id"), "n AS (SELECT b.track FROM obs a JOIN obs b ON a.time = b.time AND abs(a.lon - b.lon) <= 0.5 AND abs(a.lat - b.lat) <= 0.5 WHERE a.track < 30 AND b.track >= 30 GROUP BY 1 HAVING count(DISTINCT b.time) >= 5) SELECT obs_id FROM obs WHERE track IN (SELECT track FROM n)")
simple("nomatch_anti", lambda o: pairs.unmatched(o, _followed(o, 0.25)).select(*KEYS.split(", ")), f"SELECT {KEYS} FROM obs WHERE obs_id NOT IN (SELECT a.obs_id {SAME_DAY} WHERE {META.format(0.25)})")
simple("unused_anti", _never_candidates, f"{CAND} SELECT obs_id FROM obs WHERE obs_id NOT IN (SELECT a FROM c WHERE d < 125000 UNION SELECT b FROM c WHERE d < 125000)")


simple("match_groups", lambda o: pairs.kind_counts(o, 0.3), "p AS (SELECT a.obs_id AS a, b.obs_id AS b, greatest(least(a.lon, b.lon) + 0.6 - greatest(a.lon, b.lon), 0) * greatest(least(a.lat, b.lat) + 0.6 - greatest(a.lat, b.lat), 0) AS s FROM obs a JOIN obs b ON a.time = b.time AND a.obs_id < b.obs_id WHERE a.lon - 0.3 <= b.lon + 0.3 AND b.lon - 0.3 <= a.lon + 0.3 AND a.lat - 0.3 <= b.lat + 0.3 AND b.lat - 0.3 <= a.lat + 0.3), q AS (SELECT *, s / (0.72 - s) AS score, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p) SELECT CASE WHEN na > 1 AND nb > 1 THEN 'complex' WHEN na > 1 THEN 'parent' WHEN nb > 1 THEN 'twin' WHEN score < 0.1 THEN 'low' WHEN score < 0.6 THEN 'intermediate' ELSE 'high' END AS kind, count(*) AS n FROM q GROUP BY 1")
simple("identify_in", lambda o: pairs.same_tracks(o.where("track < 50"), o.where("track between 25 and 80").withColumn("track", F.col("track") + 1000)), "SELECT track AS a_track, CASE WHEN track >= 25 THEN track + 1000 END AS b_track FROM (SELECT DISTINCT track FROM obs WHERE track < 50)")


simple("seed_mesh", lambda o: pairs.seeds(o.withColumn("ring", box_ring(0.5)), 0.25).groupBy("obs_id").agg(F.count("*").alias("n")), "SELECT obs_id, CAST((ceil((lon + 0.5) / 0.25) - ceil((lon - 0.5) / 0.25)) * (ceil((lat + 0.5) / 0.25) - ceil((lat - 0.5) / 0.25)) AS BIGINT) AS n FROM obs")
simple("greedy_assign", lambda o: rounded(closest.linked(o), "cost"), None)




def _all_rings(o: DataFrame) -> DataFrame:
    r = o.withColumn("ring", box_ring(0.5)).select("obs_id", "time", "ring")
    groups = rounded(pairs.match(r, r, "union", 0.2, ["time"], grouped=True), "score")
    return pairs.expanded(groups).where("a_obs_id < b_obs_id").select(*IDS, "score")


def _day_before(o: DataFrame, half: float) -> DataFrame:
    return o.withColumns({"ring": box_ring(half), "time": F.col("time") + 1}).select("obs_id", "time", "ring")


def _all_holders(o: DataFrame) -> DataFrame:
    points = o.select(F.col("obs_id").alias("pid"), "time", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return pairs.holder(points, _day_before(o, 0.5), on=["time"]).select("pid", "obs_id")


BEFORE = "r.time = p.time - 1 AND p.lon >= r.lon - {0} AND p.lon < r.lon + {0} AND p.lat >= r.lat - {0} AND p.lat < r.lat + {0}"
simple("match_rings_whole", _all_rings, f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {SHARED} AS s {SAME_DAY} WHERE {META.format(1.0)}) SELECT a_obs_id, b_obs_id, round(s / (2.0 - s), 6) AS score FROM p WHERE s / (2.0 - s) >= 0.2")
simple("match_rings", _all_rings, f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {SHARED} AS s {SAME_DAY} WHERE {META.format(1.0)}) SELECT a_obs_id, b_obs_id, round(s / (2.0 - s), 6) AS score FROM p WHERE s / (2.0 - s) >= 0.2")
simple("align_on_inner_whole", lambda o: pairs.aligned_counts(o.where("track % 2 = 0"), o.where("track % 2 = 1"), "time", 3), "SELECT CAST(floor(a.time / 3) AS BIGINT) AS bin, count(*) AS n FROM obs a JOIN obs b ON floor(a.time / 3) = floor(b.time / 3) WHERE a.track % 2 = 0 AND b.track % 2 = 1 GROUP BY 1")
simple("align_on_inner", lambda o: pairs.aligned_counts(o.where("track % 2 = 0"), o.where("track % 2 = 1"), "time", 3), "SELECT CAST(floor(a.time / 3) AS BIGINT) AS bin, count(*) AS n FROM obs a JOIN obs b ON floor(a.time / 3) = floor(b.time / 3) WHERE a.track % 2 = 0 AND b.track % 2 = 1 GROUP BY 1")
simple("align_on_left_whole", lambda o: pairs.aligned_counts(o.where("track % 2 = 0"), o.where("track % 2 = 1"), "time", 3, True), "SELECT CAST(floor(a.time / 3) AS BIGINT) AS bin, count(b.obs_id) AS n FROM obs a LEFT JOIN (SELECT * FROM obs WHERE track % 2 = 1) b ON floor(a.time / 3) = floor(b.time / 3) WHERE a.track % 2 = 0 GROUP BY 1")
simple("align_on_left", lambda o: pairs.aligned_counts(o.where("track % 2 = 0"), o.where("track % 2 = 1"), "time", 3, True), "SELECT CAST(floor(a.time / 3) AS BIGINT) AS bin, count(b.obs_id) AS n FROM obs a LEFT JOIN (SELECT * FROM obs WHERE track % 2 = 1) b ON floor(a.time / 3) = floor(b.time / 3) WHERE a.track % 2 = 0 GROUP BY 1")
simple("contains_whole", _all_holders, f"SELECT p.obs_id AS pid, min(r.obs_id) AS obs_id FROM obs p LEFT JOIN obs r ON {BEFORE.format('0.5')} GROUP BY 1")
simple("contains", _all_holders, f"SELECT p.obs_id AS pid, min(r.obs_id) AS obs_id FROM obs p LEFT JOIN obs r ON {BEFORE.format('0.5')} GROUP BY 1")
simple("mask_from_polygons_whole", lambda o: pairs.inside_any(o, _day_before(o, 2.0), ["time"]).select("obs_id"), f"SELECT DISTINCT p.obs_id FROM obs p JOIN obs r ON {BEFORE.format('2')}")
simple("mask_from_polygons", lambda o: pairs.inside_any(o, _day_before(o, 2.0), ["time"]).select("obs_id"), f"SELECT DISTINCT p.obs_id FROM obs p JOIN obs r ON {BEFORE.format('2')}")
simple("track_outline_whole", lambda o: pairs.merged_outline(o.withColumn("ring", box_ring(0.5)), 0.5).groupBy("track").agg(F.count("*").alias("cells")), "c AS (SELECT DISTINCT track, i, j FROM obs, range(-100, 200) a(i), range(-100, 100) b(j) WHERE (i + 0.5) * 0.5 >= lon - 0.5 AND (i + 0.5) * 0.5 < lon + 0.5 AND (j + 0.5) * 0.5 >= lat - 0.5 AND (j + 0.5) * 0.5 < lat + 0.5) SELECT track, count(*) AS cells FROM c GROUP BY 1")
simple("track_outline", lambda o: pairs.merged_outline(o.withColumn("ring", box_ring(0.5)), 0.5).groupBy("track").agg(F.count("*").alias("cells")), "c AS (SELECT DISTINCT track, i, j FROM obs, range(-100, 200) a(i), range(-100, 100) b(j) WHERE (i + 0.5) * 0.5 >= lon - 0.5 AND (i + 0.5) * 0.5 < lon + 0.5 AND (j + 0.5) * 0.5 >= lat - 0.5 AND (j + 0.5) * 0.5 < lat + 0.5) SELECT track, count(*) AS cells FROM c GROUP BY 1")


def _seam_wide(o: DataFrame) -> DataFrame:
    east = o.withColumn("lon", F.pmod(F.col("lon") - 14.0, F.lit(360.0)))
    return _day_pairs(east, 1.1).select(*IDS)


simple("close_center_across_seam_11", _seam_wide, f"SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id {SAME_DAY} WHERE {META.format(1.1)}")


def _next_rings(o: DataFrame) -> DataFrame:
    r = o.withColumn("ring", box_ring(0.5))
    return pairs.area_candidates(r, least=0.2, digits=6)


simple("area_link_candidates", _next_rings, f"p AS (SELECT a.time AS step, a.obs_id AS a, b.obs_id AS b, {SHARED} AS s FROM obs a JOIN obs b ON b.time = a.time + 1 WHERE {META.format(1.0)}) SELECT step, a, b, round(1 - s / (2.0 - s), 6) AS cost FROM p WHERE s > 0 AND s / (2.0 - s) >= 0.2")


def _common_area(o: DataFrame) -> DataFrame:
    r = o.withColumn("ring", box_ring(0.5)).select("obs_id", "time", "ring")
    later = r.withColumn("time", F.col("time") - 1)
    groups = rounded(pairs.common_area_cost(pairs.match(r, later, "smaller", on=["time"], grouped=True)), "cost")
    return pairs.expanded(groups).select(*IDS, "cost")


simple("common_area_cost", _common_area, f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {SHARED} AS s FROM obs a JOIN obs b ON b.time = a.time + 1 WHERE {META.format(1.0)}) SELECT a_obs_id, b_obs_id, round(1 - s, 6) AS cost FROM p WHERE s > 0")


def _over_water(o: DataFrame) -> DataFrame:
    land = o.sparkSession.range(200).select((F.col("id") % 20 * 5).cast("int").alias("i"), (F.floor(F.col("id") / 20) * 8).cast("int").alias("j"), F.lit(1).alias("mask"))
    at = o.select("obs_id", "time", "lon", "lat")
    near = pairs.near_groups(at, at.withColumn("time", F.col("time") - 1), 0.75, ["time"])
    return pairs.expanded(pairs.crossing_land(near, land, 0.0, -8.0, 0.25)).select(*IDS)


CELLS = "CAST(round((a.lon) / 0.25) AS INTEGER) AS i0, CAST(round((a.lat + 8) / 0.25) AS INTEGER) AS j0, CAST(round((b.lon) / 0.25) AS INTEGER) AS i1, CAST(round((b.lat + 8) / 0.25) AS INTEGER) AS j1"
simple("over_water_pairs", _over_water, f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {CELLS} FROM obs a JOIN obs b ON b.time = a.time + 1 AND {META.format(0.75)}), w AS (SELECT *, greatest(abs(i1 - i0), abs(j1 - j0)) AS n FROM p), k AS (SELECT w.*, unnest(range(n + 1)) AS s FROM w), c AS (SELECT a_obs_id, b_obs_id, CASE WHEN n = 0 THEN i0 ELSE CAST(trunc(i0 + (i1 - i0) * s / n) AS INTEGER) END AS i, CASE WHEN n = 0 THEN j0 ELSE CAST(trunc(j0 + (j1 - j0) * s / n) AS INTEGER) END AS j FROM k) SELECT a_obs_id, b_obs_id FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.a_obs_id = p.a_obs_id AND c.b_obs_id = p.b_obs_id AND i % 5 = 0 AND i BETWEEN 0 AND 95 AND j % 8 = 0 AND j BETWEEN 0 AND 72)")


def _turned(o: DataFrame) -> DataFrame:
    """The view 14 degrees further west, so that the seam at 0 runs through its middle."""
    return o.withColumn("lon", F.pmod(F.col("lon") - 14.0, F.lit(360.0)))


def _seam_scores(o: DataFrame) -> DataFrame:
    return _box_scores(_turned(o))


simple("box_score_across_seam", _seam_scores, f"p AS (SELECT a.obs_id AS a_obs_id, b.obs_id AS b_obs_id, {SHARED} AS s {SAME_DAY} WHERE {META.format(1.0)}) SELECT a_obs_id, b_obs_id, round(s / (2.0 - s), 6) AS score FROM p")
simple("contains_across_seam", lambda o: _all_holders(_turned(o)), f"SELECT p.obs_id AS pid, min(r.obs_id) AS obs_id FROM obs p LEFT JOIN obs r ON {BEFORE.format('0.5')} GROUP BY 1")
simple("mask_from_polygons_across_seam", lambda o: pairs.inside_any(_turned(o), _day_before(_turned(o), 2.0), ["time"]).select("obs_id"), f"SELECT DISTINCT p.obs_id FROM obs p JOIN obs r ON {BEFORE.format('2')}")


def _side_by_side(o: DataFrame) -> DataFrame:
    return pairs.aligned_rows(o.where("track % 2 = 0"), o.where("track % 2 = 1 and time % 9 < 3"), "time", 3).select("bin", "side", "obs_id")


simple("aligned_rows", _side_by_side, "x AS (SELECT *, CAST(floor(time / 3) AS BIGINT) AS bin FROM obs), p AS (SELECT * FROM x WHERE track % 2 = 0), q AS (SELECT * FROM x WHERE track % 2 = 1 AND time % 9 < 3) SELECT bin, 'a' AS side, obs_id FROM p WHERE bin IN (SELECT bin FROM q) UNION ALL SELECT bin, 'b', obs_id FROM q WHERE bin IN (SELECT bin FROM p)")
