"""Queries on networks: components, segments, events, relatives. The links are the tracks of the view, joined and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.operators import networks, pairs, tracks
from gyrelake.plans.observation import rounded, simple
from gyrelake.plans.registry import ORACLE
from gyrelake.sources.tables import written

NEIGHBOURS = "e AS (SELECT DISTINCT a.track AS x, b.track AS y FROM obs a JOIN obs b ON a.time = b.time AND a.track <> b.track AND abs(a.lon - b.lon) <= 0.6 AND abs(a.lat - b.lat) <= 0.6)"


def _edges(o: DataFrame) -> DataFrame:
    """Links of neighbour tracks: those of a place by its smallest track, which alone is linked with the places around."""
    return place_edges(o).select("a", "b").distinct()


def place_edges(o: DataFrame) -> DataFrame:
    """a, b, time: as connected, day by day, as the pairs of all tracks that are within 0.6 degrees of each other."""
    of = networks.places(o.select("track", "time", "lon", "lat"), "track", "time", "lon", "lat")
    reps = of.where("rep = track")
    near = pairs.near_centres(reps.drop("rep"), reps.drop("rep"), 0.6, ["time"]).where("a_track < b_track")
    own = of.where("rep <> track").select(F.col("rep").alias("a"), F.col("track").alias("b"), "time")
    return near.select(F.col("a_track").alias("a"), F.col("b_track").alias("b"), F.col("a_time").alias("time")).unionByName(own)


# DuckDB wants RECURSIVE at the front of the whole statement
simple("components", lambda o: networks.components(_edges(o)), f"{NEIGHBOURS}, r(node, other) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1")
ORACLE["components"] = ORACLE["components"].replace("WITH", "WITH RECURSIVE", 1)


def linked(o: DataFrame) -> DataFrame:
    """A network for tests: five tracks make one, each in pieces of six rows; a piece's last row goes on in the next
    piece, and every third piece's in the next track's piece that holds the next day."""
    # written, as five joins read it: the view is worked out once; files that compress well must not be broadcast
    net = written(o.select("obs_id", F.col("track").alias("own"), "time", "n", "lat")).withColumns({"track": F.floor(F.col("own") / 5) + 1, "segment": (F.col("own") % 5) * 10 + F.floor(F.col("n") / 6)})
    nxt = net.select((F.col("obs_id") - 1).alias("obs_id"), F.col("obs_id").alias("next_id"))
    prv = net.select((F.col("obs_id") + 1).alias("obs_id"), F.col("obs_id").alias("prev_id"))
    net = net.join(nxt.hint("merge"), "obs_id", "left").join(prv.hint("merge"), "obs_id", "left")
    other = net.select((F.col("own") - 1).alias("own"), (F.col("time") - 1).alias("time"), F.col("obs_id").alias("_other"), F.col("track").alias("_t"))
    cut = (F.col("n") % 18 == 5) & (F.col("own") % 5 < 4)
    net = net.join(other.hint("merge"), ["own", "time"], "left").withColumn("next_id", F.when(cut & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col("next_id")))
    back = (F.col("n") % 18 == 12) & (F.col("own") % 5 > 0)
    before = net.select((F.col("own") + 1).alias("own"), (F.col("time") + 1).alias("time"), F.col("obs_id").alias("_from"))
    net = net.join(before.hint("merge"), ["own", "time"], "left").withColumn("prev_id", F.when(back & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.col("prev_id")))
    return net.select("obs_id", "track", "segment", "time", "next_id", "prev_id", "lat")


NET = """base AS (SELECT obs_id, track AS own, time, n, lat, CAST(floor(track / 5) AS BIGINT) + 1 AS track, (track % 5) * 10 + CAST(floor(n / 6) AS BIGINT) AS segment FROM obs),
net AS (SELECT b.obs_id, b.track, b.segment, b.time, b.lat,
  CASE WHEN b.n % 18 = 5 AND b.own % 5 < 4 AND o.obs_id IS NOT NULL THEN o.obs_id ELSE x.obs_id END AS next_id,
  CASE WHEN b.n % 18 = 12 AND b.own % 5 > 0 AND f.obs_id IS NOT NULL THEN f.obs_id ELSE p.obs_id END AS prev_id
  FROM base b LEFT JOIN base x ON x.obs_id = b.obs_id + 1 LEFT JOIN base p ON p.obs_id = b.obs_id - 1
  LEFT JOIN base o ON o.own = b.own + 1 AND o.time = b.time + 1 LEFT JOIN base f ON f.own = b.own - 1 AND f.time = b.time - 1),
firsts AS (SELECT * FROM net QUALIFY row_number() OVER (PARTITION BY track, segment ORDER BY time) = 1),
lasts AS (SELECT * FROM net QUALIFY row_number() OVER (PARTITION BY track, segment ORDER BY time DESC) = 1),
adj AS (SELECT a.track, a.segment AS s, b.segment AS o FROM net a JOIN net b ON b.obs_id = a.next_id OR b.obs_id = a.prev_id WHERE a.segment <> b.segment
  UNION SELECT a.track, b.segment, a.segment FROM net a JOIN net b ON b.obs_id = a.next_id OR b.obs_id = a.prev_id WHERE a.segment <> b.segment)"""

simple("birth_events", lambda o: networks.births(linked(o)).select("obs_id"), f"{NET} SELECT obs_id FROM firsts WHERE prev_id IS NULL")
simple("death_events", lambda o: networks.deaths(linked(o)).select("obs_id"), f"{NET} SELECT obs_id FROM lasts WHERE next_id IS NULL")
simple("merge_events", lambda o: networks.merges(linked(o)), f"{NET} SELECT l.next_id AS after, r.prev_id AS before, l.obs_id AS stopped, r.time FROM lasts l JOIN net r ON r.obs_id = l.next_id WHERE r.segment <> l.segment")
simple("split_events", lambda o: networks.splits(linked(o)), f"{NET} SELECT l.prev_id AS before, r.next_id AS after, l.obs_id AS started, r.time FROM firsts l JOIN net r ON r.obs_id = l.prev_id WHERE r.segment <> l.segment")
simple("segment_neighbours", lambda o: networks.segment_edges(linked(o)), f"{NET} SELECT track, s, o FROM adj")
simple("bfs_order", lambda o: networks.relatives(linked(o), linked(o).where("segment = 0").select("track", "segment"), 2), f"{NET}, d0 AS (SELECT DISTINCT track, segment FROM net WHERE segment = 0), d1 AS (SELECT DISTINCT a.track, a.o AS segment FROM d0 JOIN adj a ON a.track = d0.track AND a.s = d0.segment), d2 AS (SELECT DISTINCT a.track, a.o AS segment FROM d1 JOIN adj a ON a.track = d1.track AND a.s = d1.segment) SELECT track, segment, min(d) AS distance FROM (SELECT *, 0 AS d FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY 1, 2")
simple("network_sizes", lambda o: networks.sizes(linked(o)), f"{NET} SELECT track, count(*) AS n_obs, count(DISTINCT segment) AS n_segments, max(time) - min(time) AS days FROM net GROUP BY 1")
simple("network_longer_than", lambda o: networks.longer_than(linked(o), 30).select("obs_id"), f"{NET} SELECT obs_id FROM net WHERE track IN (SELECT track FROM net GROUP BY 1 HAVING max(time) - min(time) + 1 >= 30)")
simple("dead_end_flags", lambda o: networks.without_dead_ends(linked(o), 4).where("track = 0").select("obs_id"), f"{NET}, z AS (SELECT track, segment FROM net GROUP BY 1, 2 HAVING count(*) < 4) SELECT obs_id FROM net JOIN z USING (track, segment) WHERE (SELECT count(*) FROM adj a WHERE a.track = net.track AND a.s = net.segment) < 2")
simple("mean_by_segment", lambda o: rounded(networks.per_segment(linked(o), F.col("lat"), "mean").select("obs_id", "mean"), "mean"), f"{NET} SELECT obs_id, round(avg(lat) OVER (PARTITION BY track, segment), 6) AS mean FROM net")
simple("close_events_rows", lambda o: networks.near_events(linked(o), 3).select("obs_id"), f"{NET}, ev AS (SELECT r.time, unnest([l.next_id, r.prev_id, l.obs_id]) AS id FROM lasts l JOIN net r ON r.obs_id = l.next_id WHERE r.segment <> l.segment UNION SELECT r.time, unnest([l.prev_id, r.next_id, l.obs_id]) FROM firsts l JOIN net r ON r.obs_id = l.prev_id WHERE r.segment <> l.segment), w AS (SELECT DISTINCT n.track, n.segment, ev.time AS t FROM ev JOIN net n ON n.obs_id = ev.id) SELECT DISTINCT n.obs_id FROM net n JOIN w ON n.track = w.track AND n.segment = w.segment AND abs(n.time - w.t) <= 3")
simple("relinked_subset", lambda o: networks.relinked(linked(o).where("time % 2 = 0 or lat > 0")).select("obs_id", "next_id", "prev_id"), f"{NET}, k AS (SELECT * FROM net WHERE time % 2 = 0 OR lat > 0) SELECT k.obs_id, a.obs_id AS next_id, b.obs_id AS prev_id FROM k LEFT JOIN k a ON a.obs_id = k.next_id LEFT JOIN k b ON b.obs_id = k.prev_id")
simple("numbering_segment", lambda o: tracks.renumbered(linked(o).select("obs_id", (F.col("track") * 100 + F.col("segment")).alias("segment")), "segment"), f"{NET} SELECT obs_id, dense_rank() OVER (ORDER BY track * 100 + segment) - 1 AS segment FROM net")


def _recursive(name: str) -> None:
    """DuckDB wants RECURSIVE at the front of the whole statement."""
    ORACLE[name] = ORACLE[name].replace("WITH", "WITH RECURSIVE", 1)


def _forward(o: DataFrame) -> DataFrame:
    net = written(linked(o))
    return networks.reached(net, net.where("time = 27028 and track = 1"))


simple("find_link_forward", _forward, f"{NET}, r(obs_id) AS (SELECT obs_id FROM net WHERE time = 27028 AND track = 1 UNION SELECT x.obs_id FROM r JOIN net n ON n.obs_id = r.obs_id JOIN net x ON (x.track = n.track AND x.segment = n.segment AND x.time >= n.time) OR x.obs_id = n.next_id) SELECT obs_id FROM r")
_recursive("find_link_forward")
# the new numbers follow hashes, so a network is told by its smallest row
simple("dissociated", lambda o: networks.dissociated(linked(o)).select("obs_id", F.min("obs_id").over(Window.partitionBy("track")).alias("first_id")), f"{NET}, q(track, s, o) AS (SELECT DISTINCT track, segment, segment FROM net UNION SELECT q.track, q.s, a.o FROM q JOIN adj a ON a.track = q.track AND a.s = q.o), f AS (SELECT q.track, q.s, min(n.obs_id) AS first_id FROM q JOIN net n ON n.track = q.track AND n.segment = q.o GROUP BY 1, 2) SELECT net.obs_id, f.first_id FROM net JOIN f ON f.track = net.track AND f.s = net.segment")
_recursive("dissociated")
simple("corrected_close_events", lambda o: networks.corrected_close_events(linked(o)).select("obs_id", "segment"), f"{NET}, sp AS (SELECT l.track AS bt, l.segment AS bs, r.track AS pt, r.segment AS ps, r.time AS t0 FROM firsts l JOIN net r ON r.obs_id = l.prev_id WHERE r.segment <> l.segment), mg AS (SELECT l.track AS ct, l.segment AS cs, r.track AS qt, r.segment AS qs, r.time AS t1 FROM lasts l JOIN net r ON r.obs_id = l.next_id WHERE r.segment <> l.segment), lp AS (SELECT bt, bs, min(ps) AS new FROM sp JOIN mg ON bt = ct AND bs = cs AND ps = qs AND pt = qt WHERE t1 - t0 < 20 GROUP BY 1, 2) SELECT obs_id, coalesce(new, segment) AS segment FROM net LEFT JOIN lp ON bt = track AND bs = segment")
simple("time_edges", lambda o: networks.time_edges(o, 2, 0.5).select("a", "b", F.col("lag").cast("int").alias("lag")), "SELECT a.obs_id AS a, b.obs_id AS b, CAST(b.time - a.time AS INTEGER) AS lag FROM obs a JOIN obs b ON b.time - a.time BETWEEN 1 AND 2 AND abs(a.lon - b.lon) <= 0.5 AND abs(a.lat - b.lat) <= 0.5")


def _segments(o: DataFrame) -> DataFrame:
    """Networks and segments of the view's boxes by what they share with those of the next two days."""
    at = o.select("obs_id", "time", "lon", "lat")
    members = written(networks.places(at))
    edges = written(networks.time_edges(at.join(members.where("rep = obs_id").select("obs_id").hint("merge"), "obs_id", "left_semi"), 2, half=0.4))
    return networks.segmented(networks.grouped(at, edges, members), edges, members=members)


def _headed(o: DataFrame) -> DataFrame:
    line = Window.partitionBy("track", "segment").orderBy("time")
    return _segments(o).select("obs_id", F.first("obs_id").over(line).alias("head"), "next_id", "prev_id")


BOX_SHARE = "greatest(least(a.lon, b.lon) + 0.4 - (greatest(a.lon, b.lon) - 0.4), 0.0) * greatest(least(a.lat, b.lat) + 0.4 - (greatest(a.lat, b.lat) - 0.4), 0.0)"
SEGMENTS = f"""sh AS (SELECT a.obs_id AS a, b.obs_id AS b, b.time - a.time AS lag, {BOX_SHARE} AS s, (a.lon + 0.4 - (a.lon - 0.4)) * (a.lat + 0.4 - (a.lat - 0.4)) AS sa, (b.lon + 0.4 - (b.lon - 0.4)) * (b.lat + 0.4 - (b.lat - 0.4)) AS sb
  FROM obs a JOIN obs b ON b.time - a.time BETWEEN 1 AND 2 AND abs(a.lon - b.lon) <= 1 AND abs(a.lat - b.lat) <= 1),
ed AS (SELECT a, b, lag, s / (sa + sb - s) AS score FROM sh WHERE s > 0 AND s / (sa + sb - s) >= 0.2),
go AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY a ORDER BY lag, score DESC, b) = 1),
tk AS (SELECT * FROM go QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a DESC) = 1),
bk AS (SELECT * FROM ed WHERE b NOT IN (SELECT b FROM tk) QUALIFY row_number() OVER (PARTITION BY b ORDER BY lag, score DESC, a) = 1),
ids AS (SELECT a AS id FROM ed UNION SELECT b FROM ed),
hd(id, head) AS (SELECT id, id FROM ids WHERE id NOT IN (SELECT b FROM tk) UNION ALL SELECT tk.b, hd.head FROM hd JOIN tk ON tk.a = hd.id),
sg AS (SELECT hd.id AS obs_id, head, go.b AS next_id, coalesce(tk.a, bk.a) AS prev_id, o.time FROM hd JOIN obs o ON o.obs_id = hd.id LEFT JOIN go ON go.a = hd.id LEFT JOIN tk ON tk.b = hd.id LEFT JOIN bk ON bk.b = hd.id),
fs AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY head ORDER BY time) = 1), ls AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY head ORDER BY time DESC) = 1)"""

simple("split_segments", lambda o: _segments(o).select("obs_id", "track", "segment", "next_id", "prev_id"), None)
simple("segment_heads", _headed, f"{SEGMENTS} SELECT obs_id, head, next_id, prev_id FROM sg")
simple("segment_births", lambda o: networks.births(_segments(o)).select("obs_id"), f"{SEGMENTS} SELECT obs_id FROM fs WHERE prev_id IS NULL")
simple("segment_splits", lambda o: networks.splits(_segments(o)), f"{SEGMENTS} SELECT l.prev_id AS before, r.next_id AS after, l.obs_id AS started, r.time FROM fs l JOIN sg r ON r.obs_id = l.prev_id WHERE r.head <> l.head")
simple("segment_merges", lambda o: networks.merges(_segments(o)), f"{SEGMENTS} SELECT l.next_id AS after, r.prev_id AS before, l.obs_id AS stopped, r.time FROM ls l JOIN sg r ON r.obs_id = l.next_id WHERE r.head <> l.head")
for _name in ("segment_heads", "segment_births", "segment_splits", "segment_merges"):
    _recursive(_name)


simple("network_lifetime", lambda o: networks.with_lifetime(linked(o)).select("obs_id", "lifetime"), f"{NET} SELECT obs_id, max(time) OVER (PARTITION BY track) - min(time) OVER (PARTITION BY track) AS lifetime FROM net")
simple("segment_numbers", lambda o: networks.segment_numbers(linked(o)), f"{NET} SELECT dense_rank() OVER (ORDER BY track, segment) - 1 AS segment_id, track, segment FROM (SELECT DISTINCT track, segment FROM net)")
simple("rekeyed_network", lambda o: networks.rekeyed(linked(o)).select("obs_id", "track", "segment", "next_id", "prev_id"), f"{NET}, k AS (SELECT obs_id, row_number() OVER (ORDER BY track, segment, time, obs_id) - 1 AS new FROM net) SELECT k.new AS obs_id, n.track, n.segment, a.new AS next_id, b.new AS prev_id FROM net n JOIN k ON k.obs_id = n.obs_id LEFT JOIN k a ON a.obs_id = n.next_id LEFT JOIN k b ON b.obs_id = n.prev_id")
simple("close_networks", lambda o: networks.close_networks(pairs.near_centres(linked(o).join(o.select("obs_id", "lon"), "obs_id"), o.withColumn("track", F.floor(F.col("track") / 3)), 0.25, ["time"]), o.withColumn("track", F.floor(F.col("track") / 3)), 40).select("obs_id"), "n AS (SELECT b.track // 3 AS g FROM obs a JOIN obs b ON a.time = b.time AND abs(a.lon - b.lon) <= 0.25 AND abs(a.lat - b.lat) <= 0.25 GROUP BY 1 HAVING count(*) >= 40) SELECT obs_id FROM obs WHERE track // 3 IN (SELECT g FROM n)")
SPLITS = "sp AS (SELECT l.prev_id AS before, r.next_id AS after, l.obs_id AS started, r.time FROM firsts l JOIN net r ON r.obs_id = l.prev_id WHERE r.segment <> l.segment AND r.next_id IS NOT NULL)"
BRANCH = "(SELECT quantile_cont(n.lat, 0.5) FROM net e JOIN net n ON n.track = e.track AND n.segment = e.segment AND n.time > sp.time AND n.time <= sp.time + 10 WHERE e.obs_id = sp.{0})"
simple("percentile_at_splits", lambda o: rounded(networks.percentile_at_splits(linked(o), "lat"), "main", "branch"), f"{NET}, {SPLITS} SELECT started, round({BRANCH.format('after')}, 6) AS main, round({BRANCH.format('started')}, 6) AS branch FROM sp")
