"""Pairs, links and networks by groups of rows of equal boxes: the same results as row by row, and work by group."""

import re

import pytest
from pyspark.sql import functions as F

from gyrelake.operators import pairs
from gyrelake.plans.observation import box_ring

COPIES = 7


@pytest.fixture(scope="module")
def copies(spark):
    """Three places on each of two days, COPIES rows at each; the third place is far away."""
    places = [(0.0, 0.0), (0.25, 0.5), (40.0, 3.0)]
    rows = [(k * 1000 + p * 10 + d, d, *places[p], k * 3 + p, 1.0 + k % 3) for k in range(COPIES) for p in range(3) for d in range(2)]
    return spark.createDataFrame(rows, "obs_id long, time long, lon double, lat double, track long, amplitude double")


@pytest.mark.parametrize("group", [3, 4096])
def test_rings_of_copies(copies, monkeypatch, group):
    monkeypatch.setattr(pairs, "GROUP", group)
    r = copies.withColumn("ring", box_ring(0.5)).select("obs_id", "time", "ring")
    groups = pairs.match(r, r, "union", 0.2, ["time"], grouped=True)
    chunks = -(-COPIES // group)
    assert groups.count() == 2 * (3 + 2) * chunks**2  # not COPIES squared: an overlap is worked out once for two rings
    found = {(x["a_obs_id"], x["b_obs_id"]): round(x["score"], 6) for x in pairs.expanded(groups).collect()}
    rows, share = copies.collect(), {}
    for a in rows:
        for b in rows:
            s = max(0, 1 - abs(a["lon"] - b["lon"])) * max(0, 1 - abs(a["lat"] - b["lat"]))
            if a["time"] == b["time"] and s / (2 - s) >= 0.2:
                share[a["obs_id"], b["obs_id"]] = round(s / (2 - s), 6)
    assert found == share


@pytest.mark.parametrize("group", [2, 4096])
def test_centres_of_copies(copies, monkeypatch, group):
    monkeypatch.setattr(pairs, "GROUP", group)
    near = pairs.near_centres(copies, copies, 0.5, ["time"])
    rows = copies.collect()
    assert sorted((x["a_obs_id"], x["b_obs_id"], x["b_amplitude"]) for x in near.collect()) == sorted((a["obs_id"], b["obs_id"], b["amplitude"]) for a in rows for b in rows if a["time"] == b["time"] and abs(a["lon"] - b["lon"]) <= 0.5 and abs(a["lat"] - b["lat"]) <= 0.5)
    groups = pairs.near_groups(copies, copies, 0.5, ["time"])
    assert groups.count() == 2 * (4 + 1) * (-(-COPIES // group)) ** 2
    assert "Broadcast" not in groups._jdf.queryExecution().executedPlan().toString()


def test_segments_by_places(spark):
    """Edges between the smallest rows of places give the same segments as edges between all rows, and far fewer."""
    from gyrelake.operators import networks

    rows = [(k * 100 + d, d, (d * (1 + k % 2) % 4) * 0.125, 0.25 * (k % 3) * (d % 2)) for k in range(12) for d in range(6)]
    obs = spark.createDataFrame(rows, "obs_id long, time long, lon double, lat double").withColumn("track", F.lit(0))
    plain = networks.time_edges(obs, 2, half=0.4)
    want = networks.segmented(networks.grouped(obs, plain), plain)
    members = networks.places(obs)
    edges = networks.time_edges(obs.join(members.where("rep = obs_id").select("obs_id"), "obs_id", "left_semi"), 2, half=0.4)
    have = networks.segmented(networks.grouped(obs, edges, members), edges, members=members)
    assert sorted(map(str, have.collect())) == sorted(map(str, want.collect()))
    assert edges.count() * 4 < plain.count()


def test_place_edges_follow_rows(spark):
    """A place of many tracks gives a link a track, not one a pair; what is connected is the same."""
    from gyrelake.operators import networks
    from gyrelake.plans.network import place_edges

    rows = [(t, 1, 0.0, 0.0) for t in range(40)] + [(100 + t, 1, 0.5, 0.5) for t in range(40)] + [(300, 1, 9.0, 0.0), (301, 1, 9.0, 0.0), (400, 1, 20.0, 0.0)]
    edges = place_edges(spark.createDataFrame(rows, "track long, time long, lon double, lat double"))
    assert edges.count() == 39 + 39 + 1 + 1
    assert {r["node"]: r["component"] for r in networks.components(edges).collect()} == {t: 0 for t in [*range(40), *range(100, 140)]} | {300: 300, 301: 300}


def test_holders_without_broadcast(spark, copies):
    """Equal points and rings are joined once; small-looking sides are not sent to the driver."""
    points = copies.select(F.col("obs_id").alias("pid"), "time", F.col("lon").alias("x"), F.col("lat").alias("y"))
    held = pairs.holder(points, copies.withColumn("ring", box_ring(0.5)).select("obs_id", "time", "ring"), on=["time"])
    assert held.columns == ["pid", "time", "x", "y", "obs_id"]
    rings = copies.collect()
    holds = lambda r, p: r["time"] == p["time"] and -0.5 <= p["x"] - r["lon"] < 0.5 and -0.5 <= p["y"] - r["lat"] < 0.5
    found = held.collect()
    assert {p["pid"]: p["obs_id"] for p in found} == {p["pid"]: min(r["obs_id"] for r in rings if holds(r, p)) for p in found} and len(found) == len(rings)
    assert "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_copies(spark):
    at = [(0, 10.0, 1.0), (1, 10.0, 1.0), (2, 50.0, -3.0), (3, 50.0, -3.0), (4, None, 0.0)]
    points = spark.createDataFrame(at, "pid long, lon double, lat double")
    cells = spark.createDataFrame([(9, 10.5, 1.0), (8, 10.5, 1.0), (7, 50.0, -3.5), (6, 200.0, 0.0)], "cid long, lon double, lat double")
    assert sorted((r["pid"], r["cid"]) for r in pairs.nearest(points, cells).collect()) == [(0, 8), (1, 8), (2, 7), (3, 7)]
    assert pairs.nearest(points, cells.limit(0)).count() == 0


@pytest.mark.parametrize("copied", [1, 2, 7])
def test_kinds_by_place(spark, copied):
    """Counts by kind equal those of all pairs, with single pairs, parents, twins and copies among them."""
    rows = [(k * 1000 + p * 10 + d, d, 0.25 * (p * p % 7) + 3 * (p // 4), 0.125 * (p % 3)) for k in range(copied) for p in range(9) for d in range(3)]
    rows += [(90000 + d, d, lon, 0.0) for d in range(3) for lon in (30.0, 50.0)][::2] + [(95000 + d, d, 30.25, 0.1) for d in range(3)]
    obs = spark.createDataFrame(rows, "obs_id long, time long, lon double, lat double").dropDuplicates(["obs_id"])
    b = pairs.with_box(obs, 0.3)
    every = pairs.box_pairs(b, b, 1.0, ["time"]).where("a_obs_id < b_obs_id").select(F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), pairs.box_score().alias("score"))
    want = {r["kind"]: r["n"] for r in pairs.match_kinds(every).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert {r["kind"]: r["n"] for r in pairs.kind_counts(obs, 0.3).collect()} == want and len(want) > 1


def test_nearest_targets_of_copies(spark, copies):
    """The best target of each row is that among all pairs; of a place one candidate a row is left, not one a pair."""
    every = pairs.near_centres(copies, copies, 0.5, ["time"]).where("a_obs_id < b_obs_id")
    every = every.select(F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), F.abs(F.col("a_lon") - F.col("b_lon")).alias("cost"), F.col("b_amplitude").alias("amplitude"))
    found = sorted(pairs.nearest_targets(copies, 0.5).select("a", "b", "cost", "amplitude").collect())
    assert found == sorted(pairs.best_target(every).collect()) and found


@pytest.mark.parametrize("how", [{"delta": 0.5}, {"half": 0.4}, {"least": 0.2}])
def test_time_edges_leave_columns_behind(copies, how):
    """What an edge is not told by is not dealt to cells; the edges are those of all rows."""
    from gyrelake.operators import networks

    obs = copies.withColumn("ring", box_ring(0.4))
    edges = networks.time_edges(obs, 1, **how)
    dealt = re.findall(r"collect_list\(struct\(([^)]*)", edges._jdf.queryExecution().optimizedPlan().toString())
    assert dealt and not any(c in part for part in dealt for c in ("amplitude", "track"))
    near = lambda a, b: a["time"] + 1 == b["time"] and abs(a["lon"] - b["lon"]) <= 0.5 and abs(a["lat"] - b["lat"]) <= 0.5
    same = lambda a, b: a["time"] + 1 == b["time"] and a["lon"] == b["lon"]
    rows = copies.collect()
    assert sorted((r["a"], r["b"], r["lag"]) for r in edges.collect()) == sorted((a["obs_id"], b["obs_id"], 1) for a in rows for b in rows if (near if "delta" in how else same)(a, b))


def test_rings_are_worked_out_once(spark):
    """Ring expressions are not copied into the functions that go over their points; the results are those of plain loops."""
    from gyrelake.functions import geo

    rings = [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0, 0), (2, 0), (1, 0.5), (0, 2), (0, 0)], [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)], [(0, 0), (1, 0), (2, 0), (2, 1), (0, 0)]]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in enumerate(rings)], "id long, r array<struct<x:double,y:double>>")
    drawn = F.transform("r", lambda p: F.struct(F.sqrt(p.x * p.x).alias("x"), p.y.alias("y")))
    point = F.sqrt(F.lit(1.21) + F.col("id") * 0)
    for found in (geo.is_convex(drawn), geo.ring_area(drawn), geo.winding(drawn, F.lit(0.5), F.lit(0.4)), geo.winding(F.col("r"), point, F.lit(0.25))):
        plan = df.select(found.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("SQRT") == 1
    out = df.select("id", geo.is_convex(drawn).alias("c"), geo.ring_area(drawn).alias("a"), geo.winding(drawn, F.lit(0.5), F.lit(0.4)).alias("w"), geo.winding(F.col("r"), point, F.lit(0.25)).alias("p")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [(True, 4.0, 1, 1), (False, 1.5, 1, 1), (True, 4.0, -1, -1), (True, 1.0, 0, 1)]
    assert df.select(geo.is_convex(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("c")).where("c is not null").isEmpty()


def test_outlines_ask_boxes_first(spark):
    """A piece of a union is compared with boxes before rings, and dropped by one join, with no list of pieces and rings that meet."""
    from gyrelake.operators import outlines

    rows = [(t, k, 0.25 * k, 0.125 * (k % 3)) for t in range(2) for k in range(6)]
    rings = spark.createDataFrame(rows, "track long, rid long, lon double, lat double").select("track", "rid", box_ring(0.5).alias("ring"))
    pieces = outlines.outline(rings)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "Inner" in line]
    assert plan.count("LeftAnti") == 1 and len(joins) == 1  # the one inner join is that of edges that cut each other
    anti = next(line for line in plan.splitlines() if "LeftAnti" in line)
    assert anti.index("_x0") < anti.index("zip_with")
    cells = {(t, i, j) for t, _, lon, lat in rows for i in range(int((lon - 0.5) * 16), int((lon + 0.5) * 16)) for j in range(int((lat - 0.5) * 16), int((lat + 0.5) * 16))}
    found = {r["track"]: r["area"] for r in outlines.areas(pieces).collect()}
    assert found == pytest.approx({t: sum(c[0] == t for c in cells) / 256 for t in range(2)})


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("few", [0, 10_000])
def test_reached_reads_its_table_once(spark, monkeypatch, forward, few):
    """Links along and against time, between segments and networks: what a plain walk reaches, and each row is read once."""
    import numpy as np
    from gyrelake.operators import networks

    monkeypatch.setattr(networks, "FEW", few, raising=False)
    rng = np.random.default_rng(5)
    rows = [(k, int(k // 40), int(k // 8) % 5, int(k % 8), *[int(v) if v < 120 else None for v in rng.integers(0, 260, 2)]) for k in range(120)]
    schema = "obs_id long, track long, segment long, time long, next_id long, prev_id long"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    net = spark.createDataFrame(rows, schema)
    found = sorted(r["obs_id"] for r in networks.reached(net.mapInPandas(counted, schema), net.where("obs_id in (3, 77)"), forward).collect())
    todo, want = [3, 77], {3, 77}
    while todo:
        _, track, segment, time, after, before = rows[todo.pop()]
        goes = [r[0] for r in rows if r[1:3] == (track, segment) and (r[3] >= time if forward else r[3] <= time)]
        link = after if forward else before
        new = {*goes, *([] if link is None else [link])} - want
        want |= new
        todo += new
    assert found == sorted(want) and len(want) > 20
    assert read.value == len(rows)


def test_meshes_by_batch(spark):
    """Mesh points of rings of many sizes, empty ones and missing points among them, are those of one ring after another; points
    outside are never rows, and a mesh is met in parts."""
    import numpy as np
    from gyrelake.functions import kernels

    rng = np.random.default_rng(3)
    rings = []
    for k in range(12):
        n = int(rng.integers(3, 9))
        angle, r = np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(0.2, 1.5)
        x, y = rng.uniform(-3, 3) + r * np.cos(angle), rng.uniform(-3, 3) + r * np.sin(angle)
        rings.append((k, [(float(a), float(b)) for a, b in zip([*x, x[0]], [*y, y[0]], strict=True)][:: -1 if k % 2 else 1]))
    rings += [(20, []), (21, None), (22, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]), (23, [(None, None)] * 4), (24, [(0.0, 0.0)] * 3)]
    df = spark.createDataFrame(rings, "obs_id long, ring array<struct<x:double,y:double>>")
    want = set()
    for k, ring in rings:
        if ring and ring[0][0] is not None:
            x, y = (np.array(v) for v in zip(*ring, strict=True))
            mesh = [(i * 0.25, j * 0.25) for i in range(-20, 21) for j in range(-20, 21)]
            want |= {(k, *p) for p, held in zip(mesh, kernels.inside(*np.array(mesh).T, x, y), strict=True) if held}
    made = pairs.seeds(df, 0.25)
    found = [tuple(r) for r in made.collect()]
    assert set(found) == want and len(found) == len(want) > 100
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    x, y = (np.concatenate([[p[c] for p in r] for _, r in rings[:12]]) for c in (0, 1))
    for most in (7, 1 << 18):
        parts = list(kernels.mesh_inside(x, y, np.cumsum([0, *[len(r) for _, r in rings[:12]]]), 0.25, most))
        assert {(int(k), a, b) for ks, xs, ys in parts for k, a, b in zip(ks, xs, ys, strict=True)} == {w for w in want if w[0] < 12}
        assert (len(parts) > 12) == (most == 7)


def test_aligned_counts_equal_the_pairs(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.9), (4, 7.0), (5, 30.0)], "obs_id long, time double")
    b = spark.createDataFrame([(6, 0.5), (7, 2.0), (8, 8.0), (9, 50.0)], "obs_id long, time double")
    for all_left in (False, True):
        want = {r["bin"]: r["n"] for r in pairs.aligned(a, b, "time", 3, all_left).groupBy("bin").agg(F.count("b_obs_id").alias("n")).collect()}
        assert {r["bin"]: r["n"] for r in pairs.aligned_counts(a, b, "time", 3, all_left).collect()} == want


def test_ways_over_land_are_walked_once_for_groups(spark):
    at = spark.createDataFrame([(k, 1, float(k % 3), 0.0) for k in range(30)], "obs_id long, time int, lon double, lat double")
    land = spark.createDataFrame([(1, 0, 1)], "i int, j int, mask int")
    groups = pairs.near_groups(at, at, 2.0, ["time"])
    kept = pairs.crossing_land(groups, land, 0.0, 0.0, 1.0)
    assert kept.count() == 2  # of nine pairs of places, those that stay at 0 or 2
    rows = pairs.crossing_land(pairs.near_centres(at, at, 2.0, ["time"]), land, 0.0, 0.0, 1.0).select("a_obs_id", "b_obs_id").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pairs.expanded(kept).select("a_obs_id", "b_obs_id").collect())) and len(rows) == 200
