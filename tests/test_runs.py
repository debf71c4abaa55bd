"""Jobs, saved states and rules on networks over small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.operators import advection, grids, networks, pairs, tracking
from gyrelake.plans import jobs
from gyrelake.plans.network import linked
from gyrelake.plans.observation import box_ring, view
from gyrelake.sources import tables

OBS = "obs_id long, time int, lon double, lat double, amplitude double, radius_s double"


def drifting(spark, days, starts=(0.0, 5.0)):
    return spark.createDataFrame([(100 * k + d, d, x + 0.1 * d, 10.0 + k, 0.1, 50_000.0) for k, x in enumerate(starts) for d in days], OBS)


def test_tracking_goes_on_from_a_saved_state(spark, tmp_path):
    first, second, whole = drifting(spark, (0, 1, 2)), drifting(spark, (4, 5)), drifting(spark, (0, 1, 2, 4, 5))
    for name, df in (("first", first), ("second", second)):
        df.write.parquet(f"{tmp_path}/{name}")
        jobs.track(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}_tracks", f"{tmp_path}/state_{name}" if name == "first" else f"{tmp_path}/state")
        if name == "first":
            tracking.save_state(tracking.load_state(spark, f"{tmp_path}/state_first", {"kind": "fold", "most_gap": 3}), f"{tmp_path}/state", {"kind": "fold", "most_gap": 3})
    parts = [r for n in ("first", "second") for r in spark.read.parquet(f"{tmp_path}/{n}_tracks").collect()]
    assert {r["obs_id"]: r["track"] for r in parts} == {r["obs_id"]: r["track"] for r in tracking.fold(whole)[0].collect()}
    assert {r["track"] for r in parts} == {0, 100}
    with pytest.raises(ValueError):
        tracking.load_state(spark, f"{tmp_path}/state", {"kind": "other"})


def test_classes_and_rebuilt_tracks(spark, tmp_path):
    """A track of five rows, one of two and a single row; then tracks of four rows at least from saved links."""
    rows = [(d, d, 0.1 * d, 10.0, 0.1, 5e4) for d in range(5)] + [(100 + d, d, 20.0, 10.0, 0.1, 5e4) for d in range(2)] + [(200, 3, 40.0, 10.0, 0.1, 5e4)]
    spark.createDataFrame(rows, OBS).write.parquet(f"{tmp_path}/obs")
    jobs.track(spark, f"{tmp_path}/obs", f"{tmp_path}/tracks", least=4)
    found = {(r["class"], r["track"]) for r in spark.read.parquet(f"{tmp_path}/tracks").collect()}
    assert found == {("long", 0), ("short", 100), ("untracked", 200)}
    jobs.link(spark, f"{tmp_path}/obs", f"{tmp_path}/links")
    jobs.rebuild(spark, f"{tmp_path}/obs", f"{tmp_path}/links", f"{tmp_path}/rebuilt", least=4)
    assert sorted((r["obs_id"], r["track"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/rebuilt").collect()) == [(d, 0, d) for d in range(5)]


def test_tracks_by_overlap(spark):
    """Squares that drift by a tenth of their width; each is linked with its own next day, not with its neighbour's."""
    obs = drifting(spark, range(4), (0.0, 0.6)).withColumn("lat", F.lit(10.0)).withColumn("ring", box_ring(0.5))
    links = tracking.day_links(obs, candidates=lambda o, *_: pairs.area_candidates(o)).collect()
    assert sorted((r["a"], r["b"]) for r in links) == [(100 * k + d, 100 * k + d + 1) for k in (0, 1) for d in range(3)]
    assert all(abs(r["cost"] - (1 - 0.9 / 1.1)) < 1e-6 for r in links)


def basin(spark):
    """Three days of a height field with two highs and a low that drift west, and its currents."""
    cells = spark.range(3 * 60 * 40).select(F.floor(F.col("id") / 2400).alias("t"), F.floor(F.col("id") % 2400 / 40).cast("int").alias("i"), (F.col("id") % 40).cast("int").alias("j"))
    g = cells.withColumns({"lon": 10 + F.col("i") * 0.25, "lat": 30 + F.col("j") * 0.25})
    hump = lambda x, y, w, h: h * F.exp(-(F.pow(F.col("lon") - x + F.col("t") * 0.1, 2) + F.pow(F.col("lat") - y, 2)) / w)
    g = g.withColumn("height", hump(14.0, 34.0, 0.5, 0.2) + hump(20.0, 36.0, 0.5, -0.15) + hump(19.0, 32.0, 0.4, 0.1))
    return grids.with_currents(g, "height", 0.25, 1)


def test_features_from_a_saved_grid(spark, tmp_path):
    grids.save_grid(basin(spark), f"{tmp_path}/grid")
    jobs.identify(spark, f"{tmp_path}/grid", "height", f"{tmp_path}/found", jobs.detection.Limits(step=0.01), times=(0, 0))
    found = spark.read.parquet(f"{tmp_path}/found").collect()
    assert {r["t"] for r in found} == {0} and sorted(r["sign"] for r in found) == [-1, 1, 1]
    near = lambda x, y: [r for r in found if abs(r["lon"] - x) < 0.3 and abs(r["lat"] - y) < 0.3]
    for x, y, height in ((14.0, 34.0, 0.2), (20.0, 36.0, 0.15), (19.0, 32.0, 0.1)):
        (r,) = near(x, y)
        assert r["amplitude"] == pytest.approx(height, abs=0.02)
    back = grids.load_grid(spark, f"{tmp_path}/grid", ["height"], (1, 1), lon=(12, 13), lat=(31, 32))
    assert back.count() == 25 and back.columns == ["t", "i", "j", "lon", "lat", "height"]
    named = grids.with_variable(grids.with_variable(back, "h2", F.col("height") * 2, "m"), "h3", "h2")
    assert [d for d in grids.described(named) if d[0] != "height"] == [("h2", "double", "m"), ("h3", "double", "m")]


def test_one_network(spark):
    net = spark.createDataFrame([(1, 1), (1, 2)], "track long, obs_id long")
    assert networks.only_one(net).count() == 2 and networks.only_one(net.limit(0)).count() == 0
    with pytest.raises(ValueError):
        networks.only_one(net.unionByName(net.withColumn("track", F.lit(2).cast("long"))))


def split(branch_days):
    """A line of segment 0 that ends two days after segment 1 has left it."""
    rows = [(d, 1, 0, d, d + 1 if d < 4 else None, d - 1 if d else None, 0.5) for d in range(5)]
    last = 2 + branch_days
    return rows + [(100 + d, 1, 1, d, 100 + d + 1 if d < last else None, 100 + d - 1 if d > 3 else 2, 0.6) for d in range(3, last + 1)]


@pytest.mark.parametrize("days, changed", [(20, True), (5, False)])
def test_labels_change_at_a_split(spark, days, changed):
    net = spark.createDataFrame(split(days), "obs_id long, track long, segment long, time int, next_id long, prev_id long, prev_cost double")
    out = {r["obs_id"]: r["segment"] for r in networks.swapped(net, "prev_cost").collect()}
    assert len(out) == net.count() and all(out[d] == 0 for d in range(3))
    assert {out[3], out[4]} == {1 if changed else 0} and {out[100 + d] for d in range(3, 3 + days)} == {0 if changed else 1}


def test_compared_networks(spark, sf_dir="/root/testdata/sf0.001"):
    net = linked(view(spark, sf_dir)).select("obs_id", "track", "segment")
    moved = net.withColumns({"track": F.col("track") + 7, "segment": F.when((F.col("track") == 1) & (F.col("segment") == 0), 1).otherwise(F.col("segment"))})
    (r,) = jobs.compare(net, moved).collect()
    assert r["same_networks"] == r["networks"] == r["other_networks"] and r["rows_in_same_networks"] == net.count()
    assert r["segments"] - r["same_segments"] == 2 and r["other_segments"] == r["segments"] - 1


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.get = lambda key, default=None: values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert tables.shared_folder(Session(spark_master="local[4]")).endswith("/checkpoints")
    assert tables.shared_folder(Session(spark_master="yarn", **{"spark_checkpoint_dir": "hdfs://a/b/"})) == "hdfs://a/b"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            tables.shared_folder(Session(spark_master=master))


@pytest.mark.parametrize("tile, chunk", [(64, 20_000), (8, 1)])
def test_particles_in_a_uniform_current(spark, monkeypatch, tile, chunk):
    """Half a metre a second north: so many degrees a day, over tiles as well, and back again; the grid's last time ends it."""
    monkeypatch.setattr(advection, "TILE", tile)
    monkeypatch.setattr(advection, "CHUNK", chunk)
    g = basin(spark).withColumns({"u": F.lit(0.0), "v": F.lit(0.5)})
    seeds = spark.createDataFrame([(1, 14.0, 33.0), (2, 15.5, 34.25), (3, 40.0, 33.0), (4, 14.0, None)], "pid long, x double, y double")
    day = 0.5 * 86400 / (3.141592653589793 / 180 * 6370997.0)
    found = {(r["pid"], r["step"]): (r["x"], r["y"]) for r in advection.paths(seeds, g, 0, 3).collect()}
    assert len(found) == 16
    for (pid, step), (x, y) in found.items():
        if pid > 2 and step or step == 3:
            assert x is None and y is None
        elif pid < 3:
            assert (x, y) == pytest.approx(({1: 14.0, 2: 15.5}[pid], {1: 33.0, 2: 34.25}[pid] + step * day), abs=1e-6)
    back = advection.paths(seeds, g, 2, 2, backward=True).collect()
    assert {(r["pid"], r["step"]): r["y"] for r in back}[1, 2] == pytest.approx(33.0 - 2 * day, abs=1e-6)
    still = advection.paths(seeds, g.where("t = 1"), 0, 1, rk4=False).collect()
    assert {(r["pid"], r["step"]): r["y"] for r in still}[2, 1] == pytest.approx(34.25 + day, abs=1e-6)


def test_particles_go_round_a_circular_grid(spark, monkeypatch):
    """A current east that takes particles over the end of the grid; longitudes go on."""
    monkeypatch.setattr(advection, "TILE", 16)
    per_day = 86400 * 180 / 3.141592653589793 / 6370997.0
    cells = spark.range(2 * 90 * 5).select(F.floor(F.col("id") / 450).alias("t"), F.floor(F.col("id") % 450 / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j"))
    g = cells.withColumns({"lon": F.col("i") * 4.0, "lat": F.col("j") * 4.0 - 8, "v": F.lit(0.0)}).withColumn("u", 30.0 * F.cos(F.radians("lat")) / per_day)
    seeds = spark.createDataFrame([(k, 40.0 * k + 1, float(k - 4)) for k in range(9)], "pid long, x double, y double")
    found = {(r["pid"], r["step"]): r["x"] for r in advection.paths(seeds, g, 0, 1).collect()}
    assert {p: x for (p, s), x in found.items() if s == 1} == {k: pytest.approx(40.0 * k + 31, abs=1e-6) for k in range(9)}


def plain_segments(times, edges):
    """Segments, next and previous rows by the rule that takes rows in order of time: each is followed as far as it goes, a
    target that is taken already is taken over by a better overlap, and a first row looks back for its best overlap."""
    segment, nxt, prev, best, count = {}, {}, {}, {}, 0
    order = sorted(times, key=lambda i: (times[i], i))
    for start in order:
        if start in segment:
            continue
        at = start
        while at is not None:
            segment[at] = count
            ahead = [(lag, -score, b) for a, b, lag, score in edges if a == at]
            if not ahead:
                break
            _, less, b = min(ahead)
            nxt[at] = b
            best[b] = max(best.get(b, 0), -less)
            if b in segment:
                if -less == best[b]:
                    old = segment[b]
                    for i in order:
                        if segment.get(i) == old and (times[i], i) >= (times[b], b):
                            segment[i] = count
                    prev[b] = at
                break
            prev[b] = at
            at = b
        count += 1
        back = [(lag, -score, a) for a, b, lag, score in edges if b == start]
        if back:
            prev[start], best[start] = min(back)[2], -min(back)[1]
    return {i: (segment[i], nxt.get(i), prev.get(i)) for i in order}


def found_segments(spark, times, edges):
    obs = spark.createDataFrame([(i, t) for i, t in times.items()], "obs_id long, time int")
    table = spark.createDataFrame(edges, "a long, b long, lag int, score double")
    out = networks.segmented(networks.grouped(obs, table), table)
    return {r["obs_id"]: (r["track"], r["segment"], r["next_id"], r["prev_id"]) for r in out.collect()}, out


def test_segments_with_a_split_and_a_merge(spark):
    """Row 1 goes on to 2; 3 branches off it and goes on to 4, where 2 goes too and is taken over by the better overlap."""
    times, edges = {1: 0, 2: 1, 3: 1, 4: 2}, [(1, 2, 1, 0.8), (1, 3, 1, 0.4), (2, 4, 1, 0.5), (3, 4, 1, 0.6)]
    found, net = found_segments(spark, times, edges)
    assert found == {1: (1, 0, 2, None), 2: (1, 0, 4, 1), 3: (1, 1, 4, 1), 4: (1, 1, None, 3)}
    assert [(r["before"], r["after"], r["started"]) for r in networks.splits(net).collect()] == [(1, 2, 3)]
    assert [(r["after"], r["before"], r["stopped"]) for r in networks.merges(net).collect()] == [(4, 3, 2)]
    assert [r["obs_id"] for r in networks.births(net).collect()] == [1]


def test_segments_equal_the_sequential_rule(spark):
    """Random networks over twelve days, windows of three."""
    rng = np.random.default_rng(7)
    times = {int(i): int(rng.integers(12)) for i in range(160)}
    edges = []
    for a in times:
        for b in times:
            lag = times[b] - times[a]
            if 1 <= lag <= 3 and rng.random() < 0.03:
                edges.append((a, b, lag, float(rng.uniform(0.2, 1))))
    found, _ = found_segments(spark, times, edges)
    linked = {i for a, b, _, _ in edges for i in (a, b)}
    assert set(found) == linked
    by_net = {}
    for i, (track, *_) in found.items():
        by_net.setdefault(track, set()).add(i)
    assert len(by_net) > 1
    for ids in by_net.values():
        own = [e for e in edges if e[0] in ids]
        assert {i: found[i][1:] for i in ids} == plain_segments({i: times[i] for i in ids}, own)
