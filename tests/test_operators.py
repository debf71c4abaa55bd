import math
import random

import pytest
from pyspark.sql import functions as F

from gyrelake.operators import networks, pairs, tracking, tracks
from gyrelake.sources import observations as src
from gyrelake.streaming import tracker


def test_components(spark):
    for edges, parts in (([(0, 1), (0, 2), (1, 3)], {0: {0, 1, 2, 3}}), ([(1, 3), (2, 3), (2, 4), (5, 6), (4, 5)], {1: {1, 2, 3, 4, 5, 6}}), ([(0, 1), (4, 5)], {0: {0, 1}, 4: {4, 5}})):
        rows = networks.components(spark.createDataFrame(edges, "a long, b long")).collect()
        found = {}
        for r in rows:
            found.setdefault(r["component"], set()).add(r["node"])
        assert found == parts


def test_running_sum(spark):
    rows = [(i, t, i, 2) for i, t in enumerate([1, 1, 2, 2, 2, 2, 44, 44, 44, 48])]
    df = tracks.running_sum(spark.createDataFrame(rows, "obs_id long, track long, time int, v int"), "v", "s")
    assert [r["s"] for r in df.orderBy("obs_id").collect()] == [2, 4, 2, 4, 6, 8, 2, 4, 6, 2]


def test_gaps(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in (67, 68, 70, 71, 74, 75)], "track long, time int, lat double")
    full = tracks.interpolated(tracks.with_gaps_filled(df), ["lat"])
    assert [(r["time"], r["lat"]) for r in full.where("virtual = 1").orderBy("time").collect()] == [(69, 69.0), (72, 72.0), (73, 73.0)]


def test_greedy_assignment_takes_the_cheapest_first(spark):
    c = [(0, 1, 11, 0.5), (0, 1, 12, 0.2), (0, 2, 12, 0.1), (0, 2, 11, 0.9), (0, 3, 11, 0.6)]
    links = pairs.assigned(spark.createDataFrame(c, "step int, a long, b long, cost double")).collect()
    assert {(r["a"], r["b"]) for r in links} == {(2, 12), (1, 11)}


def test_fold_bridges_an_absence(spark):
    rows = [(t, t, 0.5 * t, 10.0, 1.0, 5e4) for t in (0, 1, 2, 4, 5)]
    obs = spark.createDataFrame(rows, "obs_id long, time int, lon double, lat double, amplitude double, radius_s double")
    done, ends = tracking.fold(obs.unionByName(obs.select((F.col("obs_id") + 100).alias("obs_id"), F.lit(3).alias("time"), F.lit(90.0).alias("lon"), "lat", "amplitude", "radius_s").limit(1)), 2)
    assert {r["obs_id"]: r["track"] for r in done.collect() if r["obs_id"] < 100} == dict.fromkeys((0, 1, 2, 4, 5), 0)
    assert ends.where("track = 0").count() == 1


def test_fold_goes_through_days_without_rows(spark):
    """Days 3 and 7 to 9 have no row at all: one day is bridged, three are one too many."""
    obs = spark.createDataFrame([(t, t, 0.25 * t, 10.0, 1.0, 5e4) for t in (0, 1, 2, 4, 5, 6, 10)], "obs_id long, time int, lon double, lat double, amplitude double, radius_s double")
    done, ends = tracking.fold(obs, 2)
    assert {r["obs_id"]: r["track"] for r in done.collect()} == dict.fromkeys((0, 1, 2, 4, 5, 6), 0) | {10: 10}
    assert [r["track"] for r in ends.collect()] == [10]
    first, state = tracking.fold(obs.where("time < 3"), 2)
    assert {r["track"] for r in tracking.fold(obs.where("time between 3 and 5"), 2, state=state)[0].collect()} == {0}


def plain_fold(rows, most_gap, reach=1.0, furthest=125_000.0):
    """Tracks by the rule told day by day: (cost, end, row) in order, each once; ends without a row move on."""
    metres = lambda p, q: 2 * 6370997.0 * math.asin(min(1, math.sqrt(math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2)))
    track, ends = {}, []
    for day in range(min(r[1] for r in rows), max(r[1] for r in rows) + 1):
        now = [r for r in rows if r[1] == day]
        pairs = []
        for e in ends:
            for r in now:
                if abs(e["x"] - r[2]) <= reach and abs(e["y"] - r[3]) <= reach and (d := metres((e["x"], e["y"]), r[2:4])) < furthest:
                    pairs.append((math.sqrt(((e["amp"] - r[4]) / e["amp"]) ** 2 + ((e["r"] - r[5]) / e["r"]) ** 2 + (d / 125_000) ** 2), e["id"], r[0]))
        by_end, by_row = {}, {}
        for _, a, b in sorted(pairs):
            if a not in by_end and b not in by_row:
                by_end[a], by_row[b] = b, a
        old = {e["id"]: e for e in ends}
        ends = [dict(e, x=e["x"] + e["dx"], y=e["y"] + e["dy"], gap=e["gap"] + 1, id=-abs(e["id"])) for e in ends if e["id"] not in by_end and e["gap"] < most_gap]
        for r in now:
            e = old.get(by_row.get(r[0]))
            track[r[0]] = e["track"] if e else r[0]
            ends.append({"id": r[0], "x": r[2], "y": r[3], "amp": r[4], "r": r[5], "dx": r[2] - e["x"] if e else 0.0, "dy": r[3] - e["y"] if e else 0.0, "gap": 0, "track": track[r[0]]})
    return track, {e["track"] for e in ends}


@pytest.mark.parametrize("block", [2, 5])
def test_fold_in_blocks(spark, block):
    """Wandering features with absences, close to each other, over fourteen days in blocks of any length, and from a saved state."""
    rng = random.Random(5)
    rows = []
    for k in range(8):
        x, y = rng.uniform(0, 4), rng.uniform(10, 13)
        for day in range(14):
            x, y = x + rng.uniform(-0.1, 0.3), y + rng.uniform(-0.2, 0.2)
            if rng.random() > 0.45:
                rows.append((100 * k + day + 1, day, x, y, rng.uniform(0.8, 1.2), rng.uniform(4e4, 6e4)))
    schema = "obs_id long, time int, lon double, lat double, amplitude double, radius_s double"
    want, live = plain_fold(rows, 2)
    assert 8 < len(set(want.values())) < len(want) / 2
    done, ends = tracking.fold(spark.createDataFrame(rows, schema), 2, block=block)
    assert {r["obs_id"]: r["track"] for r in done.collect()} == want
    assert {r["track"] for r in ends.collect()} == live
    if block == 5:
        early, state = tracking.fold(spark.createDataFrame([r for r in rows if r[1] < 6], schema), 2)
        late, _ = tracking.fold(spark.createDataFrame([r for r in rows if r[1] > 6], schema), 2, state=state)
        parts = {r["obs_id"]: r["track"] for df in (early, late) for r in df.collect()}
        assert parts == plain_fold([r for r in rows if r[1] != 6], 2)[0]


def test_assignment_in_order(spark):
    rng = random.Random(2)
    c = [(s, a, 100 + b, round(rng.random(), 2)) for s in (0, 1) for a in range(8) for b in range(8) if rng.random() < 0.5]
    want = set()
    for s in (0, 1):
        used = set()
        for a in range(8):
            free = [(cost, b) for t, x, b, cost in c if (t, x) == (s, a) and b not in used]
            if free:
                used.add(min(free)[1])
                want.add((s, a, min(free)[1]))
    found = tracking.assigned_in_order(spark.createDataFrame(c, "step int, a long, b long, cost double")).collect()
    assert {(r["step"], r["a"], r["b"]) for r in found} == want and len(found) == len(want)


def test_streaming_tracker(spark, tmp_path):
    rows = [(0, 10 * t + k, t, 0.3 * t + 20.0 * k, 5.0) for t in (0, 1, 3, 4) for k in (0, 1)]
    spark.createDataFrame(rows, tracker.OUT.replace("track long", "lon double, lat double")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tracker.OUT.replace("track long", "lon double, lat double")).parquet(str(tmp_path / "in"))
    q = tracker.tracked(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["obs_id"]: r["track"] for r in spark.table("tracked").collect()} == {10 * t + k: k for t in (0, 1, 3, 4) for k in (0, 1)}


@pytest.mark.parametrize("hold", [False, True])
def test_streaming_tracker_day_over_batches(spark, tmp_path, hold):
    """A region's day in two files, each a micro-batch of its own, after a day without rows."""
    schema = tracker.OUT.replace("track long", "lon double, lat double")
    rows = lambda t, ks: [(0, 10 * t + k, t, 0.3 * t + 20.0 * k, 5.0) for k in ks]
    parts = [rows(0, (0, 1, 2)), rows(2, (1,)), rows(2, (0, 2)), rows(3, (2,)), rows(3, (1, 0)), rows(9, (0,))]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in*"))
        q = tracker.tracked(stream, **({"hold": True} if hold else {})).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    found = [(r["obs_id"], r["track"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = {10 * t + k: k for t in (0, 2, 3) for k in (0, 1, 2)} | ({90: 90} if not hold else {})
    assert len(found) == len(dict(found)) and dict(found) == want


def test_registry_and_files(spark, tmp_path):
    assert src.schema(src.TRACK)["track"].dataType.typeName() == "long"
    with pytest.raises(KeyError):
        src.schema(["nothing"])
    df = spark.createDataFrame([(1, 2.0, 0.25)], "type_cyc int, longitude double, A double")
    src.save(df, str(tmp_path / "t"))
    assert src.load(spark, str(tmp_path / "t"), include=["lon", "amplitude"]).collect() == [(2.0, 0.25)]
    files = spark.createDataFrame([(f"x_2019010{d}.nc",) for d in (1, 2, 3)], "path string")
    assert src.files_by_date(spark, files, step=2).count() == 2
    with pytest.raises(ValueError):
        src.files_by_date(spark, files.where("path not like '%2.nc'").union(spark.createDataFrame([("x_20190104.nc",)], "path string"))).count()


def test_empty_table(spark):
    empty = src.day_observations(spark, "/root/testdata/sf0.001").limit(0)
    assert tracks.summary(empty).count() == 0 and pairs.step_candidates(empty).count() == 0 and tracks.in_period(empty, -1, -1).count() == 0
