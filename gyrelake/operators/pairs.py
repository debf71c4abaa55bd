"""Joins of observation sets: boxes, centres, rings, alignment, comparison, greedy assignment.

Spatial joins deal rows to cells and join on the cell; a pair that shares several cells is kept only in the first, so
that no distinct step follows. Exact predicates come after.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrelake.functions import kernels
from gyrelake.functions.geo import RADIUS, haversine, quotient, winding
from gyrelake.sources.observations import union_all
from gyrelake.sources.tables import written

BOX = ("x0", "x1", "y0", "y1")
#: Rows of equal boxes that are dealt and joined as one row.
GROUP = 4096


def with_box(df: DataFrame, half: Column | float | None = None) -> DataFrame:
    """x0, x1, y0, y1: around the centre by half a width in degrees."""
    half = half if isinstance(half, Column) else F.lit(half)
    return df.withColumns({"x0": F.col("lon") - half, "x1": F.col("lon") + half, "y0": F.col("lat") - half, "y1": F.col("lat") + half})


def boxes(df: DataFrame, key: list[str]) -> DataFrame:
    """Groups of rows with equal key columns, GROUP rows at most in one: the key, and `rows` with the other columns."""
    rest = [c for c in df.columns if c not in key]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(key[0])) - 1
    grouped = df.withColumn("_chunk", F.floor(place / GROUP)).groupBy(*key, "_chunk")
    return grouped.agg(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))).alias("rows")).drop("_chunk")


def group_pairs(a: DataFrame, b: DataFrame, size: float = 1.0, on: list[str] | None = None, around: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of `boxes` groups (equal box, `on` and `more`) whose closed boxes meet: the key's columns as a_*, b_*, a_rows and
    b_rows, and turn. What is the same for all rows of two groups is computed here once; `expanded` makes pairs of rows of
    them, after the shuffle, so what is shuffled grows with the rows and not with their pairs."""
    on = on or []
    if around:  # cells must divide the circle, so that a turn is a whole number of them
        size = 360 / max(1, int(360 / size))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        df = boxes(df, [*on, *BOX, *more])
        df = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        lo, hi = (F.floor(F.col(f"{name}_{e}") / size) for e in ("x0", "x1"))
        df = df.withColumn("_i", F.explode(F.sequence(lo, hi))).withColumn("_j", F.explode(F.sequence(F.floor(F.col(f"{name}_y0") / size), F.floor(F.col(f"{name}_y1") / size))))
        turn = round(360 / size)
        return df.withColumns({"_cell": F.pmod("_i", F.lit(turn)) if around else F.col("_i"), f"_{name}i": F.col("_i")}).drop("_i")

    x, y = dealt(a, "a"), dealt(b, "b")
    # never a broadcast: a table that compresses well is far larger in memory than its shuffle files tell
    pairs = x.join(y.hint("merge"), (x["_cell"] == y["_cell"]) & (x["_j"] == y["_j"]) & _equal(on))
    # whole turns between the two where they lie across the seam
    shift = F.floor((F.col("_ai") - F.col("_bi")) / round(360 / size)) * 360.0 if around else F.lit(0.0)
    ax0, ax1, bx0, bx1 = F.col("a_x0"), F.col("a_x1"), F.col("b_x0") + shift, F.col("b_x1") + shift
    meet = (ax0 <= bx1) & (bx0 <= ax1) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    first = (F.col("_ai") == F.floor(F.greatest(ax0, bx0) / size)) & (x["_j"] == F.floor(F.greatest("a_y0", "b_y0") / size))
    return pairs.where(meet & first).select(*[c for c in pairs.columns if not c.startswith("_")], shift.cast("double").alias("turn"))


def expanded(groups: DataFrame) -> DataFrame:
    """Pairs of rows, as columns a_*, b_*, of pairs of groups; every other column of those is kept."""
    keep = [c for c in groups.columns if c not in ("a_rows", "b_rows")]
    fields = [(n, c) for n in "ab" for c in groups.schema[f"{n}_rows"].dataType.elementType.names if c != "_one"]
    out = groups.withColumn("_a", F.explode("a_rows")).withColumn("_b", F.explode("b_rows"))
    return out.select(*[F.col(f"_{n}")[c].alias(f"{n}_{c}") for n, c in fields], *keep)


def box_pairs(a: DataFrame, b: DataFrame, size: float = 1.0, on: list[str] | None = None, around: bool = True) -> DataFrame:
    """Pairs whose closed boxes meet, as columns a_*, b_*, and turn: the degrees that bring b next to a, whole turns. on:
    further equal keys. around: longitudes meet across 360. Columns that are not needed are best left out before: each
    row is dealt to cells with all of them."""
    return expanded(group_pairs(a, b, size, on, around))


def _equal(on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return out


def near_groups(a: DataFrame, b: DataFrame, delta: float = 0.1, on: list[str] | None = None) -> DataFrame:
    """`group_pairs` of rows of equal centres (lon, lat) that differ by delta degrees at most on both axes."""
    boxed = lambda df, d: df.withColumns({"x0": F.col("lon") - d, "x1": F.col("lon") + d, "y0": F.col("lat") - d, "y1": F.col("lat") + d})
    return group_pairs(boxed(a, delta), boxed(b, 0.0), max(1.0, delta), on, more=("lon", "lat"))


def near_centres(a: DataFrame, b: DataFrame, delta: float = 0.1, on: list[str] | None = None) -> DataFrame:
    """Pairs whose centres differ by delta degrees at most on both axes."""
    return expanded(near_groups(a, b, delta, on))


def box_score(kind: str = "union") -> Column:
    """Overlap of the boxes of a pair of `box_pairs`: shared area over the union, the smaller one, or the first one."""
    w = F.least(F.col("a_x1"), F.col("b_x1") + F.col("turn")) - F.greatest(F.col("a_x0"), F.col("b_x0") + F.col("turn"))
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda n: (F.col(f"{n}_x1") - F.col(f"{n}_x0")) * (F.col(f"{n}_y1") - F.col(f"{n}_y0"))
    under = {"union": area("a") + area("b") - both, "smaller": F.least(area("a"), area("b")), "first": area("a")}[kind]
    return F.try_divide(both, under)


@F.pandas_udf(T.DoubleType())
def ring_overlap(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, kind: pd.Series) -> pd.Series:
    """Overlap of two rings given as arrays of coordinates; kind (one for all): union, smaller or first."""
    return pd.Series(kernels.overlaps(ax.to_list(), ay.to_list(), bx.to_list(), by.to_list(), kind.iloc[0]) if len(kind) else [], dtype=float)


def match(a: DataFrame, b: DataFrame, kind: str = "union", least: float = 0.0, on: list[str] | None = None, grouped: bool = False) -> DataFrame:
    """Pairs of rings (ring: array of x, y) with score >= least and > 0; boxes first, then the exact overlap, once for all
    pairs of the same two rings. grouped: pairs of groups of equal rings, for `expanded`."""
    edge = lambda pick, k: pick(F.transform("ring", lambda p: p[k]))
    boxed = lambda df: df.withColumns({"x0": edge(F.array_min, "x"), "x1": edge(F.array_max, "x"), "y0": edge(F.array_min, "y"), "y1": edge(F.array_max, "y")})
    groups = group_pairs(boxed(a), boxed(b), 1.0, on, more=("ring",))
    axis = lambda n, k: F.transform(f"{n}_ring", lambda p: p[k])
    scored = groups.withColumn("score", ring_overlap(axis("a", "x"), axis("a", "y"), axis("b", "x"), axis("b", "y"), F.lit(kind)))
    scored = scored.where((F.col("score") >= least) & (F.col("score") > 0))
    return scored if grouped else expanded(scored)


def holder(points: DataFrame, rings: DataFrame, size: float = 1.0, on: list[str] | None = None, around: bool = True) -> DataFrame:
    """Each point (pid, x, y) with the smallest obs_id of the rings that hold it; null if none does or a coordinate is
    missing. on: equal keys. around: a point is turned next to each ring, across 0 or 360 as elsewhere."""
    on = on or []
    if around:  # cells must divide the circle
        size = 360 / max(1, int(360 / size))
    turn = F.lit(round(360 / size)).cast("long")
    cell = (lambda c: F.pmod(c, turn)) if around else (lambda c: c)
    edge = lambda pick, k: F.floor(pick(F.transform("ring", lambda p: p[k])) / size)
    # of equal rings the smallest id, and each place once: what is joined grows with places, not with rows
    dealt = rings.groupBy("ring", *on).agg(F.min("obs_id").alias("obs_id")).select("obs_id", "ring", *on, F.explode(F.sequence(edge(F.array_min, "x"), edge(F.array_max, "x"))).alias("_ri"))
    dealt = dealt.withColumn("_j", F.explode(F.sequence(edge(F.array_min, "y"), edge(F.array_max, "y")))).withColumn("_i", cell(F.col("_ri")))
    at = points.where("not (isnan(x) or isnan(y))").select("x", "y", *on).distinct().withColumns({"_pi": F.floor(F.col("x") / size), "_j": F.floor(F.col("y") / size)}).withColumn("_i", cell(F.col("_pi")))
    both = at.join(dealt.hint("merge"), ["_i", "_j", *on]).withColumn("_x", F.col("x") + (F.col("_ri") - F.col("_pi")) * size)
    inside = both.where(winding(F.col("ring"), F.col("_x"), F.col("y")) != 0).groupBy("x", "y", *on).agg(F.min("obs_id").alias("obs_id"))
    return points.join(inside.hint("merge"), ["x", "y", *on], "left").select(*points.columns, "obs_id")


def aligned(a: DataFrame, b: DataFrame, key: str, width: float, all_left: bool = False) -> DataFrame:
    """Pairs of rows of both sets with the same bin of a column, as a_*, b_*: all pairs of a bin. `aligned_rows` has the rows
    without pairing them."""
    named = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in df.columns], F.floor(F.col(key) / width).alias("bin"))
    return named(a, "a").join(named(b, "b"), "bin", "left" if all_left else "inner")


def aligned_counts(a: DataFrame, b: DataFrame, key: str, width: float, all_left: bool = False) -> DataFrame:
    """bin, n: how many pairs `aligned` has in each bin, told by the rows of both sides there; no pair is made. all_left: 0 where
    a bin of a has no row of b."""
    counted = lambda df, n: df.groupBy(F.floor(F.col(key) / width).alias("bin")).agg(F.count("*").alias(n))
    both = counted(a, "_a").join(counted(b, "_b"), "bin", "left" if all_left else "inner")
    return both.select("bin", (F.col("_a") * F.coalesce("_b", F.lit(0).cast("long"))).alias("n"))


def aligned_rows(a: DataFrame, b: DataFrame, key: str, width: float, all_left: bool = False) -> DataFrame:
    """Rows of both sets in bins of a column that both have (all_left: every row of a), side by side: bin, side ('a' or 'b')
    and the columns of a. A row once, whatever its bin holds, so a bin of any size costs its rows and no more; sorted by
    bin and side within partitions, so that a consumer reads each bin's two groups one after the other."""
    binned = lambda df: df.withColumn("bin", F.floor(F.col(key) / width))
    x, y = binned(a), binned(b)
    bins = lambda df: df.select("bin").distinct()
    left = x if all_left else x.join(bins(y), "bin", "left_semi")
    right = y.join(bins(x), "bin", "left_semi")
    rows = left.select("bin", F.lit("a").alias("side"), *a.columns).unionByName(right.select("bin", F.lit("b").alias("side"), *a.columns))
    return rows.repartitionByRange("bin", "side", key).sortWithinPartitions("bin", "side", key)


def step_candidates(obs: DataFrame, reach: float = 1.0, furthest: float = 125_000.0) -> DataFrame:
    """Pairs of the next step within `reach` degrees and `furthest` metres: step, a (earlier id), b, cost.

    The cost is the root of the squared changes of amplitude and radius, relative to the earlier row, and of the distance.
    """
    obs = obs.select("obs_id", "time", "lon", "lat", "amplitude", "radius_s")
    later = obs.withColumn("time", F.col("time") - 1)
    pairs = near_centres(obs, later, reach, ["time"])
    d = haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    change = lambda c: F.pow(quotient(F.col(f"a_{c}") - F.col(f"b_{c}"), F.col(f"a_{c}")), 2)
    cost = F.sqrt(change("amplitude") + change("radius_s") + F.pow(d / 125_000.0, 2))
    return pairs.withColumn("_d", d).where(F.col("_d") < furthest).select(F.col("a_time").alias("step"), F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), cost.alias("cost"))


def assigned(candidates: DataFrame) -> DataFrame:
    """One-to-one links (step, a, b, cost): the cheapest of a step first, ties by ids, until none is left.

    Runs as rounds of joins: a pair that is the cheapest of both its rows is taken, and the rows' other pairs go. A
    chain of dearer and dearer pairs takes a round each, at most; every round is written out.
    """
    left, taken = written(candidates), None
    key = F.struct("cost", "a", "b")
    while True:
        best = lambda c: F.min(key).over(Window.partitionBy("step", c))
        now = written(left.withColumn("_x", best("a")).withColumn("_y", best("b")).where(F.col("_x") == F.col("_y")).where(key == F.col("_x")).select("step", "a", "b", "cost"))
        taken = now if taken is None else taken.unionByName(now)
        if now.isEmpty():
            return taken
        left = written(left.join(now.select("step", "a").hint("merge"), ["step", "a"], "left_anti").join(now.select("step", "b").hint("merge"), ["step", "b"], "left_anti"))


def in_search_ellipse(minor: float, major: Column | float) -> Column:
    """Whether the later centre lies in an ellipse (degrees) that begins `minor` east of the earlier one and reaches `major` west."""
    dx, dy = F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")
    half = (major + minor) / 2
    off = F.pmod(dx + (major - minor) / 2 + 180, F.lit(360.0)) - 180
    return F.pow(off / half, 2) + F.pow(dy / minor, 2) < 1


def ratios_within(fields: list[str], low: float = 0.4, high: float = 2.5) -> Column:
    out = F.lit(True)
    for c in fields:
        out = out & quotient(F.col(f"b_{c}"), F.col(f"a_{c}")).between(low, high)
    return out


def best_target(pairs: DataFrame) -> DataFrame:
    """Many-to-one links: for each earlier row the pair of least cost, of equal ones the largest amplitude."""
    w = Window.partitionBy("a").orderBy("cost", F.desc("amplitude"), "b")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def nearest_targets(obs: DataFrame, delta: float) -> DataFrame:
    """a, b, cost, amplitude: `best_target` among the rows of a day within delta degrees and of larger ids, by distance in
    longitude. Of each group of rows at one place only the best for a row is shuffled."""
    at = obs.select("obs_id", "time", "lon", "lat", "amplitude")
    groups = near_groups(at, at, delta, ["time"]).withColumn("cost", F.abs(F.col("a_lon") - F.col("b_lon")))
    order = lambda r: F.struct(r.amplitude.isNull().alias("none"), F.when(F.isnan(r.amplitude), -float("inf")).otherwise(-r.amplitude).alias("less"), r.obs_id.alias("b"), r.amplitude.alias("amplitude"))
    groups = groups.withColumn("_best", F.sort_array(F.transform("b_rows", order))).select("cost", "_best", F.explode(F.transform("a_rows", lambda r: r.obs_id)).alias("a"))
    first = groups.select("a", "cost", F.get(F.filter("_best", lambda r: r.b > F.col("a")), 0).alias("x")).where("x is not null")
    return best_target(first.select("a", "x.b", "cost", "x.amplitude"))


def close_tracks(a: DataFrame, b: DataFrame, delta: float, least: int) -> DataFrame:
    """Rows of `b` on tracks that come near rows of `a` on at least so many days."""
    pairs = near_centres(a, b, delta, ["time"])
    near = pairs.groupBy("b_track").agg(F.count_distinct("b_time").alias("days")).where(F.col("days") >= least)
    return b.join(near.select(F.col("b_track").alias("track")), "track", "left_semi")


def same_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of tracks with the same sorted (time, lon, lat), each target used once: a_track, b_track (null without a match)."""
    key = lambda df, n: df.groupBy("track").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("time", "lon", "lat"))).alias("rows")).select(F.col("track").alias(n), "size", F.sha2(F.to_json("rows"), 256).alias("rows"))
    ranked = lambda df, n: df.withColumn("_k", F.row_number().over(Window.partitionBy("size", "rows").orderBy(n)))
    return ranked(key(a, "a_track"), "a_track").join(ranked(key(b, "b_track"), "b_track"), ["size", "rows", "_k"], "left").select("a_track", "b_track")


def match_kinds(pairs: DataFrame, low: float = 0.1, high: float = 0.6) -> DataFrame:
    """a, b, score with kind: low, intermediate or high for single pairs, parent, twin or complex where a side has more."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    both = pairs.withColumns({"_na": n("a"), "_nb": n("b")})
    kind = F.when((F.col("_na") > 1) & (F.col("_nb") > 1), "complex").when(F.col("_na") > 1, "parent").when(F.col("_nb") > 1, "twin")
    kind = F.coalesce(kind, F.when(F.col("score") < low, "low").when(F.col("score") < high, "intermediate").otherwise("high"))
    return both.select("a", "b", "score", kind.alias("kind"))


def kind_counts(obs: DataFrame, half: float, low: float = 0.1, high: float = 0.6) -> DataFrame:
    """kind, n: the pairs of boxes of a day (half: half their width; a the smaller id), counted by `match_kinds`, none of
    them shuffled. A row has several partners of larger ids if the second largest id at the places around is larger than
    its own; so with smaller ones."""
    place = ["time", "lon", "lat"]
    two = lambda c, up: F.slice(F.sort_array(c, up), 1, 2)
    ids = F.collect_list("obs_id")
    at = with_box(obs.groupBy(*place).agg(two(ids, False).alias("top"), two(ids, True).alias("low")), half)
    of = lambda c, up: F.get(two(F.flatten(F.collect_list(c)), up), 1)
    near = expanded(group_pairs(at, at, 1.0, ["time"], more=("lon", "lat")))
    near = near.groupBy(F.col("a_time").alias("time"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")).agg(of("b_top", False).alias("_top"), of("b_low", True).alias("_low"))
    told = obs.select("obs_id", *place).join(near.hint("merge"), place).withColumns({"after": F.coalesce(F.col("obs_id") < F.col("_top"), F.lit(False)), "before": F.coalesce(F.col("obs_id") > F.col("_low"), F.lit(False))})
    told = with_box(told, half).select("obs_id", "after", "before", "time", *BOX)
    score = box_score()
    groups = group_pairs(told, told, 1.0, ["time"]).withColumn("single", F.when(score < low, "low").when(score < high, "intermediate").otherwise("high"))
    pairs = expanded(groups).where("a_obs_id < b_obs_id").groupBy("a_after", "b_before", "single").agg(F.count("*").alias("n"))
    kind = F.when(F.col("a_after") & F.col("b_before"), "complex").when(F.col("a_after"), "parent").when(F.col("b_before"), "twin").otherwise(F.col("single"))
    return pairs.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def unmatched(df: DataFrame, pairs: DataFrame, side: str = "a") -> DataFrame:
    return df.join(pairs.select(F.col(side).alias("obs_id")), "obs_id", "left_anti")


def inside_any(df: DataFrame, polygons: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows whose centre lies in any of the polygons (obs_id, ring). on: equal keys."""
    found = holder(df.select(F.col("obs_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y"), *(on or [])), polygons, on=on).where("obs_id is not null").select(F.col("pid").alias("obs_id"))
    return df.join(found.hint("merge"), "obs_id", "left_semi")


def merged_outline(df: DataFrame, size: float) -> DataFrame:
    """Per track the cells of a fine grid that any of its rings covers: the union of its shapes on that grid."""
    from gyrelake.operators.cells import edge_of

    edge = lambda pick: F.floor(pick(F.transform("ring", lambda p: p["x"])) / size).cast("int")
    wide = df.select("track", "ring", F.explode(F.sequence(edge(F.array_min), edge(F.array_max))).alias("i"))
    wide = wide.withColumn("j", F.explode(F.sequence(edge_of("ring", F.array_min, size), edge_of("ring", F.array_max, size))))
    return wide.where(winding(F.col("ring"), (F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size) != 0).select("track", "i", "j").distinct()


def seeds(df: DataFrame, step: float) -> DataFrame:
    """Points of a mesh inside each ring: obs_id, x, y; the mesh is anchored at multiples of the step. A batch of rings at once."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rings = batch.columns
            points = rings.flatten()
            x, y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
            for ring, px, py in kernels.mesh_inside(x, y, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), step):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(ring)), pa.array(px), pa.array(py)], ["obs_id", "x", "y"])

    return df.select("obs_id", "ring").mapInArrow(inside, f"obs_id {df.schema['obs_id'].dataType.simpleString()}, x double, y double")


def area_candidates(obs: DataFrame, reach: float = 1.0, furthest: float | None = None, least: float = 0.2, digits: int | None = None) -> DataFrame:
    """Pairs of rings of neighbour days: step, a, b, cost, 1 less the shared part of the union, which is
    `least` at least; digits: rounded to so many. For `tracking.day_links`: a tracker by overlap. reach and furthest are not used."""
    later = obs.withColumn("time", F.col("time") - 1)
    found = match(obs.select("obs_id", "time", "ring"), later.select("obs_id", "time", "ring"), "union", least, ["time"], grouped=True)
    found = expanded(found.withColumn("cost", 1 - F.col("score") if digits is None else F.round(1 - F.col("score"), digits)))
    return found.select(F.col("a_time").alias("step"), F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), "cost")


def common_area_cost(pairs: DataFrame) -> DataFrame:
    """Ring pairs of `match(..., "smaller")` with cost: 1 less the shared part of the smaller ring."""
    return pairs.withColumn("cost", 1 - F.col("score"))


def axis_by_latitude(lat: Column, low: float = 1.5, high: float = 10.0, lat1: float = 13.5, lat2: float = 5.0, degrees: bool = False) -> Column:
    """The search ellipse's long axis: `high` up to lat2, `low` from lat1 on, straight between; in km unless degrees."""
    slope = (low - high) / (lat1 - lat2)
    axis = F.when(F.abs(lat) < lat2, high).when(F.abs(lat) > lat1, low).otherwise(slope * (F.abs(lat) - lat1) + low)
    return axis if degrees else axis * 111.2


def crossing_land(pairs: DataFrame, land: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Pairs (a_lon, a_lat, b_lon, b_lat; of rows, or of `near_groups`) without those whose straight way over cells meets one with
    mask 1 in `land` (i, j, mask). A way follows from its two end cells, so it is walked once for all pairs between these."""
    from gyrelake.functions.geo import on_segment_path

    cell = lambda c, c0: F.round((F.col(c) - c0) / step).cast("int")
    ends = {"_i0": cell("a_lon", x0), "_j0": cell("a_lat", y0), "_i1": cell("b_lon", x0), "_j1": cell("b_lat", y0)}
    placed = pairs.withColumns(ends)
    at = placed.select(*ends).distinct().withColumn("_c", F.explode(on_segment_path(*[F.col(c) for c in ends]))).select(*ends, "_c.i", "_c.j")
    bad = at.join(land.where("mask = 1").select("i", "j").hint("merge"), ["i", "j"], "left_semi").select(*ends).distinct()
    return placed.join(bad.hint("merge"), list(ends), "left_anti").select(*pairs.columns)


def _on_sphere(df: DataFrame, id: str) -> DataFrame:
    lon, lat = F.radians("lon"), F.radians("lat")
    return df.select(id, (F.cos(lat) * F.cos(lon)).alias("_x"), (F.cos(lat) * F.sin(lon)).alias("_y"), F.sin(lat).alias("_z"))


def nearest(points: DataFrame, cells: DataFrame, spacing: float | None = None) -> DataFrame:
    """pid, cid, metres: for each point (pid, lon, lat) the nearest of `cells` (cid, lon, lat; any order, no grid needed) on the
    sphere; ties to the smaller cid; points without a place, and all where there is no cell, are left out.

    Both are dealt to cubes of space around the sphere, which has no seam and no poles there. A cell found among a point's
    own and the 26 cubes around is the nearest if it is no further away than a cube is wide; for points without one the
    cubes are doubled, round by round. Points and cells of one place are looked for once. spacing: the first cubes' width in degrees; by default about two cells wide.
    """
    place = ["_x", "_y", "_z"]
    asking = written(_on_sphere(points, "pid").dropna())
    here = written(asking.select(*place).distinct())
    there = written(_on_sphere(cells, "cid").dropna().groupBy(*place).agg(F.min("cid").alias("cid")))
    n = there.count()
    wide = 2 * math.sin(math.radians(spacing) / 2) if spacing else 2 * math.sqrt(4 * math.pi / max(n, 1))
    around = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    out, left = [], here if n else here.limit(0)
    while True:
        cube = lambda c: F.floor(F.col(c) / wide)  # noqa: B023, E731
        asked = left
        for c in "xyz":
            asked = asked.withColumn(f"_d{c}", around).withColumn(f"_k{c}", cube(f"_{c}") + F.col(f"_d{c}")).drop(f"_d{c}")
        at = there.select("cid", *[F.col(f"_{c}").alias(f"_c{c}") for c in "xyz"], *[cube(f"_{c}").alias(f"_k{c}") for c in "xyz"])
        far = sum(((F.col(f"_{c}") - F.col(f"_c{c}")) * (F.col(f"_{c}") - F.col(f"_c{c}")) for c in "yz"), (F.col("_x") - F.col("_cx")) * (F.col("_x") - F.col("_cx")))
        best = asked.join(at.hint("merge"), [f"_k{c}" for c in "xyz"]).groupBy(*place).agg(F.min(F.struct(far.alias("far"), "cid")).alias("best"))
        told = written(left.join(best.hint("merge"), place, "left").withColumn("sure", F.coalesce(F.col("best.far") <= wide * wide, F.lit(False)) | F.lit(wide > 2)))
        out.append(told.where("sure").select(*place, "best.cid", (2 * RADIUS * 1000 * F.asin(F.least(F.sqrt("best.far") / 2, F.lit(1.0)))).alias("metres")))
        left = told.where("not sure").select(*place)
        if wide > 2 or left.isEmpty():
            return asking.join(union_all(out).where("cid is not null").hint("merge"), place).select("pid", "cid", "metres")
        wide *= 2
