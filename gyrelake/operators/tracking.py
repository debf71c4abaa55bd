"""Links from day to day, and tracks from links: identities, short absences bridged by virtual rows, restarts, stitching.

Links that need no virtual rows follow from pairs of days alone (`day_links`), and become tracks as lines of links.
Absences need the ends of the day before, virtual ones too; `fold` takes blocks of days on side by side, a day of all blocks
at a time, and hands their open ends over until nothing changes at their borders. `gyrelake.streaming.tracker` does the
same over a stream.
"""

from __future__ import annotations

import math
import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.functions.geo import haversine, quotient
from gyrelake.operators.closest import closest, ellipse_cost, linked
from gyrelake.operators.networks import heads
from gyrelake.operators.pairs import assigned, axis_by_latitude, crossing_land, in_search_ellipse, near_centres
from gyrelake.operators.tracks import renumbered
from gyrelake.sources.tables import shared_folder, written

FIELDS = ["obs_id", "time", "lon", "lat", "amplitude", "radius_s"]


def day_links(obs: DataFrame, reach: float = 1.0, furthest: float = 125_000.0, candidates=None) -> DataFrame:
    """step, a, b, cost: one-to-one links between neighbour days, of `pairs.step_candidates`; a function of candidates is another
    tracker, whose candidates are a table."""
    return assigned(candidates(obs, reach, furthest)) if candidates else linked(obs, reach, furthest)


def distance_candidates(obs: DataFrame, minor: float = 1.05, major: float = 1.5, land: tuple | None = None) -> DataFrame:
    """step, a, b, cost (metres), amplitude (of a): rows of the next day within an ellipse that reaches `minor` degrees, and
    to the west from `minor` (beyond 23 degrees of latitude) to `major` (below 5), with amplitude and radius within a factor of
    2.5, whose way crosses no land. land: (table of i, j, mask; x0; y0; step)."""
    later = obs.withColumn("time", F.col("time") - 1)
    near = near_centres(obs.select(*FIELDS), later.select(*FIELDS), 2 * major, ["time"])
    axis = axis_by_latitude(F.col("a_lat"), minor, major, 23.0, 5.0, degrees=True)
    alike = lambda c: (quotient(F.col(f"b_{c}"), F.col(f"a_{c}")) > 1 / 2.5) & (quotient(F.col(f"b_{c}"), F.col(f"a_{c}")) < 2.5)
    near = near.where(in_search_ellipse(minor, axis) & alike("amplitude") & alike("radius_s"))
    near = crossing_land(near, *land) if land else near
    d = haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return near.select(F.col("a_time").alias("step"), F.col("a_obs_id").alias("a"), F.col("b_obs_id").alias("b"), d.alias("cost"), F.col("a_amplitude").alias("amplitude"))


def distance_links(obs: DataFrame, reach: float | None = None, furthest: float | None = None, land: tuple | None = None) -> DataFrame:
    """step, a, b, cost: a tracker by distance. Every row goes to its nearest candidate (ties: the smaller id); of several that
    go to one, that of the largest amplitude stays (ties: the smaller id). reach and furthest are not used."""
    if land:
        c = distance_candidates(obs, land=land)
        first = c.groupBy("step", "a").agg(F.min(F.struct("cost", "b", "amplitude")).alias("x")).select("step", "a", "x.*")
    else:
        found = closest(obs, obs, 1.05 * 1.5, partial(ellipse_cost, 1.05, 1.5))
        first = found.select(F.col("step").cast(obs.schema["time"].dataType).alias("step"), "a", "b", "cost", "amplitude")
    kept = first.groupBy("step", "b").agg(F.max(F.struct("amplitude", (-F.col("a")).alias("a"), "cost")).alias("x"))
    return kept.select("step", (-F.col("x.a")).alias("a"), "b", "x.cost")


def assigned_in_order(candidates: DataFrame) -> DataFrame:
    """One-to-one links (step, a, b, cost): rows of a step in order of their ids, each takes its cheapest candidate that no
    row before it has taken (ties: the smaller id).

    Runs as rounds of offers: each row asks its cheapest candidate that has not refused it, which keeps the first of those
    that ask; refusals are final, so the outcome is that of the order.
    """
    left = written(candidates.select("step", "a", "b", "cost"))
    while True:
        asked = left.groupBy("step", "a").agg(F.min(F.struct("cost", "b")).alias("x")).select("step", "a", "x.cost", "x.b")
        kept = asked.groupBy("step", "b").agg(F.min("a").alias("_first"))
        told = written(asked.join(kept.hint("merge"), ["step", "b"]).select("step", "a", "b", "cost", (F.col("a") == F.col("_first")).alias("_taken")))
        refused = told.where("not _taken").select("step", "a", "b")
        if refused.isEmpty():
            return told.select("step", "a", "b", "cost")
        left = written(left.join(refused.hint("merge"), ["step", "a", "b"], "left_anti"))


def _lines(links: DataFrame) -> DataFrame:
    """obs_id, head of all rows that links (a, b; one-to-one) name."""
    rest = heads(links.select(F.col("b").alias("obs_id"), F.col("a").alias("prev_id")))
    first = links.select(F.col("a").alias("obs_id")).join(links.select(F.col("b").alias("obs_id")).hint("merge"), "obs_id", "left_anti")
    return rest.unionByName(first.select("obs_id", F.col("obs_id").alias("head")))


def as_tracks(obs: DataFrame, links: DataFrame) -> DataFrame:
    """obs with track (from 0, in order of first rows), n and cost (on the earlier row); rows never linked are left out."""
    rows = obs.drop("track", "n").join(_lines(links).hint("merge"), "obs_id").join(links.select(F.col("a").alias("obs_id"), "cost").hint("merge"), "obs_id", "left")
    return renumbered(rows.withColumnRenamed("head", "track"), "track").withColumn("n", (F.row_number().over(Window.partitionBy("track").orderBy("time")) - 1).cast("int"))


def unused(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that no link names."""
    ids = links.select(F.explode(F.array("a", "b")).alias("obs_id"))
    return obs.join(ids, "obs_id", "left_anti")


def dead(links: DataFrame, step: int) -> DataFrame:
    """Rows reached at the step before and not gone on from at this one."""
    return links.where(F.col("step") == step - 1).select(F.col("b").alias("obs_id")).join(links.where(F.col("step") == step).select(F.col("a").alias("obs_id")), "obs_id", "left_anti")


def lengths(links: DataFrame) -> DataFrame:
    """track (obs_id of its first row) and its number of rows."""
    return _lines(links).groupBy(F.col("head").alias("track")).agg(F.count("*").alias("n_obs"))


def by_length(tracks: DataFrame, least: int | None = None, below: int | None = None) -> DataFrame:
    """Tracks of `least` rows or more, or of fewer than `below`."""
    n = tracks.groupBy("track").agg(F.count("*").alias("_n"))
    keep = n.where((F.col("_n") >= least if least is not None else F.lit(True)) & (F.col("_n") < below if below is not None else F.lit(True)))
    return tracks.join(keep.select("track"), "track", "left_semi")


def stitched(first: DataFrame, second: DataFrame, shared: int) -> DataFrame:
    """Links of two runs that share a step: the first's up to it, the second's from it on."""
    return first.where(F.col("step") < shared).unionByName(second.where(F.col("step") >= shared))


def _extended(ends: DataFrame, most: int) -> DataFrame:
    """Ends one day on: moved by the last displacement, everything else kept, while the absence is short enough."""
    moved = ends.withColumns({"lon": F.col("lon") + F.col("dlon"), "lat": F.col("lat") + F.col("dlat"), "time": F.col("time") + 1, "gap": F.col("gap") + 1, "obs_id": -F.abs("obs_id")})
    return moved.where(F.col("gap") <= most)


def fold(obs: DataFrame, most_gap: int = 3, reach: float = 1.0, furthest: float = 125_000.0, state: DataFrame | None = None, block: int | None = None, linker=day_links) -> tuple[DataFrame, DataFrame | None]:
    """(rows with track, open ends). Each day is linked with the open ends of the day before, virtual ones too: an end that
    finds no row moves on by its last displacement for `most_gap` days at most. A track has the id of its first row.

    Days are dealt into blocks (of about the root of their number), and a step takes a day of all blocks at once, in the
    same joins. At first every block begins from the rows of the day before it; when all are through, blocks whose ends
    coming in are not what the block before has left are done again, until none is. The table is written once, by day of
    block, and read once a round. Rounds are at most as many as blocks; where tracks end or settle within a block it takes two
    or three. linker: links of neighbour days, (obs, reach, furthest) -> step, a, b, cost.

    The open ends are one row per live track: what a later run needs to go on (`state`).
    """
    spark = obs.sparkSession
    bounds = obs.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    if bounds["first"] is None:
        return obs.select("obs_id", "time", F.lit(None).cast("long").alias("track")), state
    first, last = bounds["first"] if state is None else state.agg(F.max("time")).first()[0] + 1, bounds["last"]
    days = last - first + 1
    block = max(3, block or math.isqrt(days) + 1)  # days of neighbour blocks must not be neighbours in a step
    blocks = -(-days // block)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    dealt = obs.select(*FIELDS).withColumns({"block": F.floor((F.col("time") - first) / block).cast("int"), "slot": F.pmod(F.col("time") - first, F.lit(block)).cast("int")})
    dealt.write.partitionBy("slot").parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path)
    columns = [*FIELDS, "block", "dlon", "dlat", "gap"]
    none = {"dlon": F.lit(0.0), "dlat": F.lit(0.0), "gap": F.lit(0)}
    guess = table.where((F.col("slot") == block - 1) & (F.col("block") < blocks - 1)).withColumn("block", F.col("block") + 1).withColumns(none).select(columns)
    incoming = guess if state is None else guess.unionByName(state.withColumn("block", F.lit(0)).select(columns))
    incoming = written(incoming)
    todo = written(spark.range(blocks).select(F.col("id").cast("int").alias("block")))
    links, final = None, None
    while True:
        ends, made = incoming.join(todo, "block", "left_semi").select(columns), []
        for slot in range(min(block, days)):
            now = table.where(F.col("slot") == slot).join(todo, "block", "left_semi").select(*FIELDS, "block")
            found = linker(ends.select(*FIELDS).unionByName(now.select(*FIELDS)), reach, furthest).select("step", "a", "b", "cost")
            found = written(found.withColumn("block", F.floor((F.col("step") + 1 - first) / block).cast("int")))
            made.append(found)
            # an end may be live in two blocks at once
            old = ends.select("block", F.col("obs_id").alias("a"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
            met = now.join(found.select("block", "a", F.col("b").alias("obs_id")), ["block", "obs_id"], "left").join(old, ["block", "a"], "left")
            current = met.withColumns({"dlon": F.coalesce(F.col("lon") - F.col("_x"), F.lit(0.0)), "dlat": F.coalesce(F.col("lat") - F.col("_y"), F.lit(0.0)), "gap": F.lit(0)}).select(columns)
            lost = ends.join(found.select("block", F.col("a").alias("obs_id")), ["block", "obs_id"], "left_anti").select(columns)
            ends = written(current.unionByName(_extended(lost, most_gap).select(columns)))
            if slot == (last - first) % block and not todo.where(F.col("block") == blocks - 1).isEmpty():
                final = ends.where(F.col("block") == blocks - 1)
        new = reduce(DataFrame.unionByName, made)
        links = written(new if links is None else links.join(todo, "block", "left_anti").select(new.columns).unionByName(new))
        left = ends.where(F.col("block") < blocks - 1).withColumn("block", F.col("block") + 1).select(columns)
        had = incoming.join(todo.select((F.col("block") + 1).alias("block")), "block", "left_semi").select(columns)
        todo = written(left.exceptAll(had).unionByName(had.exceptAll(left)).select("block").distinct())
        if todo.isEmpty():
            break
        incoming = written(incoming.join(todo, "block", "left_anti").select(columns).unionByName(left.join(todo, "block", "left_semi").select(columns)))
    line = heads(links.select(F.col("b").alias("obs_id"), F.abs("a").alias("prev_id")))
    known = state.select(F.abs("obs_id").alias("head"), F.col("track").alias("_before")) if state is not None else spark.createDataFrame([], "head long, _before long")
    named = table.select("obs_id", "time").join(line, "obs_id", "left").withColumn("head", F.coalesce("head", "obs_id")).join(known, "head", "left")
    rows = written(named.select("obs_id", "time", F.coalesce("_before", "head").alias("track")))
    of = rows.select(F.col("obs_id").alias("_id"), "track").unionByName(known.select(F.col("head").alias("_id"), F.col("_before").alias("track")))
    return rows, written(final.drop("block").join(of, F.abs("obs_id") == F.col("_id")).drop("_id"))


def save_state(ends: DataFrame, path: str, tracker: dict) -> None:
    """The open ends of a run, with the tracker's parameters as a note on every file's schema."""
    ends.withColumn("track", F.col("track").alias("track", metadata={"tracker": tracker})).write.mode("overwrite").parquet(path)


def load_state(spark, path: str, tracker: dict) -> DataFrame:
    """Open ends to go on from; ValueError where another tracker, or one with other parameters, has left them."""
    ends = spark.read.parquet(path)
    have = ends.schema["track"].metadata.get("tracker")
    if have != tracker:
        raise ValueError(f"the state was left by {have}, not {tracker}")
    return ends
