"""Tracks: filters, per-track windows, gap filling and smoothing. Rows need track, time and n; one window per track."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gyrelake.functions.geo import bearing, haversine, wrapped

def by_track():
    return Window.partitionBy("track")


def in_order():
    return by_track().orderBy("time")


def combined(df: DataFrame, *filters: Column | Callable[[DataFrame], Column] | None) -> DataFrame:
    """Rows that pass all filters: columns, functions of the table, or None."""
    conditions = [f(df) if callable(f) and not isinstance(f, Column) else f for f in filters if f is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def in_box(df: DataFrame, west: float, east: float, south: float = -90.0, north: float = 90.0) -> DataFrame:
    """Strictly inside on all sides, longitudes wrapped from the west edge."""
    lon = wrapped(F.col("lon"), west)
    return df.where((lon > west) & (lon < east) & (F.col("lat") > south) & (F.col("lat") < north))


def in_period(df: DataFrame, start: float = 0, end: float = 0) -> DataFrame:
    """Inclusive. Positive bounds are times, negative ones count from the table's first and last time, 0 is open."""
    if start < 0 or end < 0:
        first, last = df.agg(F.min("time"), F.max("time")).first()
        if first is None:
            return df
        start = first - start if start < 0 else start
        end = last + end if end < 0 else end
    return combined(df, F.col("time") >= start if start else None, F.col("time") <= end if end else None)


def each_step(df: DataFrame, t0: float, step: float) -> DataFrame:
    return df.where(F.pmod(F.col("time") - t0, F.lit(step)) == 0)


def with_ids(df: DataFrame, ids: DataFrame, key: str = "track", others: bool = False) -> DataFrame:
    """Rows whose key is in `ids`, or all others."""
    return df.join(ids.select(key), key, "left_anti" if others else "left_semi")


def masked(df: DataFrame, mask: Column, whole: bool = False, drop_partial: bool = False, dense: bool = False, real_only: bool = False) -> DataFrame:
    """Rows where mask holds. whole: all rows of a track that has one; drop_partial: only tracks all of whose rows have it
    (whole wins); real_only: virtual rows are no hits; dense: new track ids from 1 in order."""
    hit = mask & (F.col("virtual") == 0) if real_only else mask
    out = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if whole:
        out = out.withColumn("_hit", F.bool_or("_hit").over(by_track()))
    elif drop_partial:
        out = out.withColumn("_hit", F.bool_and("_hit").over(by_track()))
    out = out.where("_hit").drop("_hit")
    return renumbered(out, "track", 1) if dense else out


def numbered(ids: DataFrame, keys: list[str], into: str, start: int = 0) -> DataFrame:
    """Distinct rows with dense numbers in the order of the keys. Rows are sorted in ranges, and each range's rows counted;
    only those counts, one a range, meet in one place. Ranges are written first, as they are drawn from a sample."""
    from gyrelake.sources.tables import written

    sorted_ = ids.distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = written(sorted_.withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.col("_ahead") + F.col("_m") - F.shiftleft("_part", 33) + start
    return at.join(F.broadcast(ahead), "_part").select(*ids.columns, number.cast("long").alias(into))


def renumbered(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """Dense new ids in the order of the old ones; the ids are ranked apart from the rows."""
    new = numbered(df.select(key), [key], "_new", start)
    return df.join(new, key).withColumn(key, F.col("_new")).drop("_new").select(*df.columns)


def by_length(df: DataFrame, least: int = -1, most: int = -1) -> DataFrame:
    """Tracks by number of observations; -1 is open."""
    if least < 0 and most < 0:
        raise ValueError("one bound is needed")
    n = df.groupBy("track").agg(F.count("*").alias("_n"))
    return with_ids(df, combined(n, F.col("_n") >= least if least >= 0 else None, F.col("_n") <= most if most >= 0 else None))


def ends(df: DataFrame) -> DataFrame:
    """One row per track: count, first and last time and place."""
    pick = lambda f, c: f(c, "time")
    return df.groupBy("track").agg(F.count("*").alias("n_obs"), F.min("time").alias("t0"), F.max("time").alias("t1"), *[pick(f, c).alias(f"{c}{k}") for c in ("lon", "lat") for f, k in ((F.min_by, 0), (F.max_by, 1))])


def toward(df: DataFrame, west: bool = True, least: float = 0.0) -> DataFrame:
    """Tracks whose last place lies west (or east) of the first by more than `least` degrees."""
    d = F.col("lon1") - F.col("lon0")
    return with_ids(df, ends(df).where((-d if west else d) > least))


def first_in_cells(df: DataFrame, size: float) -> DataFrame:
    """The first row of every track in every cell."""
    cell = [(F.col(c) - F.pmod(F.col(c), F.lit(size))).alias(f"_{c}") for c in ("lon", "lat")]
    w = Window.partitionBy("track", *cell).orderBy("time", "obs_id")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_and_last(df: DataFrame) -> DataFrame:
    return df.withColumn("_next", F.lead("n").over(in_order())).where("n = 0 or _next is null").drop("_next")


def present_on(df: DataFrame, date: float, days: float) -> DataFrame:
    """Tracks with an observation on a date and one exactly so many days later."""
    ids = df.groupBy("track").agg(F.bool_or(F.col("time") == date).alias("a"), F.bool_or(F.col("time") == date + days).alias("b")).where("a and b")
    return with_ids(df, ids)


def with_distance(df: DataFrame) -> DataFrame:
    """distance_next: metres to the track's next row, 0 at its end."""
    nxt = lambda c: F.lead(c).over(in_order())
    return df.withColumn("distance_next", F.coalesce(haversine(F.col("lon"), F.col("lat"), nxt("lon"), nxt("lat")), F.lit(0.0)))


def running_sum(df: DataFrame, field: str, into: str) -> DataFrame:
    return df.withColumn(into, F.sum(field).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def run_length(df: DataFrame, mask: Column, into: str) -> DataFrame:
    """How many rows in a row have held the mask, up to and with this one."""
    hit = mask.cast("int")
    out = df.withColumn("_hit", F.coalesce(hit, F.lit(0))).withColumn("_island", F.sum(1 - F.col("_hit")).over(in_order()))
    return out.withColumn(into, F.sum("_hit").over(Window.partitionBy("track", "_island").orderBy("time"))).drop("_hit", "_island")


def with_lifetime(df: DataFrame) -> DataFrame:
    """lifetime: rows of the track; age: percent of it, null for a single row."""
    n = F.count("*").over(by_track())
    return df.withColumn("lifetime", n).withColumn("age", F.when(n > 1, F.col("n") * 100.0 / (n - 1)))


def loess(df: DataFrame, half: float, x: str, y: str, into: str) -> DataFrame:
    """Tricube-weighted mean of y over rows of the track nearer than `half` in x."""
    near = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(by_track().orderBy(x).rangeBetween(-half, half))
    weight = lambda p: F.pow(1 - F.pow(F.abs(p.x - F.col(x)) / half, 3), 3)
    inside = lambda f: F.aggregate("_near", F.lit(0.0), lambda s, p: s + F.when(F.abs(p.x - F.col(x)) < half, f(p)).otherwise(0.0))
    return df.withColumn("_near", near).withColumn(into, inside(lambda p: weight(p) * p.y) / inside(weight)).drop("_near")


def median(df: DataFrame, half: float, x: str, y: str, into: str) -> DataFrame:
    """Median of y over rows of the track within `half` in x, both ends in."""
    values = F.sort_array(F.collect_list(y).over(by_track().orderBy(x).rangeBetween(-half, half)))
    out = df.withColumn("_v", values)
    n = F.size("_v")
    return out.withColumn(into, (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2).drop("_v")


def smooth_positions(df: DataFrame, median_half: float, loess_half: float) -> DataFrame:
    """Longitudes, then latitudes: median, then loess over time."""
    for c in ("lon", "lat"):
        df = loess(median(df, median_half, "time", c, c), loess_half, "time", c, c)
    return df


def with_gaps_filled(df: DataFrame) -> DataFrame:
    """Rows for the steps that a track leaves out, flagged virtual; a track's step is its median gap. Times that are whole
    numbers stay whole: a step of a day and a half goes to the nearest day, from the middle to the even one."""
    gaps = df.withColumn("_gap", F.lead("time").over(in_order()) - F.col("time"))
    step = gaps.groupBy("track").agg(F.median("_gap").alias("_step"))
    missing = gaps.join(step, "track").where("_gap > _step").withColumn("_k", F.explode(F.sequence(F.lit(1), F.floor(F.col("_gap") / F.col("_step")).cast("int") - 1)))
    kind, at = df.schema["time"].dataType, F.col("time") + F.col("_k") * F.col("_step")
    missing = missing.where("_gap >= 2 * _step").select("track", (F.rint(at) if isinstance(kind, IntegralType) else at).cast(kind).alias("time"), F.lit(1).alias("virtual"))
    return df.withColumn("virtual", F.lit(0)).unionByName(missing, allowMissingColumns=True)


def interpolated(df: DataFrame, fields: list[str]) -> DataFrame:
    """Virtual rows filled between their neighbours in the track, by row position."""
    out = df.withColumn("_r", F.row_number().over(in_order()).cast("double"))
    before, after = in_order().rowsBetween(Window.unboundedPreceding, -1), in_order().rowsBetween(1, Window.unboundedFollowing)
    real = lambda c: F.when(F.col("virtual") == 0, F.col(c))
    for c in fields:
        a, b = F.last(real(c), True).over(before), F.first(real(c), True).over(after)
        ra, rb = F.last(real("_r"), True).over(before), F.first(real("_r"), True).over(after)
        out = out.withColumn(c, F.when(F.col("virtual") == 1, a + (b - a) * (F.col("_r") - ra) / (rb - ra)).otherwise(F.col(c)))
    return out.drop("_r")


def azimuth(df: DataFrame, equatorward: bool = False) -> DataFrame:
    """track and the bearing from its first to its last place; equatorward: south of the equator the sign is turned."""
    e = ends(df)
    a = bearing(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"))
    return e.select("track", F.when(F.col("lat0") < 0, -a).otherwise(a).alias("azimuth") if equatorward else a.alias("azimuth"))


def unwrapped(df: DataFrame, key: str = "track") -> DataFrame:
    """Longitudes within half a turn of the first one of the track or network."""
    first = F.first("lon").over(Window.partitionBy(key).orderBy("time", "obs_id"))
    return df.withColumn("lon", wrapped(F.col("lon"), first - 180))


def summary(df: DataFrame) -> DataFrame:
    """One row per track: observations, span, length of its path, extremes and spread of amplitude and radius."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("amplitude", "radius_s") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    return with_distance(df).groupBy("track").agg(F.count("*").alias("n_obs"), (F.max("time") - F.min("time") + 1).alias("span"), F.sum("distance_next").alias("path"), *stats)


def window_groups(df: DataFrame, centres: DataFrame, width: float) -> DataFrame:
    """Rows of every moving window (centre - width, centre + width]; centres: a table with centre. Cells of the width bound the join."""
    cell = lambda c: F.floor(c / (2 * width))
    near = centres.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("centre") - width), cell(F.col("centre") + width)))))
    return df.withColumn("_cell", cell(F.col("time"))).join(near, "_cell").where((F.col("time") > F.col("centre") - width) & (F.col("time") <= F.col("centre") + width)).drop("_cell")


def normalised_profile(df: DataFrame, field: str, slots: int = 20) -> DataFrame:
    """Mean of a field by slot of normalised life, each track linearly interpolated and weighing the same."""
    life = F.count("*").over(by_track())
    pos = df.withColumn("_life", life).where("_life > 1").withColumn("_next", F.lead(field).over(in_order()))
    span = pos.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots)))).withColumn("_at", F.col("slot") * (F.col("_life") - 1.0) / slots)
    here = span.where(((F.col("_at") >= F.col("n")) & (F.col("_at") < F.col("n") + 1)))
    value = F.col(field) + F.coalesce((F.col("_next") - F.col(field)) * (F.col("_at") - F.col("n")), F.lit(0.0))
    return here.groupBy("slot").agg(F.avg(value).alias("mean"), F.count("*").alias("tracks"))


def inserted(df: DataFrame, other: DataFrame, at: int, place: str = "pos") -> DataFrame:
    """`other`'s rows between those of `df`: both have whole places from 0, and the result has them anew. A negative place
    counts from the end. Tables of different columns raise ValueError."""
    if set(df.columns) != set(other.columns):
        raise ValueError("the tables have different columns")
    more, own = other.agg(F.count("*").alias("_more")), df.agg(F.count("*").alias("_own"))
    start = F.lit(at) if at >= 0 else F.col("_own") + at
    moved = df.crossJoin(F.broadcast(more)).crossJoin(F.broadcast(own)).withColumn(place, F.when(F.col(place) >= start, F.col(place) + F.col("_more")).otherwise(F.col(place)))
    new = other.crossJoin(F.broadcast(own)).withColumn(place, F.col(place) + start)
    return moved.select(*df.columns).unionByName(new.select(*df.columns))


def first_places(rows: DataFrame, items: DataFrame, key: str, place: str = "pos") -> DataFrame:
    """Each distinct item with the first place of its value in `rows`; null where it has none."""
    return items.select(key).distinct().join(rows.groupBy(key).agg(F.min(place).alias(place)), key, "left")


def light(df: DataFrame, mask: Column, more: list[str] | None = None) -> DataFrame:
    """Rows of a mask with time and rings only, and the columns of `more`: what a scan need not read, it does not."""
    return df.where(mask).select("time", *[c for c in df.columns if c.startswith(("ring", "contour_"))], *(more or []))
