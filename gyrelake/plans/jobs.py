"""Whole runs from tables to tables: detection, tracking with a saved state, networks, subsets, translation.

Each reads what the one before has written, so a run is a chain of Spark jobs, and any of them can be repeated alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrelake.operators import detection, grids, networks, tracking, tracks
from gyrelake.sources import observations as src


def identify(spark: SparkSession, grid_path: str, height: str, out_path: str, limits: detection.Limits | None = None, times: tuple[float, float] | None = None, area: dict | None = None) -> None:
    """Closed features of a saved grid (height, u, v), as a table by time. area: lon and lat bounds."""
    grid = grids.load_grid(spark, grid_path, [height, "u", "v"], times, **(area or {}))
    found = detection.detect(grid, height, limits or detection.Limits())
    found.write.mode("overwrite").partitionBy("t").parquet(out_path)


def track(spark: SparkSession, obs_path: str, out_path: str, state_path: str | None = None, most_gap: int = 3, least: int = 10) -> None:
    """Tracks (obs_id, time, track) of a table of observations, in folders by class: untracked (a single row), short (fewer
    than `least` rows) and long. state_path: open ends are read there if there are any, and left there for the next run; the
    rows to track must lie after them, and classes count the rows of this run."""
    tracker = {"kind": "fold", "most_gap": most_gap}
    obs = src.with_field_names(spark.read.parquet(obs_path))
    try:
        state = tracking.load_state(spark, state_path, tracker) if state_path else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        state = None
    rows, ends = tracking.fold(obs, most_gap, state=state)
    n = rows.groupBy("track").agg(F.count("*").alias("_n"))
    kind = F.when(F.col("_n") == 1, "untracked").when(F.col("_n") < least, "short").otherwise("long")
    rows.join(n, "track").select("obs_id", "time", "track", kind.alias("class")).write.mode("overwrite").partitionBy("class").parquet(out_path)
    if state_path and ends is not None:
        tracking.save_state(ends, state_path, tracker)


def link(spark: SparkSession, obs_path: str, out_path: str, linker=tracking.day_links) -> None:
    """Links (step, a, b, cost) of neighbour days of a table of observations, as a table."""
    linker(src.with_field_names(spark.read.parquet(obs_path))).write.mode("overwrite").parquet(out_path)


def rebuild(spark: SparkSession, obs_path: str, links_path: str, out_path: str, least: int = 28) -> None:
    """Tracks of `least` rows at least from a table of observations and saved links: the rows with track, n and cost."""
    obs = src.with_field_names(spark.read.parquet(obs_path))
    whole = tracking.as_tracks(obs, spark.read.parquet(links_path))
    renumbered = tracks.renumbered(tracking.by_length(whole, least), "track")
    renumbered.write.mode("overwrite").parquet(out_path)


def group(spark: SparkSession, obs_path: str, out_path: str, window: int = 5, delta: float | None = None, least: float = 0.2) -> None:
    """Networks of a table of observations, cut into segments: track, segment, links, by overlap (ring) or centres (delta)."""
    obs = src.with_field_names(spark.read.parquet(obs_path))
    edges = networks.time_edges(obs, window, delta, least)
    networks.segmented(networks.grouped(obs, edges), edges).write.mode("overwrite").parquet(out_path)


def subset(spark: SparkSession, path: str, out_path: str, *filters: Column, include: list[str] | None = None, least: int | None = None) -> None:
    """Rows of a table that pass the filters, of tracks of `least` rows at least."""
    out: DataFrame = tracks.combined(src.load(spark, path, include), *filters)
    src.save(tracks.by_length(out, least) if least else out, out_path)


def translate(spark: SparkSession, path: str, out_path: str, pack: bool = False) -> None:
    """A table under field names, packed as whole numbers of its scales if asked for."""
    src.save(src.load(spark, path), out_path, pack)


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row for two sets of networks over the same rows (obs_id, track, segment): how many networks, and segments, of
    each there are, and how many of the first have the same rows in the second."""
    def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.xxhash64("obs_id").cast("decimal(38,0)")).alias("rows"))

    out = None
    for name, keys in (("networks", ["track"]), ("segments", ["track", "segment"])):
        a, b = keyed(first, keys), keyed(second, keys)
        same = a.join(b.select("n", "rows"), ["n", "rows"], "left_semi")
        row = a.agg(F.count("*").alias(name)).crossJoin(b.agg(F.count("*").alias(f"other_{name}"))).crossJoin(same.agg(F.count("*").alias(f"same_{name}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"rows_in_same_{name}")))
        out = row if out is None else out.crossJoin(row)
    return out
