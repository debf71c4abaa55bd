"""Statistics on one- and two-dimensional bins. Bins are equal in width, so a row's bin is arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, start: float, width: float, bins: int, closed: bool = True) -> Column:
    """The bin of a value, null outside; the last bin takes its upper edge if closed."""
    k = F.floor((value - start) / width)
    k = F.when((value == start + width * bins), bins - 1).otherwise(k) if closed else k
    return F.when((k >= 0) & (k < bins), k.cast("long"))


def histogram(df: DataFrame, x: str, start: float, width: float, bins: int, y: str | None = None, how: str = "count") -> DataFrame:
    """bin, low edge and value for every bin: count, sum or mean of y, or percent of all rows; empty bins have 0."""
    out = df.withColumn("bin", bin_of(F.col(x), start, width, bins)).where("bin is not null")
    value = {"count": F.count("*").cast("double"), "sum": F.sum(y or x), "mean": F.avg(y or x), "std": F.stddev_pop(y or x), "percent": F.count("*").cast("double")}[how]
    found = out.groupBy("bin").agg(value.alias("value"))
    if how == "percent":
        found = found.crossJoin(F.broadcast(out.agg(F.count("*").alias("_all")))).select("bin", (F.col("value") * 100 / F.col("_all")).alias("value"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(found, "bin", "left").select("bin", (F.col("bin") * float(width) + float(start)).alias("low"), F.coalesce("value", F.lit(0.0)).alias("value"))


def cell(size: float, x: str = "lon", y: str = "lat") -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(n) for c, n in ((x, "i"), (y, "j"))]


def cell_count(df: DataFrame, size: float) -> DataFrame:
    return df.groupBy(*cell(size)).agg(F.count("*").alias("n"))


def cell_mean(df: DataFrame, size: float, field: str) -> DataFrame:
    return df.groupBy(*cell(size)).agg(F.avg(field).alias("mean"))


def cell_percentile(df: DataFrame, size: float, field: str, q: float = 50) -> DataFrame:
    return df.groupBy(*cell(size)).agg(F.percentile(field, q / 100).alias("percentile"))


def cell_share(df: DataFrame, size: float, mask: Column) -> DataFrame:
    """Share of rows in each cell for which the mask holds."""
    return df.groupBy(*cell(size)).agg(F.count("*").alias("n"), F.avg(mask.cast("double")).alias("share"))


def covered_cells(df: DataFrame, size: float, ring: str) -> DataFrame:
    """How many rings cover the centre of each cell: the cells of a ring's box, then the winding of each."""
    from gyrelake.functions.geo import winding

    edge = lambda f, k: F.floor(f(F.transform(ring, lambda p: p[k])) / size).cast("int")
    wide = df.select(F.col(ring).alias("_ring"), F.explode(F.sequence(edge(F.array_min, "x"), edge(F.array_max, "x"))).alias("i"))
    wide = wide.select("_ring", "i", F.explode(F.sequence(edge_of("_ring", F.array_min, size), edge_of("_ring", F.array_max, size))).alias("j"))
    inside = wide.where(winding(F.col("_ring"), (F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size) != 0)
    return inside.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.count("*").alias("n"))


def edge_of(ring: str, pick, size: float) -> Column:
    return F.floor(pick(F.transform(ring, lambda p: p["y"])) / size).cast("int")


def cumulative_share(df: DataFrame, field: str, start: float, width: float, bins: int) -> DataFrame:
    """For each bin the rows in it and above it: the reverse cumulative histogram."""
    from pyspark.sql import Window

    h = histogram(df, field, start, width, bins)
    return h.withColumn("above", F.sum("value").over(Window.orderBy(F.desc("bin"))))  # as many rows as bins
