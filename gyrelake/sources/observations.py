"""Observations from tables: the field registry, readers and writers, packing, and the view over the events table.

An observation is one structure at one date. Rows have a stable `obs_id`; links hold obs_ids, null where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "1950-01-01"
#: Field, name in files, older names, type, stored scale, unit.
FIELDS = [
    ("time", "time", "j1", "double", 1 / 86400, "days"), ("type_cyc", "cyclonic_type", "cyc", "byte", None, ""), ("segment_size", "segment_size", "", "byte", None, ""),
    ("dlon", "dlon", "", "double", None, ""), ("dlat", "dlat", "", "double", None, ""), ("distance_next", "distance_next", "", "float", 50.0, "m"),
    ("virtual", "observation_flag", "virtual", "byte", None, ""), ("cost_association", "cost_association", "", "float", None, ""), ("lon", "longitude", "lon Lon", "double", None, "degrees_east"),
    ("lat", "latitude", "lat Lat", "double", None, "degrees_north"), ("lon_max", "longitude_max", "lon_max", "double", None, "degrees_east"), ("lat_max", "latitude_max", "lat_max", "double", None, "degrees_north"),
    ("amplitude", "amplitude", "A", "float", 0.0001, "m"), ("speed_area", "speed_area", "", "float", None, "m^2"), ("effective_area", "effective_area", "", "float", None, "m^2"),
    ("speed_average", "speed_average", "U", "float", 0.0001, "m/s"), ("uavg_profile", "uavg_profile", "", "array<float>", 0.0001, "m/s"), ("i", "i", "", "int", None, ""), ("j", "j", "", "int", None, ""),
    ("eke", "Teke", "", "float", None, "m^2/s^2"), ("radius_e", "effective_radius", "radius_e Dia", "float", 50.0, "m"), ("radius_s", "speed_radius", "L radius_s", "float", 50.0, "m"),
    ("track", "track", "Eddy_id", "long", None, ""), ("segment", "segment", "", "long", None, ""), ("previous_obs", "previous_obs", "", "int", None, ""), ("next_obs", "next_obs", "", "int", None, ""),
    ("previous_cost", "previous_cost", "", "float", None, ""), ("next_cost", "next_cost", "", "float", None, ""), ("n", "observation_number", "n Eddy_tsp", "int", None, ""),
    ("contour_lon_e", "effective_contour_longitude", "contour_lon_e", "array<float>", 0.01, "degrees_east"), ("contour_lat_e", "effective_contour_latitude", "contour_lat_e", "array<float>", 0.01, "degrees_east"),
    ("num_point_e", "num_point_e", "", "int", None, "ordinal"), ("contour_lon_s", "speed_contour_longitude", "contour_lon_s", "array<float>", 0.01, "degrees_east"),
    ("contour_lat_s", "speed_contour_latitude", "contour_lat_s", "array<float>", 0.01, "degrees_east"), ("num_point_s", "num_point_s", "", "int", None, "ordinal"),
    ("shape_error_e", "effective_contour_shape_error", "shape_error_e", "float", 0.5, "%"), ("score", "score", "", "float", 0.4, "%"), ("index_other", "index_other", "", "long", None, ""),
    ("shape_error_s", "speed_contour_shape_error", "shape_error_s", "float", 0.5, "%"), ("height_max_speed_contour", "speed_contour_height", "height_max_speed_contour", "float", None, "m"),
    ("height_external_contour", "effective_contour_height", "height_external_contour", "float", None, "m"), ("height_inner_contour", "inner_contour_height", "height_inner_contour", "float", None, "m"),
    ("chl", "chl", "Chl", "float", None, "Log(Chl/[mg/m^3])"), ("dchl", "dchl", "dChl", "float", None, "Log(Chl/[mg/m^3])"), ("chl_bg", "chl_bg", "Chl_bg", "float", None, "Log(Chl/[mg/m^3])"),
    ("year", "year", "Year", "int", None, "year"), ("month", "month", "Month", "short", None, "month"), ("day", "day", "Day", "short", None, "day"), ("nb_contour_selected", "num_contours", "nb_contour_selected", "int", None, ""),
]
NAMES = {f[0]: f for f in FIELDS}
ALIASES = {a: f[0] for f in FIELDS for a in (f[1], *f[2].split())}
#: The fields of each kind of table.
OBSERVATION = "time type_cyc lon lat amplitude speed_average radius_e radius_s shape_error_e shape_error_s speed_area effective_area nb_contour_selected num_point_e num_point_s height_max_speed_contour height_external_contour".split()
TRACK = [*OBSERVATION, "track", "n", "virtual"]
NETWORK = [*TRACK, "segment", "next_obs", "previous_obs", "next_cost", "previous_cost"]
VIRTUAL = [*TRACK, "segment_size", "dlon", "dlat"]
#: How many of the second unit one of the first is.
UNITS = {("m", "km"): 0.001, ("km", "m"): 1000.0, ("m", "cm"): 100.0, ("cm", "m"): 0.01, ("m/s", "cm/s"): 100.0, ("cm/s", "m/s"): 0.01, ("m", "m"): 1.0}


def schema(fields: list[str]) -> T.StructType:
    """The struct of named fields; a field that the registry lacks raises KeyError."""
    return T.StructType([T.StructField(f, T._parse_datatype_string(NAMES[f][3]), True, {"unit": NAMES[f][5], "name": NAMES[f][1]}) for f in fields])


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f[0], f[1], f[3], f[4], f[5]) for f in sorted(FIELDS)], "field string, file_name string, type string, scale double, unit string")


def described_fields(df: DataFrame) -> DataFrame:
    """The registry's fields that a table has: field, file_name, unit, and its values' number, least and largest."""
    have = [c for c in df.columns if c in NAMES and not NAMES[c][3].startswith("array")]
    told = df.agg(*[f(c).alias(f"{n}_{c}") for c in have for n, f in (("n", F.count), ("least", F.min), ("most", F.max))])
    rows = [F.struct(F.lit(c).alias("field"), F.lit(NAMES[c][1]).alias("file_name"), F.lit(NAMES[c][5]).alias("unit"), F.col(f"n_{c}").alias("n"), *[F.col(f"{n}_{c}").cast("double").alias(n) for n in ("least", "most")]) for c in have]
    return told.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def converted(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Fields in other units than the registry's: multiplied by the factor between both, with the unit as a note on the column."""
    return df.withColumns({c: (F.col(c) * factor(NAMES[c][5], unit)).alias(c, metadata={"unit": unit}) for c, unit in units.items()})


def with_field_names(df: DataFrame) -> DataFrame:
    """Columns under their field names, whichever file name or older name they have."""
    return df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in df.columns})


def factor(have: str | None, want: str | None) -> float:
    """The factor from one unit to another; 1 where either is missing or unknown."""
    return UNITS.get((have, want), 1.0)


def packed(df: DataFrame) -> DataFrame:
    """Fields with a scale as whole numbers of it."""
    out = {}
    for c in df.columns:
        if c in NAMES and NAMES[c][4] and not NAMES[c][3].startswith("array"):
            out[c] = F.round(F.col(c) / NAMES[c][4]).cast("long")
    return df.withColumns(out) if out else df


def unpacked(df: DataFrame) -> DataFrame:
    out = {c: (F.col(c) * NAMES[c][4]).cast(NAMES[c][3]) for c in df.columns if c in NAMES and NAMES[c][4] and not NAMES[c][3].startswith("array")}
    return df.withColumns(out) if out else df


def load(spark: SparkSession, path: str, include: list[str] | None = None, remove: list[str] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """A table under field names. include wins over remove; both reach the scan as its read schema. rows: an obs_id range."""
    df = with_field_names(spark.read.parquet(path))
    if rows:
        df = df.where(F.col("obs_id").between(rows[0], rows[1] - 1))
    if include:
        missing = [c for c in include if c not in df.columns]
        if missing:
            raise KeyError(f"no such fields: {missing}")
        return df.select(*include)
    return df.drop(*(remove or []))


def save(df: DataFrame, path: str, pack: bool = False) -> None:
    """Parquet with one folder per sign, compressed with zstd."""
    signed = df.withColumn("sign_type", sign_name(F.col("type_cyc"))) if "type_cyc" in df.columns else df
    out = (packed(signed) if pack else signed).write.option("compression", "zstd").mode("overwrite")
    (out.partitionBy("sign_type") if "type_cyc" in df.columns else out).parquet(path)


def sign_name(sign: Column) -> Column:
    return F.when(sign == 1, "Anticyclonic").otherwise("Cyclonic")


def dated(text: Column) -> Column:
    """A date out of a text in one of the three known forms."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "yyyyMMdd")])


def to_date(time: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(time).cast("int"))


def files_by_date(spark: SparkSession, paths: DataFrame, pattern: str = r".*_([0-9]*?)\.[nzp].*", start: str | None = None, end: str | None = None, step: int = 1) -> DataFrame:
    """(path, date, rank) of files whose names hold a date, in order, each `step`th of those between start and end.

    Raises ValueError where the days between neighbours differ. The list of files is small; it sorts as a whole.
    """
    from pyspark.sql import Window

    found = paths.select("path", F.to_date(dated(F.regexp_extract("path", pattern, 1))).alias("date")).where("date is not null")
    found = found.where(F.col("date").between(start or "0001-01-01", end or "9999-12-31"))
    order = Window.orderBy("date", "path")
    found = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") % step == 0).withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    if found.select("gap").distinct().where("gap is not null").count() > 1:
        raise ValueError("the files' dates have no single step")
    return found.select("path", "date", "rank")


def day_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over events: one observation per user and day, coordinates in sixteenths so that sums are exact."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts").cast("date"), F.lit(EPOCH).cast("date"))
    days = events.groupBy(F.col("user_id").alias("track"), day.alias("time")).agg(F.count("*").alias("nb"), F.max("value").alias("amplitude"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("track").orderBy("time")) - 1
    return days.withColumn("n", n.cast("int")).select(
        (F.col("track") * 100000 + F.col("n")).alias("obs_id"), "track", "time", "nb", "amplitude", "n",
        ((F.col("track") * 29) % 96 * 0.25 + (F.col("time") - 27028) * 0.125).alias("lon"),
        (((F.col("track") * 13) % 64) * 0.25 - 8.0 + F.col("nb") * 0.0625).alias("lat"),
        (20000.0 + 2500.0 * F.col("nb")).alias("radius_s"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ring_fields(inner: bool, in_file: bool = False) -> tuple[str, str]:
    """The two fields of the contour of highest speed (inner) or of the outer one, or their names in files."""
    names = ("contour_lon_s", "contour_lat_s") if inner else ("contour_lon_e", "contour_lat_e")
    return tuple(NAMES[n][1] for n in names) if in_file else names


def as_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The columns that another kind of table also has, in its order."""
    return df.select(*[c for c in fields if c in df.columns])


def attributes(df: DataFrame) -> DataFrame:
    """One row about a table: its rows, first and last day, the days covered as a duration, and the signs in it."""
    n = F.max("time") - F.min("time") + 1
    day = lambda c: F.date_format(to_date(c), "yyyy-MM-dd")
    return df.agg(F.count("*").alias("n_obs"), day(F.min("time")).alias("start"), day(F.max("time")).alias("end"), F.concat(F.lit("P"), n.cast("string"), F.lit("D")).alias("duration"))


def is_older(version: Column, own: str) -> Column:
    """Whether a table's version is missing or lower than `own` in its first two numbers."""
    number = lambda c: F.transform(F.slice(F.split(c, r"\."), 1, 2), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return version.isNull() | (number(version) < number(F.lit(own)))


def label(df: DataFrame, template: str) -> DataFrame:
    """One row: the template with {t0}, {t1}, {nb_obs} and {nb_tracks} filled in."""
    facts = df.agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count("*").alias("nb_obs"), F.count_distinct("track").alias("nb_tracks"))
    text = F.lit(template)
    for c in facts.columns:
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return facts.select(text.alias("label"))
