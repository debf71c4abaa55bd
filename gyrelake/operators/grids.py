"""Gridded fields as long tables (t, i, j, lon, lat, values): derivatives, currents, filters, interpolation, spectra.

Masked cells are null. A grid's size is fixed by its resolution; a table grows with time, and every operator works per
time, or per row or column of one, so it spreads over times and rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.functions import kernels
from gyrelake.functions.geo import GRAVITY, RADIUS, coriolis


def differences(grid: DataFrame, field: str, into: str, axis: str = "i", size: int | None = None) -> DataFrame:
    """Half the difference of both neighbours on an axis; one-sided where one is missing, null without any.

    size: the number of cells around a circular axis.
    """
    other = "j" if axis == "i" else "i"
    if size:  # halo rows make the ring a line
        halo = F.explode(F.when(F.col(axis) == 0, F.array(F.lit(0), F.lit(size))).when(F.col(axis) == size - 1, F.array(F.lit(0), F.lit(-size))).otherwise(F.array(F.lit(0))))
        grid = grid.withColumn("_turn", halo).withColumn("_at", F.col(axis) + F.col("_turn"))
    else:
        grid = grid.withColumns({"_turn": F.lit(0), "_at": F.col(axis)})
    here = F.col(field)
    line = Window.partitionBy("t", other).orderBy("_at")
    left, right = F.first(field).over(line.rangeBetween(-1, -1)), F.first(field).over(line.rangeBetween(1, 1))
    value = F.when(here.isNotNull(), F.coalesce((right - left) / 2, right - here, here - left))
    return grid.withColumn(into, value).where("_turn = 0").drop("_turn", "_at")


#: Weights of the centred stencils by half width, at distances 1, 2, 3, 4.
STENCILS = {1: [1 / 2], 2: [8 / 12, -1 / 12], 3: [45 / 60, -9 / 60, 1 / 60], 4: [672 / 840, -168 / 840, 32 / 840, -3 / 840]}


def stencil(grid: DataFrame, field: str, into: str, axis: str = "i", half: int = 4) -> DataFrame:
    """Derivative per cell by the widest centred stencil whose cells all have values, else one-sided, else null."""
    other = "j" if axis == "i" else "i"
    line = Window.partitionBy("t", other).orderBy(axis)
    at = lambda k: F.first(field).over(line.rangeBetween(k, k))
    wide = [sum(w * (at(k + 1) - at(-k - 1)) for k, w in enumerate(STENCILS[h])) for h in range(half, 0, -1)]
    here = F.col(field)
    return grid.withColumn(into, F.when(here.isNotNull(), F.coalesce(*wide, at(1) - here, here - at(-1))))


def with_currents(grid: DataFrame, height: str, step: float, half: int = 4) -> DataFrame:
    """u and v (m/s) in balance with the height field's slope; step: the grid's degrees a cell."""
    per_cell = np.pi / 180 * RADIUS * 1000 * step
    out = stencil(stencil(grid, height, "_dx", "i", half), height, "_dy", "j", half)
    f = F.nullif(coriolis(F.col("lat")), F.lit(0.0))  # no balance on the equator itself
    return out.withColumns({"u": -GRAVITY / f * F.col("_dy") / per_cell, "v": GRAVITY / f * F.col("_dx") / (per_cell * F.cos(F.radians("lat")))}).drop("_dx", "_dy")


def equator_weight(lat: Column, scale: float = 2.2) -> Column:
    """The share of the ordinary balance in a blend with the equatorial one."""
    return 1 - F.exp(-F.pow(lat / scale, 2))


def okubo_weiss(grid: DataFrame, step: float) -> DataFrame:
    """ow: squared strain less squared vorticity of u and v."""
    per_cell = np.pi / 180 * RADIUS * 1000 * step
    for c in "uv":
        grid = stencil(stencil(grid, c, f"_{c}x", "i", 1), c, f"_{c}y", "j", 1)
    x, y = per_cell * F.cos(F.radians("lat")), F.lit(per_cell)
    ux, vx, uy, vy = F.col("_ux") / x, F.col("_vx") / x, F.col("_uy") / y, F.col("_vy") / y
    ow = F.pow(ux - vy, 2) + F.pow(vx + uy, 2) - F.pow(vx - uy, 2)
    return grid.withColumns({"ow": ow, "vorticity": vx - uy}).drop(*[f"_{c}{a}" for c in "uv" for a in "xy"])


def at_points(points: DataFrame, grid: DataFrame, field: str, x0: float, y0: float, step: float, method: str = "bilinear", size: int | None = None) -> DataFrame:
    """Points (t, x, y) with `value`: of the nearest cell, or between the four around it; null where one is missing."""
    fi, fj = (F.col("x") - x0) / step, (F.col("y") - y0) / step
    turn = (lambda c: F.pmod(c, F.lit(size))) if size else (lambda c: c)
    cells = grid.select("t", "i", "j", F.col(field).alias("_v"))
    if method == "nearest":
        at = points.withColumns({"i": turn(F.round(fi).cast("int")), "j": F.round(fj).cast("int")})
        return at.join(cells.hint("merge"), ["t", "i", "j"], "left").withColumnRenamed("_v", "value").drop("i", "j")
    # all four corners of a cell in its own row, so points need one join
    corner = cells.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    corner = corner.select("t", turn(F.col("i") - F.col("_c.a")).alias("i"), (F.col("j") - F.col("_c.b")).alias("j"), (F.col("_c.a") * 2 + F.col("_c.b")).alias("_k"), "_v")
    four = corner.groupBy("t", "i", "j").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])
    at = points.withColumns({"i": turn(F.floor(fi).cast("int")), "j": F.floor(fj).cast("int"), "_p": fi - F.floor(fi), "_q": fj - F.floor(fj)})
    p, q = F.col("_p"), F.col("_q")
    value = (1 - p) * (1 - q) * F.col("_v0") + (1 - p) * q * F.col("_v1") + p * (1 - q) * F.col("_v2") + p * q * F.col("_v3")
    return at.join(four.hint("merge"), ["t", "i", "j"], "left").withColumn("value", value).drop("i", "j", "_p", "_q", *[f"_v{k}" for k in range(4)])


def between_times(points: DataFrame, grid: DataFrame, field: str, x0: float, y0: float, step: float, every: float = 1.0) -> DataFrame:
    """As `at_points` for times between grids: linear between the two nearest grid times around each point; null before the
    first and after the last. Spans between grid times are dealt to cells of `every`, so that points meet theirs by an equal
    key, and the corners of both ends stand in one row, so that the grid is joined once."""
    spans = grid.select(F.col("t").alias("_t")).distinct()
    spans = spans.withColumn("_t1", F.lead("_t").over(Window.orderBy("_t")))  # one row per grid time
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_t") / every), F.floor(F.coalesce("_t1", "_t") / every))))
    inside = (F.col("t") >= F.col("_t")) & ((F.col("t") < F.col("_t1")) | F.col("_t1").isNull() & (F.col("t") == F.col("_t")))
    at = points.join(spans, (F.floor(F.col("t") / every) == F.col("_cell")) & inside, "left").drop("_cell")
    # each cell's value belongs to the span that begins at its time, and to the one that ends there
    ends = spans.select("_t", "_t1").distinct()
    role = ends.select(F.col("_t").alias("t"), F.col("_t").alias("_span"), F.lit(0).alias("_late")).unionByName(ends.where("_t1 is not null").select(F.col("_t1").alias("t"), F.col("_t").alias("_span"), F.lit(1).alias("_late")))
    cells = grid.select("t", "i", "j", F.col(field).alias("_v")).join(role, "t")
    corner = cells.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    corner = corner.select(F.col("_span").alias("_t"), (F.col("i") - F.col("_c.a")).alias("i"), (F.col("j") - F.col("_c.b")).alias("j"), (F.col("_late") * 4 + F.col("_c.a") * 2 + F.col("_c.b")).alias("_k"), "_v")
    eight = corner.groupBy("_t", "i", "j").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(8)])
    fi, fj = (F.col("x") - x0) / step, (F.col("y") - y0) / step
    at = at.withColumns({"i": F.floor(fi).cast("int"), "j": F.floor(fj).cast("int"), "_p": fi - F.floor(fi), "_q": fj - F.floor(fj)})
    p, q = F.col("_p"), F.col("_q")
    value = lambda k: (1 - p) * (1 - q) * F.col(f"_v{k}") + (1 - p) * q * F.col(f"_v{k + 1}") + p * (1 - q) * F.col(f"_v{k + 2}") + p * q * F.col(f"_v{k + 3}")
    share = (F.col("t") - F.col("_t")) / (F.col("_t1") - F.col("_t"))
    mixed = F.when(F.col("_t1").isNull(), value(0)).otherwise(value(0) * (1 - share) + value(4) * share)
    return at.join(eight, ["_t", "i", "j"], "left").withColumn("value", mixed).select(*points.columns, "value")


def _filtered(step: float, wavelength: float, order: int, kind: str, size: int, circular: bool, extend: float | None, pdf: pd.DataFrame) -> pd.DataFrame:
    """The smoothed rows of one band. Rows are transformed once; each own row is the sum of its neighbours' transforms times
    those of its kernel's rows, padded so that nothing wraps (a circular grid is laid out beyond its ends first)."""
    own = pdf[pdf["own"]]
    if not len(own):
        return pd.DataFrame({"t": [], "i": [], "j": [], "low": []})
    first, last = int(pdf["j"].min()), int(pdf["j"].max())
    z = np.full((last - first + 1, size), np.nan)
    z[pdf["j"].to_numpy() - first, pdf["i"].to_numpy()] = pdf["v"].to_numpy(float)
    rows = own.groupby("j")["lat"].first()
    weights = {int(j): kernels.low_pass_weights(float(lat), step, step, wavelength, order, kind) for j, lat in rows.items()}
    half = max(w.shape[0] // 2 for w in weights.values())
    wide = z[:, np.arange(-half, size + half) % size] if circular else np.pad(z, ((0, 0), (half, half)), constant_values=np.nan)
    n = 1 << (wide.shape[1] + 2 * half - 1).bit_length()
    known = ~np.isnan(wide)
    values, counts = np.fft.rfft(np.where(known, wide, 0.0), n), np.fft.rfft(known.astype(float), n)
    out = []
    for j, w in weights.items():
        hx, hy = w.shape[0] // 2, w.shape[1] // 2
        at = [k for k in range(-hy, hy + 1) if 0 <= j + k - first < len(z)]
        kernel = np.zeros((len(at), n))
        kernel[:, np.arange(-hx, hx + 1)] = w[:, [k + hy for k in at]].T
        turned = np.conj(np.fft.rfft(kernel, n))
        near = [j + k - first for k in at]
        total, valid = (np.fft.irfft((turned * f[near]).sum(0), n)[half : half + size] for f in (values, counts))
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(np.abs(valid) > 1e-10 * np.abs(w).sum(), total / valid, np.nan)
        low[np.isnan(z[j - first]) if extend is None else valid < extend * w.sum()] = np.nan
        out.append(pd.DataFrame({"t": own["t"].iloc[0], "i": np.arange(size), "j": j, "low": low}))
    return pd.concat(out, ignore_index=True)


#: Rows of a band of latitudes at least.
BAND = 32


def low_pass(grid: DataFrame, field: str, step: float, wavelength: float, size: int, order: int = 1, kind: str = "bessel", circular: bool = False, lat_max: float = 85.0, extend: float | None = None) -> DataFrame:
    """grid with `low`: the field smoothed by a kernel of each latitude (bessel, lanczos or loess), weighted by valid cells.

    Rows are dealt to bands of latitudes, each with a halo as high as the kernel. Rows beyond lat_max are null. extend:
    masked cells get a value too where valid cells have that share of the kernel's weight.
    """
    reach = int(np.ceil(wavelength * (order if kind != "loess" else 1) / (step * np.pi / 180 * RADIUS)))
    height = max(BAND, reach)
    used = grid.where(F.abs("lat") <= lat_max).select("t", "i", "j", "lat", F.col(field).cast("double").alias("v"))
    band = used.withColumn("band", F.explode(F.sequence(F.floor((F.col("j") - reach) / height), F.floor((F.col("j") + reach) / height))))
    band = band.withColumn("own", F.col("band") == F.floor(F.col("j") / height))
    run = partial(_filtered, step, wavelength, order, kind, size, circular, extend)
    low = band.groupBy("t", "band").applyInPandas(lambda pdf: run(pdf), grid.select("t", "i", "j").schema.simpleString()[7:-1].replace(":", " ") + ", low double")
    return grid.join(low.withColumn("low", F.nanvl("low", F.lit(None))), ["t", "i", "j"], "left")


def high_pass(grid: DataFrame, field: str, *args, **kw) -> DataFrame:
    return low_pass(grid, field, *args, **kw).withColumn("high", F.col(field) - F.col("low")).drop("low")


def band_pass(grid: DataFrame, field: str, step: float, shorter: float, longer: float, size: int, **kw) -> DataFrame:
    """grid with `band`: the field smoothed at the shorter wavelength, less that smoothed again at the longer one."""
    smooth = low_pass(grid, field, step, shorter, size, **kw).withColumnRenamed("low", "_s")
    return low_pass(smooth, "_s", step, longer, size, **kw).withColumn("band", F.col("_s") - F.col("low")).drop("_s", "low")


def _power(field: str, pdf: pd.DataFrame) -> pd.DataFrame:
    v = pdf.sort_values("i")[field].to_numpy(float)
    if np.isnan(v).any() or len(v) < 4:
        return pd.DataFrame({"wave": [], "power": []})
    n = len(v)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    p = np.abs(np.fft.rfft((v - v.mean()) * window)) ** 2 / (window**2).sum()
    p[1 : (n + 1) // 2] *= 2
    return pd.DataFrame({"wave": np.arange(len(p)), "power": p})


def spectrum(grid: DataFrame, field: str, axis: str = "i") -> DataFrame:
    """wave (cycles a line) and mean power of all full lines along an axis."""
    other = "j" if axis == "i" else "i"
    lines = grid.select("t", F.col(axis).alias("i"), F.col(other).alias("line"), field)
    return lines.groupBy("t", "line").applyInPandas(lambda pdf: _power(field, pdf), "wave long, power double").groupBy("wave").agg(F.avg("power").alias("power"))


def in_rings(rings: DataFrame, grid: DataFrame, field: str, x0: float, y0: float, step: float) -> DataFrame:
    """Per ring (obs_id, t, ring): count, mean, least and largest value of the cells inside that have one."""
    from gyrelake.functions.geo import winding

    edge = lambda pick, k, c: F.round((pick(F.transform("ring", lambda p: p[k])) - c) / step).cast("int")
    wide = rings.withColumn("i", F.explode(F.sequence(edge(F.array_min, "x", x0), edge(F.array_max, "x", x0))))
    wide = wide.withColumn("j", F.explode(F.sequence(edge(F.array_min, "y", y0), edge(F.array_max, "y", y0))))
    inside = wide.where(winding(F.col("ring"), F.col("i") * step + x0, F.col("j") * step + y0) != 0).select("obs_id", "t", "i", "j")
    v = F.col(field)
    return inside.join(grid, ["t", "i", "j"]).groupBy("obs_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def second_difference(grid: DataFrame, field: str, into: str, axis: str = "i", reach: int = 1) -> DataFrame:
    """Both neighbours at `reach` cells less twice the cell; null where one of the three is missing."""
    line = Window.partitionBy("t", "j" if axis == "i" else "i").orderBy(axis)
    at = lambda k: F.first(field).over(line.rangeBetween(k, k))
    return grid.withColumn(into, at(reach) + at(-reach) - 2 * F.col(field))


def with_equatorial_currents(grid: DataFrame, height: str, step: float, reach: int = 15, half: int = 4) -> DataFrame:
    """u and v by the slope's balance, blended near the equator with the one of its second differences: within 5 degrees
    that takes the share exp(-(lat / 2.2)^2). The height is to be smooth there already (`low_pass`)."""
    per_cell = np.pi / 180 * RADIUS * 1000 * step
    out = with_currents(grid, height, step, half)
    out = second_difference(out, height, "_yy", "j", reach)
    x = Window.partitionBy("t", "j").orderBy("i")
    y = Window.partitionBy("t", "i").orderBy("j")
    side = lambda c, w: (F.first(c).over(w.rangeBetween(1, 1)) - F.first(c).over(w.rangeBetween(-1, -1))) / 2
    out = out.withColumn("_x", side(height, x)).withColumn("_xy", side("_x", y))
    beta = coriolis(F.lit(90.0)) * F.cos(F.radians("lat")) / (RADIUS * 1000)
    u, v = -GRAVITY / beta * F.col("_yy") / (per_cell * reach) ** 2, GRAVITY / beta * F.col("_xy") / (per_cell**2 * F.cos(F.radians("lat")))
    share = F.when(F.abs("lat") <= 5, F.exp(-F.pow(F.col("lat") / 2.2, 2))).otherwise(0.0)
    mixed = lambda own, near: F.when(F.col("lat") == 0, near).otherwise(F.coalesce(F.col(own) * (1 - share) + near * share, F.when(share == 0, F.col(own))))
    return out.withColumns({"u": mixed("u", u), "v": mixed("v", v)}).drop("_yy", "_x", "_xy")


def gaussian(grid: DataFrame, field: str, into: str, sigma: float, size: tuple[int, int]) -> DataFrame:
    """The field smoothed by a Gaussian of `sigma` cells, cut at four of them, over cells that have a value; the grid is
    mirrored at its edges. One axis after the other; every cell gets one, null where no cell in reach has a value."""
    reach = int(4 * sigma + 0.5)
    k = np.arange(-reach, reach + 1)
    weights = np.exp(-(k**2) / (2 * sigma**2))
    weights = (weights / weights.sum()).tolist()
    out = grid.withColumns({"_v": F.coalesce(field, F.lit(0.0)), "_w": F.col(field).isNotNull().cast("double")})
    for axis, n in zip("ij", size, strict=True):
        mirrored = F.array(F.col(axis), -F.col(axis) - 1, 2 * n - 1 - F.col(axis))
        halo = out.withColumn("_at", F.explode(mirrored)).where(F.col("_at").between(-reach, n - 1 + reach))
        line = Window.partitionBy("t", "j" if axis == "i" else "i").orderBy("_at")
        total = lambda c: sum((F.coalesce(F.first(c).over(line.rangeBetween(int(d), int(d))), F.lit(0.0)) * w for d, w in zip(k, weights, strict=True)), F.lit(0.0))  # noqa: E731, B023
        halo = halo.withColumns({"_a": total("_v"), "_b": total("_w")})
        out = halo.where(F.col("_at") == F.col(axis)).drop("_v", "_w", "_at").withColumnsRenamed({"_a": "_v", "_b": "_w"})
    return out.withColumn(into, F.when(F.col("_w") > 0, F.col("_v") / F.col("_w"))).drop("_v", "_w")


def without_land(grid: DataFrame, land: DataFrame, field: str, x0: float, y0: float, step: float) -> DataFrame:
    """The field null where the nearest cell of `land` (i, j, mask) is 1."""
    i, j = (F.round((F.col(c) - c0) / step).cast("int") for c, c0 in (("lon", x0), ("lat", y0)))
    at = land.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("mask").alias("_m"))
    return grid.join(at, (i == F.col("_i")) & (j == F.col("_j")), "left").withColumn(field, F.when(F.coalesce("_m", F.lit(0)) != 1, F.col(field))).drop("_i", "_j", "_m")


def flags_in_rings(rings: DataFrame, grid: DataFrame, field: str, x0: float, y0: float, step: float, above: float) -> DataFrame:
    """Per ring: whether a cell inside has no value, and whether one is over `above`."""
    from gyrelake.functions.geo import winding

    edge = lambda pick, k, c: F.round((pick(F.transform("ring", lambda p: p[k])) - c) / step).cast("int")
    wide = rings.withColumn("i", F.explode(F.sequence(edge(F.array_min, "x", x0), edge(F.array_max, "x", x0))))
    wide = wide.withColumn("j", F.explode(F.sequence(edge(F.array_min, "y", y0), edge(F.array_max, "y", y0))))
    inside = wide.where(winding(F.col("ring"), F.col("i") * step + x0, F.col("j") * step + y0) != 0).select("obs_id", "t", "i", "j")
    v = F.col(field)
    return inside.join(grid, ["t", "i", "j"]).groupBy("obs_id").agg(F.bool_or(v.isNull()).alias("masked"), F.coalesce(F.bool_or(v > above), F.lit(False)).alias("beyond"))


def described(grid: DataFrame) -> list[tuple[str, str, str]]:
    """(name, type, unit) of a grid's variables."""
    return [(f.name, f.dataType.simpleString(), f.metadata.get("unit", "")) for f in grid.schema.fields if f.name not in ("t", "i", "j", "lon", "lat")]


def with_variable(grid: DataFrame, name: str, value: Column | str, unit: str | None = None) -> DataFrame:
    """A variable more: an expression, or a copy of another one, with that one's unit unless another is given."""
    have = grid.schema[value].metadata if isinstance(value, str) else {}
    return grid.withColumn(name, (F.col(value) if isinstance(value, str) else value).alias(name, metadata=have | ({"unit": unit} if unit else {})))


def save_grid(grid: DataFrame, path: str) -> None:
    """Parquet with one folder per time, so that a window of times is a choice of folders."""
    grid.write.partitionBy("t").option("compression", "zstd").mode("overwrite").parquet(path)


def load_grid(spark, path: str, variables: list[str] | None = None, times: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None) -> DataFrame:
    """A saved grid: chosen variables, times and area reach the scan as read schema, folders and pushed filters."""
    out = spark.read.parquet(path)
    for c, bounds in (("t", times), ("lon", lon), ("lat", lat)):
        if bounds:
            out = out.where(F.col(c).between(*bounds))
    return out.select("t", "i", "j", "lon", "lat", *variables) if variables else out
