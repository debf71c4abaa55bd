"""Shapes of rings (arrays of x, y; closed) a row at a time: fits, hulls, simplification. NumPy in Arrow-fed tasks, where
expressions cannot state it; what expressions can is in `gyrelake.functions.geo`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.functions import kernels

RING = "array<struct<x:double,y:double>>"


def _lists(ring: Column | str) -> tuple[Column, Column]:
    return F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])


def fits(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with circle: lon, lat, radius (m), error (percent of the circle) and area (m2) of the circle by least squares; a batch
    of rings at once. Rings that span no circle have a null radius and error."""

    @F.pandas_udf("lon double, lat double, radius double, error double, area double")
    def circle(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        if not len(xs):
            return pd.DataFrame({c: [] for c in ("lon", "lat", "radius", "error", "area")}, dtype=float)
        number = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
        return pd.DataFrame(kernels.fit_rings(np.concatenate(xs.to_list()).astype(float), np.concatenate(ys.to_list()).astype(float), number))

    out = df.withColumn("circle", circle(*_lists(ring)))
    known = lambda c: F.nanvl(F.col(f"circle.{c}"), F.lit(None))
    return out.withColumn("circle", F.struct(*[known(c).alias(c) for c in ("lon", "lat", "radius", "error", "area")]))


def _ring_udf(f: Callable) -> Callable:
    """A column function from rings to rings by f(x, y) -> (x, y)."""

    @F.pandas_udf(RING)
    def mapped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([[{"x": float(a), "y": float(b)} for a, b in zip(*f(np.asarray(x, float), np.asarray(y, float)), strict=True)] for x, y in zip(xs, ys, strict=True)])

    return mapped


def convex_hull(ring: Column | str) -> Column:
    """The closed hull, anti-clockwise."""
    return _ring_udf(kernels.convex_hull)(*_lists(ring))


def simplified(ring: Column | str, points: int) -> Column:
    """A closed ring of so many points, those of the smallest triangles left out first."""
    return _ring_udf(lambda x, y: kernels.visvalingam(x, y, points))(*_lists(ring))


def thinned(ring: Column | str, least: float) -> Column:
    """Points at least so far from the last one kept."""
    return _ring_udf(lambda x, y: kernels.thinned(x, y, least))(*_lists(ring))


def resampled(ring: Column | str, factor: int = 1, size: int | None = None) -> Column:
    """Points at even distances along the line, its ends kept."""
    return _ring_udf(lambda x, y: kernels.resampled(x, y, factor, size))(*_lists(ring))


def ellipse(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with ellipse: x, y, a, b (half axes, in the ring's units) and angle of the conic through the points."""

    @F.pandas_udf("x double, y double, a double, b double, angle double")
    def fitted(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [kernels.fit_ellipse(x, y) for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame(rows, columns=["x", "y", "a", "b", "angle"], dtype=float)

    return df.withColumn("ellipse", fitted(*_lists(ring)))


def without_repeats(ring: Column) -> Column:
    """A ring whose last places repeat the first point without them; three points stay at least."""
    other = F.transform(ring, lambda p, i: F.when((p["x"] != F.get(ring, 0)["x"]) | (p["y"] != F.get(ring, 0)["y"]), i))
    return F.slice(ring, 1, F.greatest(F.coalesce(F.array_max(other), F.lit(0)) + 1, F.lit(3)))
