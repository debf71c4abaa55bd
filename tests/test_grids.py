"""Filters, nearest cells, grown components and cubes from a stream against plain versions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.functions import kernels
from gyrelake.operators import grids, networks, outlines, pairs
from gyrelake.streaming import cube


def direct_filter(band: np.ndarray, row: int, weights: np.ndarray, circular: bool, extend: float | None = None) -> np.ndarray:
    """One filtered row (all i at one j) of a band of rows (i, j): weighted sums over valid cells by the valid weights."""
    half_x, half_y = weights.shape[0] // 2, weights.shape[1] // 2
    n = band.shape[0]
    total, valid = np.zeros(n), np.zeros(n)
    for dj in range(-half_y, half_y + 1):
        j = row + dj
        if not 0 <= j < band.shape[1]:
            continue
        v = band[:, j]
        ok = ~np.isnan(v)
        v = np.where(ok, v, 0.0)
        for di in range(-half_x, half_x + 1):
            w = weights[half_x + di, half_y + dj]
            if w == 0:
                continue
            if circular:
                total += w * np.roll(v, -di)
                valid += w * np.roll(ok, -di)
            else:
                a, b = max(0, -di), min(n, n - di)
                if a < b:
                    total[a:b] += w * v[a + di : b + di]
                    valid[a:b] += w * ok[a + di : b + di]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = total / valid
    here = np.isnan(band[:, row])
    out[here if extend is None else here & (valid < extend * weights.sum())] = np.nan
    return out



def field(spark, n=60, m=40, y0=20.0):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(n, m))
    z[rng.random((n, m)) < 0.1] = np.nan
    rows = [(0, i, j, i * 0.5, y0 + j * 0.5, None if math.isnan(z[i, j]) else float(z[i, j])) for i in range(n) for j in range(m)]
    return z, spark.createDataFrame(rows, "t long, i int, j int, lon double, lat double, h double")


def direct(z, wavelength, order, kind, circular, extend, y0=20.0):
    out = np.full(z.shape, np.nan)
    for j in range(z.shape[1]):
        w = kernels.low_pass_weights(y0 + j * 0.5, 0.5, 0.5, wavelength, order, kind)
        half = w.shape[1] // 2
        band = np.full((z.shape[0], 2 * half + 1), np.nan)
        for k in range(2 * half + 1):
            if 0 <= j - half + k < z.shape[1]:
                band[:, k] = z[:, j - half + k]
        out[:, j] = direct_filter(band, half, w, circular, extend)
    return out


def shaped(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("kind, order, circular, extend, band", [("bessel", 1, False, None, 32), ("bessel", 1, True, 0.3, 7), ("lanczos", 2, False, None, 5), ("loess", 1, True, None, 32)])
def test_filters_in_bands(spark, monkeypatch, kind, order, circular, extend, band):
    """Transforms of bands of rows against sums over cells one by one, masks included."""
    monkeypatch.setattr(grids, "BAND", band)
    z, g = field(spark)
    low = grids.low_pass(g, "h", 0.5, 230.0, 60, order, kind, circular, extend=extend)
    want = direct(z, 230.0, order, kind, circular, extend)
    assert np.allclose(shaped(low, "low", z.shape), want, atol=1e-9, equal_nan=True)
    if kind == "bessel" and not circular:
        assert np.allclose(shaped(grids.high_pass(g, "h", 0.5, 230.0, 60), "high", z.shape), z - want, atol=1e-9, equal_nan=True)
        twice = grids.band_pass(g, "h", 0.5, 230.0, 400.0, 60)
        assert np.allclose(shaped(twice, "band", z.shape), want - direct(want, 400.0, 1, "bessel", False, None), atol=1e-9, equal_nan=True)


def test_nearest_on_the_sphere(spark):
    """Poles, the seam, far points and equal cells against brute force."""
    rng = np.random.default_rng(8)
    place = lambda n: np.stack([rng.uniform(-180, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1)
    cells = np.concatenate([place(150), [[0, 90], [120, -90], [359.99, 10], [10, 10], [10, 10]]])
    cells = cells[cells[:, 1] > -60]  # no cell near the south: far points need wider cubes
    points = np.concatenate([place(200), [[77, 90], [5, -90], [0.01, 10], [10, 10], [370, 10]]])
    turn = lambda p: np.stack([np.cos(np.radians(p[:, 1])) * np.cos(np.radians(p[:, 0])), np.cos(np.radians(p[:, 1])) * np.sin(np.radians(p[:, 0])), np.sin(np.radians(p[:, 1]))], 1)
    far = ((turn(points)[:, None] - turn(cells)[None]) ** 2).sum(2)
    table = lambda p, id: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], f"{id} long, lon double, lat double")
    for spacing in (None, 1.0, 60.0):
        rows = pairs.nearest(table(points, "pid"), table(cells, "cid"), spacing).collect()
        assert len(rows) == len(points)
        for r in rows:
            assert far[r["pid"], r["cid"]] == pytest.approx(far[r["pid"]].min(), abs=1e-12)
    twins = [k for k, c in enumerate(cells) if tuple(c) == (10, 10)]
    assert {r["pid"]: r["cid"] for r in rows}[203] == min(twins)
    assert pairs.nearest(table(points, "pid"), table(cells[:0], "cid")).count() == 0


def test_grown_components(spark):
    """After each batch as from all edges at once; old numbers lead to the new ones."""
    rng = np.random.default_rng(4)
    known, seen, numbers = spark.createDataFrame([], "node long, component long"), [], {}
    for _ in range(4):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (12, 2))]
        seen += edges
        known, moved = networks.grown(known, spark.createDataFrame(edges, "a long, b long"))
        root = {i: i for e in seen for i in e}

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in seen:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        found = {r["node"]: r["component"] for r in known.collect()}
        assert found == {i: top(i) for i in root}
        renamed = {r["old"]: r["new"] for r in moved.collect()}
        assert {i: renamed.get(c, c) for i, c in numbers.items()} == {i: found[i] for i in numbers}
        numbers = found


def cells_of(spark, t, value, n=6):
    return spark.createDataFrame([(t, i, j, i * 1.0, j * 1.0, value + i + j) for i in range(n) for j in range(n)], "t long, i int, j int, lon double, lat double, height double")


def test_cube_from_a_stream(spark, tmp_path):
    """Files by time, one of them given again with other values and one in parts; a batch replayed changes nothing, and a
    run that stops behind its write goes on from the checkpoint."""
    source, table, state = (str(tmp_path / x) for x in ("in", "cube", "state"))
    schema = cells_of(spark, 0, 0.0).schema
    add = lambda name, df: df.coalesce(1).write.parquet(f"{source}/{name}")
    add("a", cells_of(spark, 0, 0.0))
    add("b", cells_of(spark, 1, 10.0).where("i < 3"))
    cube.ingest(spark, f"{source}/*", table, state, schema)
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(table).select("t", "i", "j", "height").collect())
    assert len(rows()) == 36 + 18
    add("c", cells_of(spark, 1, 10.0).where("i >= 3"))
    add("d", cells_of(spark, 0, 5.0).where("i = 2"))
    calls = []

    def stopped(batch, number):
        cube.merge(batch, table)
        calls.append(number)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        cube.ingest(spark, f"{source}/*", table, state, schema, each=stopped)
    before = rows()
    cube.ingest(spark, f"{source}/*", table, state, schema)
    assert rows() == before and len(before) == 72 and calls
    assert {r[3] - r[1] - r[2] for r in before if r[0] == 0 and r[1] == 2} == {5.0}
    cube.merge(cells_of(spark, 1, 10.0), table)
    assert rows() == before
    add("e", cells_of(spark, 7, 1.0))
    cube.ingest(spark, f"{source}/*", table, state, schema)
    latest = cube.window(spark, table, 2)
    assert {r["t"] for r in latest.select("t").distinct().collect()} == {1, 7} and latest.count() == 72
    assert cube.window(spark, table, 2, until=1).select("t").distinct().count() == 2
    assert {x for x in os.listdir(table) if x.startswith("t=")} == {"t=0", "t=1", "t=7"}


def test_unions(spark):
    """Star-shaped rings in heaps against a raster; four boxes around a hole; boxes that share a side, or touch at a corner."""
    rng = np.random.default_rng(6)
    rows = []
    for track in range(4):
        for k in range(7):
            angle = np.linspace(0, 2 * math.pi, 14)
            r = rng.uniform(0.3, 1.0, 14)
            r[-1] = r[0]
            x, y = rng.uniform(0, 2.5) + r * np.cos(angle), rng.uniform(0, 2.5) + r * np.sin(angle)
            x[-1], y[-1] = x[0], y[0]
            order = slice(None, None, -1) if k % 2 else slice(None)  # either way round
            rows.append((track, k, list(zip(x[order].tolist(), y[order].tolist(), strict=True))))
    box = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    rows += [(10, k, b) for k, b in enumerate([box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0, 1, 3), box(2, 0, 3, 3), box(0, 0, 3, 1)])]
    rows += [(11, k, b) for k, b in enumerate([box(0, 0, 1, 1), box(1, 0, 2, 1), box(2, 1, 3, 2)])]
    table = spark.createDataFrame(rows, "track long, rid long, ring array<struct<x:double,y:double>>")
    pieces = outlines.outline(table)
    areas = {r["track"]: r["area"] for r in outlines.areas(pieces).collect()}
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(-1.2, 3.8, 700), np.linspace(-1.2, 3.8, 700)))
    for track in range(4):
        hit = np.zeros(len(x), bool)
        for t, _, ring in rows:
            if t == track:
                hit |= kernels.inside(x, y, *np.array(ring).T)
        assert areas[track] == pytest.approx(hit.sum() * (5.0 / 699) ** 2, rel=0.01)
    assert areas[10] == pytest.approx(8) and areas[11] == pytest.approx(3)
    parts = {}
    for r in outlines.walked(pieces).collect():
        ring = np.array([(p["x"], p["y"]) for p in r["ring"]])
        assert tuple(ring[0]) == tuple(ring[-1])
        parts.setdefault(r["track"], []).append((r["hole"], round(kernels.area(*ring.T), 6)))
    assert sorted(parts[10]) == [(False, 9.0), (True, 1.0)] and sorted(parts[11]) == [(False, 1.0), (False, 2.0)]
    for track in range(4):
        assert sum(-a if hole else a for hole, a in parts[track]) == pytest.approx(areas[track], abs=1e-5)
