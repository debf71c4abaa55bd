"""Detection as a dataflow against a plain one that walks the lines of one grid in order, and across the seam of a circular grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.functions import kernels
from gyrelake.operators import detection, grids


def table(spark, z, x0=0.0, y0=30.0, d=0.5, t=0):
    rows = [(t, i, j, x0 + i * d, y0 + j * d, None if math.isnan(z[i, j]) else float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])]
    g = spark.createDataFrame(rows, "t long, i int, j int, lon double, lat double, height double")
    return grids.with_currents(g, "height", d, 1)


def bumps(seed, n=40, m=30, count=14):
    rng = np.random.default_rng(seed)
    i, j = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    z = np.zeros((n, m))
    for _ in range(count):
        z += rng.choice([-1, 1]) * rng.uniform(0.05, 0.2) * np.exp(-((i - rng.uniform(2, n - 3)) ** 2 + (j - rng.uniform(2, m - 3)) ** 2) / rng.uniform(4, 16))
    return z


def plain_rings(z, step):
    out = {}
    for k in range(int(np.floor(np.nanmin(z) / step)), int(np.ceil(np.nanmax(z) / step)) + 1):
        out[k] = [(x, y) for x, y in kernels.iso_lines(z, k * step) if len(x) > 4 and x[0] == x[-1] and y[0] == y[-1]]
    return out


def plain_features(z, limits, x0=0.0, y0=30.0, d=0.5):
    """(sign, level, top, n, amplitude, inner levels): highs from the lowest level up, then lows from the highest down."""
    free, found, lines = ~np.isnan(z), [], plain_rings(z, limits.step)
    grid_i, grid_j = (v.ravel() for v in np.meshgrid(*(np.arange(s) for s in z.shape), indexing="ij"))

    def cells(line):
        box = (grid_i >= line[0].min()) & (grid_i <= line[0].max()) & (grid_j >= line[1].min()) & (grid_j <= line[1].max())
        i, j = grid_i[box], grid_j[box]
        ok = kernels.inside(i.astype(float), j.astype(float), *line) if len(i) else np.zeros(0, bool)
        return i[ok], j[ok]

    def peak(a, b, sign):
        near = [(z[p, q] * sign, -p, -q) for p in range(max(a - 1, 0), min(a + 2, z.shape[0])) for q in range(max(b - 1, 0), min(b + 2, z.shape[1])) if not math.isnan(z[p, q])]
        return max(near) == (z[a, b] * sign, -a, -b)

    for sign in (1, -1):
        for k in sorted(lines, reverse=sign < 0):
            for line in lines[k]:
                lon, lat = x0 + line[0] * d, y0 + line[1] * d
                error = kernels.fit_rings(lon, lat, np.zeros(len(lon), int))["error"][0]
                i, j = cells(line)
                side = (z[i, j] - k * limits.step) * sign
                if not 0 <= error <= limits.error or not free[i, j].all() or not limits.pixels[0] <= len(i) <= limits.pixels[1] or not (side >= 0).all():
                    continue
                peaks = [(s, -a, -b) for s, a, b in zip(side, i, j, strict=True) if peak(a, b, sign)]
                if not peaks or len(peaks) > 1 and sum(s >= limits.secondary * limits.step for s, _, _ in peaks) > limits.extrema:
                    continue
                over, a, b = max(peaks)
                if over < limits.steps * limits.step:
                    continue
                a, b, inner, m = -a, -b, [k], k
                while True:
                    m += sign
                    near = [x for x in lines.get(m, []) if x[0].min() <= a <= x[0].max() and x[1].min() <= b <= x[1].max() and kernels.inside(*x, *line).all()]
                    if not near:
                        break
                    inner.append(m)
                free[i, j] = False
                found.append((sign, k, (a, b), len(i), round(float(over), 6), len(inner)))
    return sorted(found)


def found_features(grid, limits, frame=None):
    frame = frame or detection.frame_of(grid)
    points = detection.ring_points(grid, "height", limits.step, frame.size)
    ring, span = detection.rings(points, frame), detection.spans(points, frame.size)
    found, held = detection.accepted(ring, span, detection.with_extrema(grid, "height", frame.size), limits, frame.size)
    speed = grid.select("t", "i", "j", F.hypot("u", "v").alias("speed"))
    rows = detection.profiles(found, held, ring, span, speed, limits, frame.size).collect()
    return sorted((r["sign"], r["k"], (r["top_i"], r["top_j"]), r["n"], round(r["amplitude"], 6), len(r["inner"])) for r in rows)


@pytest.mark.parametrize("seed, tile", [(1, 64), (2, 7)])
def test_equal_to_the_plain_version(spark, monkeypatch, seed, tile):
    """Within one tile, and over many: the lines of all levels, and the features with all that follows from them."""
    monkeypatch.setattr(detection, "TILE", tile)
    z = bumps(seed)
    z[20:22, 5:7] = np.nan
    limits = detection.Limits(step=0.01, error=70.0, pixels=(4, 200))
    g = table(spark, z)
    points = detection.ring_points(g, "height", limits.step)
    rows = detection.rings(points, detection.frame_of(g)).collect()
    shape = lambda x, y: frozenset(zip(np.round(x, 9).tolist(), np.round(y, 9).tolist(), strict=True))
    assert sorted((r["k"], sorted(shape(r["x"], r["y"]))) for r in rows) == sorted((k, sorted(shape(x, y))) for k, lines in plain_rings(z, limits.step).items() for x, y in lines)
    want = plain_features(z, limits)
    assert len(want) >= 4 and {w[0] for w in want} == {1, -1}
    assert found_features(g, limits) == want


def test_cells_of_spans(spark):
    """Cells from pairs of points are those that the line goes round."""
    z = bumps(3)
    g = table(spark, z)
    points = detection.ring_points(g, "height", 0.02)
    rows = {(r["k"], r["ring"]): r for r in detection.rings(points, detection.frame_of(g)).collect()}
    cells = {}
    for s in detection.spans(points).collect():
        cells.setdefault((s["k"], s["ring"]), set()).update((s["i"], j) for j in range(s["j0"], s["j1"] + 1))
    i, j = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(30), indexing="ij"))
    for key, r in rows.items():
        ok = kernels.inside(i.astype(float), j.astype(float), np.array(r["x"]), np.array(r["y"]))
        assert cells.get(key, set()) == set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def test_a_feature_across_the_seam_is_found_once(spark):
    """A circular grid of 10 degrees a cell with one hump across 0, and one elsewhere."""
    i, j = np.meshgrid(np.arange(72), np.arange(20), indexing="ij")
    near = lambda a, b: np.minimum((i - a) % 72, (a - i) % 72) ** 2 + (j - b) ** 2
    z = 0.2 * np.exp(-near(0.3, 9) / 8.0) + 0.1 * np.exp(-near(30.2, 8) / 8.0)
    g = table(spark, z)
    limits = detection.Limits(step=0.01, error=300.0, pixels=(4, 400))
    frame = detection.Frame(0.0, 30.0, 5.0, 0.5, 72)
    rows = detection.detect(g, "height", limits, frame).collect()
    assert sorted(round(r["amplitude"], 2) for r in rows if r["sign"] > 0) == [0.09, 0.19]
    seam = max(rows, key=lambda r: r["amplitude"])
    assert min(seam["lon"], 360 - seam["lon"]) < 5 and max(seam["ring_x_e"]) - min(seam["ring_x_e"]) < 60
    moved = detection.detect(g.withColumn("i", F.pmod(F.col("i") + 20, F.lit(72))), "height", limits, frame).collect()
    told = lambda found: sorted((r["sign"], round(r["amplitude"], 9), r["nb_contour_selected"], r["num_point_e"], round(r["effective_area"] / 1e9)) for r in found)
    assert told(moved) == told(rows)


def test_fits_in_batches():
    rng = np.random.default_rng(0)
    rings = []
    for _ in range(20):
        angle = np.sort(rng.uniform(0, 2 * math.pi, 30))
        r = rng.uniform(0.5, 1.5, 30)
        x, y = 10 + r * np.cos(angle), 40 + r * np.sin(angle)
        rings.append((np.append(x, x[0]), np.append(y, y[0])))
    got = kernels.fit_rings(np.concatenate([r[0] for r in rings]), np.concatenate([r[1] for r in rings]), np.repeat(np.arange(20), 31))
    k = math.pi / 180 * kernels.RADIUS
    for n, (lon, lat) in enumerate(rings):
        lon0, lat0 = lon[1:].mean(), lat[1:].mean()
        x, y = (lon - lon0) * k * math.cos(math.radians(lat0)), (lat - lat0) * k
        cx, cy, r = kernels.fit_circle(x, y)
        assert got["radius"][n] == pytest.approx(r, rel=1e-6) and got["area"][n] == pytest.approx(kernels.area(x, y), rel=1e-9)
        assert got["error"][n] == pytest.approx(kernels.shape_error(x, y, cx, cy, r), rel=1e-6)
    flat = kernels.fit_rings(np.array([0.0, 1, 2, 0]), np.array([0.0, 0, 0, 0]), np.zeros(4, int))
    assert math.isnan(flat["radius"][0])


def test_overlaps_in_batches():
    rng = np.random.default_rng(1)
    shapes = []
    for n in (5, 5, 9, 31, 9, 5):
        angle = np.linspace(0, 2 * math.pi, n)
        r = rng.uniform(0.4, 1.0, n)
        r[-1] = r[0]
        shapes.append((rng.uniform(-0.5, 0.5) + r * np.cos(angle), rng.uniform(-0.5, 0.5) + r * np.sin(angle)))
    pairs = [(a, b) for a in shapes for b in shapes]
    many = kernels.overlaps([a[0] for a, _ in pairs], [a[1] for a, _ in pairs], [b[0] + 360 for _, b in pairs], [b[1] for _, b in pairs], cells=3000)
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(-1.6, 1.6, 400), np.linspace(-1.6, 1.6, 400)))
    for (a, b), share in zip(pairs, many, strict=True):
        p, q = kernels.inside(x, y, *a), kernels.inside(x, y, *b)
        assert share == pytest.approx((p & q).sum() / (p | q).sum(), abs=0.03)
        assert share == pytest.approx(kernels.overlap(*a, *b), abs=1e-9)
