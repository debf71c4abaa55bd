"""Numerical kernels on arrays, free of Spark: rings, fits, resampling, iso-lines and filter weights."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

RADIUS = 6370997.0


def area(x: np.ndarray, y: np.ndarray) -> float:
    return abs(float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))) / 2


#: Stands for no crossing: it sorts behind all places.
NOWHERE = 1e300


def _crossings(x: np.ndarray, y: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where horizontal lines cross rings: for each ring (row) and level the sorted places, two by two the inside (even-odd)."""
    x0, y0, x1, y1 = (v[:, None] for v in (x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]))
    at = level[:, :, None]
    hit = (np.minimum(y0, y1) <= at) & (at < np.maximum(y0, y1))
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.where(hit, x0 + (at - y0) * (x1 - x0) / (y1 - y0), NOWHERE)
    most = int(hit.sum(2).max(initial=0))
    return np.sort(place, axis=2)[:, :, : most + most % 2]


def shared_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Area that closed rings share pairwise, one pair a row: between the heights where edges begin, end or cross, widths
    are linear, so the middle of each slab gives its area exactly."""
    low, high = np.maximum(ay.min(1), by.min(1)), np.minimum(ay.max(1), by.max(1))
    dax, day = np.diff(ax)[:, :, None], np.diff(ay)[:, :, None]
    dbx, dby = np.diff(bx)[:, None], np.diff(by)[:, None]
    cross = dax * dby - day * dbx
    ox, oy = bx[:, None, :-1] - ax[:, :-1, None], by[:, None, :-1] - ay[:, :-1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (ox * dby - oy * dbx) / cross, (ox * day - oy * dax) / cross
        met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        heights = np.where(met, ay[:, :-1, None] + t * day, np.nan)
    levels = np.concatenate([ay, by, heights.reshape(len(ax), -1)], 1)
    levels[~((levels >= low[:, None]) & (levels <= high[:, None]))] = np.nan
    levels = np.sort(levels, axis=1)
    levels = levels[:, : max(int((~np.isnan(levels)).sum(1).max(initial=0)), 1)]
    thick = np.diff(levels)
    middle = (levels[:, :-1] + levels[:, 1:]) / 2
    a, b = _crossings(ax, ay, middle), _crossings(bx, by, middle)
    wide = np.minimum(a[:, :, 1::2, None], b[:, :, None, 1::2]) - np.maximum(a[:, :, ::2, None], b[:, :, None, ::2])
    return np.where(thick > 1e-15, np.maximum(wide, 0).sum((2, 3)) * thick, 0.0).sum(1)


def areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(1)) / 2


def overlaps(ax, ay, bx, by, kind: str = "union", cells: int = 2_000_000) -> np.ndarray:
    """Shared area over the union's, the smaller ring's or the first ring's, pair by pair; the second is brought next to the
    first. Sequences of arrays; pairs of the same numbers of points are taken together, so many that `cells` numbers are
    held a time."""
    sizes = [(len(p), len(q)) for p, q in zip(ax, bx, strict=True)]
    out, of = np.zeros(len(sizes)), {}
    for k, s in enumerate(sizes):
        of.setdefault(s, []).append(k)
    for (n, m), rows in of.items():
        if min(n, m) < 4:
            continue
        chunk = max(1, cells // ((n + m + n * m) * 4 + (n + m) ** 2))
        for c in range(0, len(rows), chunk):
            at = rows[c : c + chunk]
            px, py, qx, qy = (np.array([v[k] for k in at], float) for v in (ax, ay, bx, by))
            qx = qx + 360 * np.round((px.min(1) - qx.min(1)) / 360)[:, None]
            both, a, b = shared_areas(px, py, qx, qy), areas(px, py), areas(qx, qy)
            under = {"union": a + b - both, "smaller": np.minimum(a, b), "first": a}[kind]
            out[at] = np.where(under > 0, both / np.where(under > 0, under, 1), 0.0)
    return out


def shared_area(ax, ay, bx, by) -> float:
    return float(shared_areas(*(np.asarray(v, float)[None] for v in (ax, ay, bx, by)))[0])


def overlap(ax, ay, bx, by, kind: str = "union") -> float:
    return float(overlaps([ax], [ay], [bx], [by], kind)[0])


def winding(x: float, y: float, rx: np.ndarray, ry: np.ndarray) -> int:
    side = (rx[1:] - rx[:-1]) * (y - ry[:-1]) - (x - rx[:-1]) * (ry[1:] - ry[:-1])
    up = (ry[:-1] <= y) & (ry[1:] > y) & (side > 0)
    down = (ry[:-1] > y) & (ry[1:] <= y) & (side < 0)
    return int(up.sum() - down.sum())


def inside(px: np.ndarray, py: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Which of many points a closed ring goes round."""
    x, y = px[:, None], py[:, None]
    side = (rx[1:] - rx[:-1]) * (y - ry[:-1]) - (x - rx[:-1]) * (ry[1:] - ry[:-1])
    up = (ry[:-1] <= y) & (ry[1:] > y) & (side > 0)
    down = (ry[:-1] > y) & (ry[1:] <= y) & (side < 0)
    return up.sum(1) != down.sum(1)


def fit_circle(x, y) -> tuple[float, float, float]:
    """Centre and radius by least squares over a closed ring; (0, -90, nan) where the points do not span a circle."""
    x, y = np.asarray(x, float)[1:], np.asarray(y, float)[1:]
    if len(x) < 3:
        return 0.0, -90.0, math.nan
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    scale = np.sqrt((u * u + v * v).max())
    if scale == 0:
        return 0.0, -90.0, math.nan
    u, v = u / scale, v / scale
    solved, _, rank, _ = np.linalg.lstsq(np.column_stack([2 * u, 2 * v, np.ones(len(u))]), u * u + v * v, rcond=None)
    if rank < 3:
        return 0.0, -90.0, math.nan
    a, b, c = solved
    return float(mx + a * scale), float(my + b * scale), float(scale * np.sqrt(c + a * a + b * b))


def fit_rings(lon: np.ndarray, lat: np.ndarray, ring: np.ndarray) -> dict[str, np.ndarray]:
    """lon, lat, radius (m), error (percent) and area (m2) of many closed rings, laid one after the other and numbered from 0
    in `ring`: circles by least squares in metres around each ring's middle. Rings that span no circle have no radius (nan)."""
    n = int(ring[-1]) + 1 if len(ring) else 0
    first = np.append(True, np.diff(ring) != 0) if n else np.zeros(0, bool)
    total = lambda v: np.bincount(ring, np.where(first, 0, v), n)  # noqa: E731  the point that is there twice counts once
    count = np.maximum(total(np.ones(len(ring))), 1)
    lon0, lat0 = total(lon) / count, total(lat) / count
    k = math.pi / 180 * RADIUS
    x, y = (lon - lon0[ring]) * k * np.cos(np.radians(lat0))[ring], (lat - lat0[ring]) * k
    q = x * x + y * y
    xx, yy, xy, xq, yq = total(x * x), total(y * y), total(x * y), total(x * q), total(y * q)
    det = xx * yy - xy * xy
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = ~(det > 1e-12 * (xx + yy) ** 2)
        a, b = (xq * yy - yq * xy) / (2 * det), (yq * xx - xq * xy) / (2 * det)
        r = np.where(flat, np.nan, np.sqrt(total(q) / count + a * a + b * b))
        d = np.hypot(x - a[ring], y - b[ring])
        near = np.where(d > r[ring], r[ring] / np.maximum(d, 1e-300), 1.0)
        cx, cy = a[ring] + (x - a[ring]) * near, b[ring] + (y - b[ring]) * near
    whole = lambda px, py: np.abs(np.bincount(ring[:-1], np.where(first[1:], 0, px[:-1] * py[1:] - px[1:] * py[:-1]), n)) / 2 if n else np.zeros(0)
    own = whole(x, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        error = 100 + (own - 2 * whole(cx, cy)) / (math.pi * r * r) * 100
    return {"lon": lon0 + a / (k * np.cos(np.radians(lat0))), "lat": lat0 + b / k, "radius": r, "error": error, "area": own}


def shape_error(x, y, x0: float, y0: float, r: float) -> float:
    """How far a ring's area lies outside the circle and the circle's outside the ring, percent of the circle."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = np.hypot(x - x0, y - y0)
    k = np.where(d > r, r / np.maximum(d, 1e-300), 1.0)
    clipped = area(x0 + (x - x0) * k, y0 + (y - y0) * k)
    return 100 + (area(x, y) - 2 * clipped) / (math.pi * r * r) * 100


def fit_ellipse(x, y) -> tuple[float, float, float, float, float]:
    """Centre, half axes and angle of the conic through a ring's points by least squares."""
    x, y = np.asarray(x, float)[1:], np.asarray(y, float)[1:]
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    a, b, c, d, e = np.linalg.lstsq(np.column_stack([u * u, u * v, v * v, u, v]), np.ones(len(u)), rcond=None)[0]
    m = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(2 * m, -np.array([d, e]))
    size = 1 + centre @ m @ centre
    value, vector = np.linalg.eigh(m / size)
    half = 1 / np.sqrt(value)
    return float(mx + centre[0]), float(my + centre[1]), float(half[0]), float(half[1]), float(math.atan2(vector[1, 0], vector[0, 0]))


def convex_hull(x, y) -> tuple[np.ndarray, np.ndarray]:
    """The closed hull, anti-clockwise from the lowest of the leftmost points (monotone chains)."""
    points = sorted(set(zip(map(float, x), map(float, y), strict=True)))
    if len(points) < 3:
        points = [*points, points[0]]
        return np.array([p[0] for p in points]), np.array([p[1] for p in points])

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points) + chain(points[::-1])
    hull.append(hull[0])
    return np.array([p[0] for p in hull]), np.array([p[1] for p in hull])


def visvalingam(x, y, size: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """A closed ring of `size` points: the point whose triangle with its neighbours is smallest goes first."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x) - 1
    before, after, alive = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)], [True] * n
    tri = lambda i: abs((x[i] - x[before[i]]) * (y[after[i]] - y[before[i]]) - (x[after[i]] - x[before[i]]) * (y[i] - y[before[i]]))
    sizes = [tri(i) for i in range(n)]
    heap = [(s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left = n
    while left > size - 1 and left > 3:
        s, i = heapq.heappop(heap)
        if not alive[i] or s != sizes[i]:
            continue
        alive[i] = False
        left -= 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            sizes[j] = max(tri(j), s)  # never smaller than what has gone before
            heapq.heappush(heap, (sizes[j], j))
    keep = [i for i in range(n) if alive[i]]
    keep.append(keep[0])
    return x[keep], y[keep]


def thinned(x, y, precision: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Points at least `precision` from the last kept one; of a run of gaps (nan) one stays."""
    out: list[tuple[float, float]] = []
    for p in zip(np.asarray(x, float).tolist(), np.asarray(y, float).tolist(), strict=True):
        gap = math.isnan(p[0]) or math.isnan(p[1])
        last_gap = not out or math.isnan(out[-1][0])
        if gap and last_gap and out:
            continue
        if not gap and not last_gap and (p[0] - out[-1][0]) ** 2 + (p[1] - out[-1][1]) ** 2 < precision * precision:
            continue
        out.append((math.nan, math.nan) if gap else p)
    return np.array([p[0] for p in out]), np.array([p[1] for p in out])


def resampled(x, y, factor: int = 2, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points at even distances along a line, its ends kept."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    along = np.append(0, np.cumsum(np.hypot(np.diff(x), np.diff(y))))
    at = np.linspace(0, along[-1], size or len(x) * factor)
    return np.interp(at, along, x), np.interp(at, along, y)


def iso_lines(z: np.ndarray, level: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines of one height through a grid (nan: no value), in index units, as arrays (i, j); closed ones end where they begin.

    Marching squares: a cell's corners above the level tell which edges the line crosses; at a saddle the mean decides.
    """
    above = z > level
    ok = ~(np.isnan(z[:-1, :-1]) | np.isnan(z[1:, :-1]) | np.isnan(z[1:, 1:]) | np.isnan(z[:-1, 1:]))
    case = above[:-1, :-1] * 1 + above[1:, :-1] * 2 + above[1:, 1:] * 4 + above[:-1, 1:] * 8
    joins: dict[tuple, list[tuple]] = {}

    def edge(i: int, j: int, k: int) -> tuple:
        return ((i, j, 0), (i + 1, j, 1), (i, j + 1, 0), (i, j, 1))[k]  # bottom, right, top, left

    for i, j in zip(*np.nonzero(ok & (case > 0) & (case < 15)), strict=True):
        i, j, c = int(i), int(j), int(case[i, j])
        if c in (5, 10):
            high = z[i : i + 2, j : j + 2].mean() > level
            pairs = ((0, 1), (2, 3)) if (c == 5) == high else ((0, 3), (1, 2))
        else:
            bits = [bool(c >> b & 1) for b in range(4)]
            crossed = [k for k in range(4) if bits[k] != bits[(k + 1) % 4]]
            pairs = (tuple(crossed),)
        for p, q in pairs:
            e, f = edge(i, j, p), edge(i, j, q)
            joins.setdefault(e, []).append(f)
            joins.setdefault(f, []).append(e)

    def place(e: tuple) -> tuple[float, float]:
        i, j, vertical = e
        a, b = z[i, j], (z[i, j + 1] if vertical else z[i + 1, j])
        t = (level - a) / (b - a)
        return (i, j + t) if vertical else (i + t, j)

    lines, used = [], set()
    for start in sorted(joins, key=lambda e: (len(joins[e]) != 1, e)):  # open lines from their ends first
        if start in used:
            continue
        line, at = [start], start
        used.add(start)
        while nxt := [e for e in joins[at] if e not in used]:
            at = nxt[0]
            used.add(at)
            line.append(at)
        if len(line) > 2 and start in joins[at]:
            line.append(start)
        xy = np.array([place(e) for e in line])
        lines.append((xy[:, 0], xy[:, 1]))
    return lines


def bessel_j1(x) -> np.ndarray:
    """J1 by its integral over half a turn, which the trapezoid rule gives to machine precision."""
    x = np.atleast_1d(np.asarray(x, float))
    n = int(64 + 2 * np.abs(x).max(initial=0))
    t = (np.arange(n) + 0.5) * math.pi / n
    return np.cos(t[None] - x.reshape(-1, 1) * np.sin(t)[None]).mean(1).reshape(x.shape)


def low_pass_weights(lat: float, dx: float, dy: float, wavelength: float, order: int = 1, kind: str = "bessel") -> np.ndarray:
    """Weights of a low-pass filter at a latitude for a grid step in degrees, by distance on the sphere in
    wavelengths (km)."""
    kx, ky = dx * math.pi / 180 * RADIUS / 1000 * math.cos(math.radians(lat)), dy * math.pi / 180 * RADIUS / 1000
    if wavelength < 2 * max(kx, ky):
        raise ValueError("the wavelength is below two cells")
    reach = wavelength * (order if kind != "loess" else 1)
    nx, ny = int(math.ceil(reach / kx)), int(math.ceil(reach / ky))
    east, north = np.meshgrid(np.radians(np.arange(-nx, nx + 1) * dx), np.radians(np.arange(-ny, ny + 1) * dy), indexing="ij")
    own = math.radians(lat)
    d = 2 * RADIUS / 1000 * np.arcsin(np.sqrt(np.minimum(np.sin(north / 2) ** 2 + math.cos(own) * np.cos(own + north) * np.sin(east / 2) ** 2, 1))) / wavelength
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "bessel":
            w = np.sinc(d / order) * bessel_j1(2 * math.pi * d) / d
            w[nx, ny] = math.pi
            w[d > order] = 0
        elif kind == "lanczos":
            w = np.sinc(d / order) * np.sinc(d)
            w[d > order] = 0
        else:
            w = np.where(d < 1, (1 - np.minimum(d, 1) ** 3) ** 3, 0)
    keep_x, keep_y = np.flatnonzero(w.any(1)), np.flatnonzero(w.any(0))
    return w[keep_x[0] : keep_x[-1] + 1, keep_y[0] : keep_y[-1] + 1]


def rk4(f, x: np.ndarray, y: np.ndarray, t0: float, t1: float) -> tuple[np.ndarray, np.ndarray]:
    """One step of fourth order of f(x, y, share of the step) -> (dx, dy) per step."""
    k1 = f(x, y, t0)
    k2 = f(x + k1[0] / 2, y + k1[1] / 2, (t0 + t1) / 2)
    k3 = f(x + k2[0] / 2, y + k2[1] / 2, (t0 + t1) / 2)
    k4 = f(x + k3[0], y + k3[1], t1)
    return x + (k1[0] + 2 * k2[0] + 2 * k3[0] + k4[0]) / 6, y + (k1[1] + 2 * k2[1] + 2 * k3[1] + k4[1]) / 6


def bilinear(z: np.ndarray, i: np.ndarray, j: np.ndarray, circular: bool = False) -> np.ndarray:
    """Values between cells; nan outside or where a corner is nan."""
    fi, fj = np.floor(i), np.floor(j)
    bad = np.isnan(i) | np.isnan(j) | (fj < 0) | (fj > z.shape[1] - 2)
    if not circular:
        bad |= (fi < 0) | (fi > z.shape[0] - 2)
    a, b = np.where(bad, 0, fi).astype(int), np.where(bad, 0, fj).astype(int)
    u, v = i - fi, j - fj
    a0, a1 = a % z.shape[0], (a + 1) % z.shape[0]
    out = (1 - u) * (1 - v) * z[a0, b] + u * (1 - v) * z[a1, b] + (1 - u) * v * z[a0, b + 1] + u * v * z[a1, b + 1]
    return np.where(bad, np.nan, out)


def bilinear_of(z: np.ndarray, k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As `bilinear`, each value from its own layer k of z."""
    fi, fj = np.floor(i), np.floor(j)
    bad = np.isnan(i) | np.isnan(j) | (fj < 0) | (fj > z.shape[2] - 2) | (fi < 0) | (fi > z.shape[1] - 2)
    a, b = np.where(bad, 0, fi).astype(int), np.where(bad, 0, fj).astype(int)
    u, v = i - fi, j - fj
    out = (1 - u) * (1 - v) * z[k, a, b] + u * (1 - v) * z[k, a + 1, b] + (1 - u) * v * z[k, a, b + 1] + u * v * z[k, a + 1, b + 1]
    return np.where(bad, np.nan, out)


def mesh_inside(x: np.ndarray, y: np.ndarray, starts: np.ndarray, step: float, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ring, x, y) of the points at multiples of step inside closed rings, by about `most` points of the mesh at a time. Ring k
    has the vertices from starts[k] to starts[k + 1]; edges at a coordinate that is not a number are none."""
    numbers = np.flatnonzero(np.diff(starts))  # rings without vertices have no mesh
    first = starts[numbers]
    with np.errstate(invalid="ignore"):
        lo_x, hi_x, lo_y, hi_y = (f.reduceat(v, first) if len(first) else np.zeros(0) for v in (x, y) for f in (np.fmin, np.fmax))
    there = ~(np.isnan(lo_x) | np.isnan(lo_y))
    numbers, first, edges = numbers[there], first[there], np.diff(starts)[numbers[there]] - 1
    i0, i1, j0, j1 = (np.floor(v[there] / step).astype(np.int64) for v in (lo_x, hi_x, lo_y, hi_y))
    wide, high = i1 - i0 + 2, j1 - j0 + 2
    # columns of the mesh, so that a ring of any size is met in parts
    of = np.repeat(np.arange(len(numbers)), wide)
    at = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide) + i0[of]
    total = np.cumsum(high[of])
    bounds = np.searchsorted(total, np.arange(most, int(total[-1]) if len(total) else 0, most))
    for part in np.split(np.arange(len(of)), np.unique(bounds)):
        if not len(part):
            continue
        n = high[of[part]]
        ring = np.repeat(of[part], n)
        px = np.repeat(at[part], n) * step
        py = (np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n) + j0[ring]) * step
        turns = np.zeros(len(ring), np.int64)
        for k in range(int(edges[of[part]].max())):
            has = slice(None) if (edges[of[part]] > k).all() else np.flatnonzero(edges[ring] > k)
            a = first[ring[has]] + k
            ax, ay, bx, by, qx, qy = x[a], y[a], x[a + 1], y[a + 1], px[has], py[has]
            side = (bx - ax) * (qy - ay) - (qx - ax) * (by - ay)
            turns[has] += ((ay <= qy) & (by > qy) & (side > 0)).astype(np.int64) - ((ay > qy) & (by <= qy) & (side < 0))
        held = turns != 0
        yield numbers[ring[held]], px[held], py[held]
