import math

import numpy as np
import pytest

from gyrelake.functions import kernels as k

SQUARE = ([2, 2, 3, 3, 2], [-10, -9, -9, -10, -10])


def test_square_ring():
    assert k.area(*map(np.array, SQUARE)) == 1
    x, y, r = k.fit_circle(*SQUARE)
    assert (x, y, r) == pytest.approx((2.5, -9.5, math.sqrt(2) / 2))
    assert k.shape_error(*SQUARE, x, y, r) == pytest.approx((1 - 2 / math.pi) * 100)


def test_degenerate_circle():
    x, y, r = k.fit_circle([1, 1, 1, 1], [2, 2, 2, 2])
    assert (x, y) == (0, -90) and math.isnan(r)


def test_simplified_ring():
    x, y = k.visvalingam([1, 2, 3, 4, 5, 6.75, 6, 1], [-0.5, -1.5, -1, -1.75, -1, -1, -0.5, -0.5], 6)
    assert x.tolist() == [1, 2, 3, 4, 6, 1] and y.tolist() == [-0.5, -1.5, -1, -1.75, -0.5, -0.5]


@pytest.mark.parametrize("seed", range(5))
def test_overlap_against_a_fine_grid(seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 2 * np.pi, 30)
    ring = lambda: (rng.uniform(-0.5, 0.5) + np.cos(t) * (1 + 0.3 * np.cos(3 * t + rng.uniform(0, 6))), np.sin(t))
    a, b = ring(), ring()
    a, b = (np.append(v[:-1], v[0]) for v in a), (np.append(v[:-1], v[0]) for v in b)
    (ax, ay), (bx, by) = a, b
    gx, gy = (v.ravel() for v in np.meshgrid(np.linspace(-2, 2, 300), np.linspace(-2, 2, 300)))
    ia, ib = k.inside(gx, gy, ax, ay), k.inside(gx, gy, bx, by)
    assert k.overlap(ax, ay, bx, by) == pytest.approx((ia & ib).sum() / (ia | ib).sum(), abs=0.02)


def test_iso_line_of_a_hill_is_one_closed_circle():
    g = np.exp(-((np.arange(21)[:, None] - 10) ** 2 + (np.arange(21)[None] - 10) ** 2) / 20)
    ((i, j),) = k.iso_lines(g, 0.5)
    assert (i[0], j[0]) == (i[-1], j[-1])
    assert np.hypot(i - 10, j - 10) == pytest.approx(np.sqrt(20 * np.log(2)), abs=0.1)


def test_bessel_function():
    assert k.bessel_j1([0, 1, 5, 20]) == pytest.approx([0, 0.4400505857, -0.3275791376, 0.0668331242], abs=1e-9)


def test_bilinear():
    z = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert k.bilinear(z, np.array([0.5, 0.75, 5.0]), np.array([0.5, 0.5, 0.0])) == pytest.approx([1.5, 2.0, np.nan], nan_ok=True)


def test_ellipse_and_hull():
    t = np.linspace(0, 2 * np.pi, 40)
    x, y, a, b, _ = k.fit_ellipse(3 * np.cos(t) + 1, 2 * np.sin(t))
    assert sorted((a, b)) == pytest.approx([2, 3]) and (x, y) == pytest.approx((1, 0), abs=1e-9)
    hx, hy = k.convex_hull([0, 1, 1, 0, 0.5], [0, 0, 1, 1, 0.5])
    assert len(hx) == 5 and k.area(hx, hy) == 1


def test_filter_keeps_a_constant_field():
    w = k.low_pass_weights(30, 0.25, 0.25, 120)
    band = np.full((40, w.shape[1]), 2.0)
    band[3, 1] = np.nan
    assert k.normalised_filter(band, w.shape[1] // 2, w, True) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        k.low_pass_weights(30, 1, 1, 50)
