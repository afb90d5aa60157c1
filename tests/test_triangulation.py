"""Interpolation by tiles against the triangulation of all points, found by trying all triples."""

import itertools

import numpy as np
import pytest

from fathomix.operators import triangulation as tg


def all_triangles(x, y):
    """Triples whose circumcircle holds no other point."""
    out = []
    for t in itertools.combinations(range(len(x)), 3):
        i = np.array(t)
        if abs((x[i[1]] - x[i[0]]) * (y[i[2]] - y[i[0]]) - (y[i[1]] - y[i[0]]) * (x[i[2]] - x[i[0]])) < 1e-12:
            continue
        cx, cy, r = (v[0] for v in tg.circles(x[None, i], y[None, i]))
        d = np.hypot(x - cx, y - cy)
        d[i] = np.inf
        if (d > r - 1e-12).all():
            out.append((i, cx, cy, r))
    return out


def searched(x, y, v, cells, reach):
    tri, out = all_triangles(x, y), {}
    for r, c in cells:
        for i, cx, cy, rad in tri:
            m = np.array([x[i], y[i], np.ones(3)])
            w = np.linalg.solve(m, [c + 0.5, r + 0.5, 1.0])
            if (w > -1e-9).all() and max(abs(cx - c - 0.5), abs(cy - r - 0.5)) + rad <= reach:
                out[r, c] = float(w @ v[i])
    return out


def scattered(n, side, seed):
    rng = np.random.default_rng(seed)
    at = rng.permutation(side * side)[:n]
    row, col = at // side - 3, at % side - 5
    return row, col, col + rng.uniform(0.05, 0.95, n), row + rng.uniform(0.05, 0.95, n), rng.normal(size=n)


@pytest.mark.parametrize("n, side, reach", [(40, 12, 3), (70, 12, 4), (25, 14, 6)])
def test_kernel_like_all_triples(n, side, reach):
    row, col, x, y, v = scattered(n, side, n)
    cells = [(r, c) for r in range(-4, side) for c in range(-6, side)]
    got = tg.interpolate_cells(row, col, x, y, v, (-4, -6), (side + 4, side + 6), reach, block=50)
    want = searched(x, y, v, cells, reach)
    found = {(r - 4, c - 6): got[r, c] for r, c in zip(*np.nonzero(np.isfinite(got)))}
    assert set(found) == set(want) and len(want) > 30
    assert [found[k] for k in sorted(want)] == pytest.approx([want[k] for k in sorted(want)], abs=1e-7)


def frame(spark, row, col, x, y, v):
    return spark.createDataFrame([tuple(map(float, z)) for z in zip(row, col, x, y, v)], "row double, col double, x double, y double, value double").selectExpr("int(row) row", "int(col) col", "x", "y", "value", "'n' AS known")


def test_tiles_do_not_show(spark):
    row, col, x, y, v = scattered(70, 12, 9)
    x[:5], y[:5] = col[:5] + 0.5, row[:5] + 0.5  # on cells' middles
    p = frame(spark, row, col, x, y, v)
    got = [{(r.row, r.col): r.value for r in tg.interpolate(p, 4, tile).collect()} for tile in (3, 5, 64)]
    assert got[0] == pytest.approx(got[2], abs=1e-9) and got[1] == pytest.approx(got[2], abs=1e-9)
    want = searched(x, y, v, [(r, c) for r in range(-5, 12) for c in range(-7, 12)], 4)
    assert got[0] == pytest.approx(want, abs=1e-7)
    known = {(r.row, r.col) for r in tg.interpolate(p, 4, 5, fill=False).collect()}
    assert known == set(zip(row.tolist(), col.tolist())) & set(want)


def test_points_on_one_circle(spark):
    """On a lattice all diagonals are possible; the rule makes tiles agree."""
    row, col = (v.ravel() for v in np.mgrid[0:9, 0:9])
    rng = np.random.default_rng(1)
    v = rng.normal(size=81)
    keep = rng.random(81) < 0.7
    p = frame(spark, *(z[keep] for z in (row, col, col + 0.25, row + 0.25, v)))
    got = [{(r.row, r.col): r.value for r in tg.interpolate(p, 5, tile).collect()} for tile in (2, 32)]
    assert len(got[1]) > 50 and got[0] == pytest.approx(got[1], abs=1e-9)


def test_planes_nulls_and_repeats(spark):
    row, col, x, y, _ = scattered(90, 12, 4)
    p = frame(spark, row, col, x, y, 2 * x - 3 * y + 1)
    p = p.unionByName(p).unionByName(spark.sql("SELECT 1 row, 1 col, double('nan') x, 1.5D y, 1D value, 'n' known UNION ALL SELECT null, 2, 1D, 1D, 5D, 'n'"))
    got = tg.interpolate(p, 4, 8).collect()
    assert len(got) > 100 and all(r.value == pytest.approx(2 * (r.col + 0.5) - 3 * (r.row + 0.5) + 1, abs=1e-6) for r in got)
    assert tg.interpolate(p.limit(0)).count() == 0
    c = tg.centroids(spark.sql("SELECT * FROM VALUES (0.25D, 0.5D, 1D), (0.75D, 0.5D, 3D), (null, 1D, 1D) AS t(x, y, v)"), "x", "y", "v").collect()
    assert [tuple(r) for r in c] == [(0, 0, 0.5, 0.5, 2.0, 2)]
