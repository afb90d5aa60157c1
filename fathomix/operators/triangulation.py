"""Linear interpolation in the Delaunay triangulation of scattered points, tile by tile, exactly.

A cell's value comes from the Delaunay triangle that its middle lies in.  No triangulation is built:
that triangle is the optimum of a small linear programme (of all triangles of points around the
middle, the one whose plane through the points lifted on a paraboloid lies lowest there), solved
by a simplex method for all cells of a tile at once.

A triangle counts if its circumcircle stays within ``reach`` cells of the cell in each direction.  Its
circle being empty, it then is a triangle of the triangulation of all points, wherever tiles begin and
end; so a halo of ``reach`` cells makes tiles exact, in one shuffle and in groups of bounded size.
Points are at most one a cell (means of the points in it, see ``centroids``).

Defined cases: points with a null or NaN are left out; of several points in a cell that with the
smallest (x, y, value) stays; where four or more points lie on one circle a fixed rule by their cells
chooses; a middle on an edge takes either triangle that counts; cells outside of all triangles, or only in large ones, give no row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Steps of the simplex method before all triples of a cell are tried instead.
TURNS = 60


def lowest_triangles(x: np.ndarray, y: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of candidates (n, k), which three give the triangle around the origin whose plane
    through their lifts is lowest there, and the origin's barycentric coordinates (n, 3).  Index -1 where
    no triangle of candidates holds the origin.  Candidates without a place are NaN."""
    n, k = x.shape
    far = 16.0 * (1.0 + np.nanmax(np.abs(np.concatenate([x.ravel(), y.ravel(), [1.0]]))))
    away = np.array([[0.0, -far], [far, far], [-far, far]])  # three helpers, so dear that they leave if they can
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(lift)
    x = np.concatenate([np.where(ok, x, 0), np.broadcast_to(away[:, 0], (n, 3))], 1)
    y = np.concatenate([np.where(ok, y, 0), np.broadcast_to(away[:, 1], (n, 3))], 1)
    lift = np.concatenate([np.where(ok, lift, np.inf), np.full((n, 3), 1e6 * far)], 1)
    basis, active = np.tile(np.arange(k, k + 3), (n, 1)), np.arange(n)
    weights = np.zeros((n, 3))
    turn = 0
    while len(active):
        if turn == TURNS:  # steps without gain, as where the middle is in line with points, may go round for ever
            break
        b = basis[active]
        bx, by, bz = (np.take_along_axis(v[active], b, 1) for v in (x, y, lift))
        ux, uy, vx, vy = bx[:, 1] - bx[:, 0], by[:, 1] - by[:, 0], bx[:, 2] - bx[:, 0], by[:, 2] - by[:, 0]
        area = ux * vy - uy * vx
        w1, w2 = (vx * by[:, 0] - vy * bx[:, 0]) / area, (uy * bx[:, 0] - ux * by[:, 0]) / area
        own = np.stack([1 - w1 - w2, w1, w2], 1)
        weights[active] = own
        # the plane's slopes, and how far each candidate lies above it
        dz1, dz2 = bz[:, 1] - bz[:, 0], bz[:, 2] - bz[:, 0]
        sx, sy = (dz1 * vy - dz2 * uy) / area, (ux * dz2 - vx * dz1) / area
        above = lift[active, :k] - bz[:, :1] - sx[:, None] * (x[active, :k] - bx[:, :1]) - sy[:, None] * (y[active, :k] - by[:, :1])
        tolerance = 1e-12 * (1 + np.abs(bz).max(1) * 1e-3)
        low = above < -tolerance[:, None]
        enter = above.argmin(1)
        go = np.flatnonzero(low[np.arange(len(active)), enter])
        active, enter, own, area = active[go], enter[go], own[go], area[go]
        px, py = x[active, enter] - bx[go, 0], y[active, enter] - by[go, 0]
        m1, m2 = (px * vy[go] - py * vx[go]) / area, (ux[go] * py - uy[go] * px) / area
        share = np.stack([1 - m1 - m2, m1, m2], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(share > 1e-13, np.maximum(own, 0) / share, np.inf)
        # of equal ratios the largest share leaves, which keeps triangles from becoming flat
        least = ratio.min(1, keepdims=True)
        leave = np.where(ratio <= least + 1e-15, share, -np.inf).argmax(1)
        basis[active, leave] = enter
        turn += 1
    flat = weights < 1e-9
    edge = flat.any(1) & (flat | (basis < k)).all(1)
    for at in np.union1d(active, np.flatnonzero(edge)):
        basis[at], weights[at] = _lowest_of_all(x[at, :k], y[at, :k], lift[at, :k])
    inside = (basis < k).all(1) & (weights > -1e-9).all(1)
    return np.where(inside[:, None], basis, -1), weights


def _lowest_of_all(x: np.ndarray, y: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one row by trying all triples.  A middle on an edge or a point is in several triangles as
    low as one another; of those with an empty circle that one with the circle nearest to the origin."""
    low, least = [], np.inf
    who = np.flatnonzero(np.isfinite(lift))
    for n, a in enumerate(who):
        b, c = (who[n + 1 :][i] for i in np.triu_indices(len(who) - n - 1, 1))
        area = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.stack([x[b] * y[c] - y[b] * x[c], x[c] * y[a] - y[c] * x[a], x[a] * y[b] - y[a] * x[b]], 1) / area[:, None]
        on = (np.abs(area) > 1e-12) & (own > -1e-9).all(1)
        three, own = np.stack([np.full(on.sum(), a), b[on], c[on]], 1), own[on]
        z = (lift[three] * own).sum(1)
        least = min(least, z.min(initial=np.inf))
        low.append((three, own, z))
    if not np.isfinite(least):
        return np.full(3, len(x)), np.zeros(3)
    three, own, z = (np.concatenate(v) for v in zip(*low))
    at = np.flatnonzero(z <= least + 1e-9 * (1 + abs(least)))
    cx, cy, rad = circles(x[three[at]], y[three[at]])
    for i in np.argsort(np.maximum(np.abs(cx), np.abs(cy)) + rad, kind="stable"):
        if not (np.hypot(x[who] - cx[i], y[who] - cy[i]) < rad[i] - 1e-9).any():
            return three[at[i]], own[at[i]]
    return three[z.argmin()], own[z.argmin()]


def circles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of the circles through three points (n, 3)."""
    bx, by, cx, cy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * (bx**2 + by**2) - by * (cx**2 + cy**2)) / d, (bx * (cx**2 + cy**2) - cx * (bx**2 + by**2)) / d
    return ux + x[:, 0], uy + y[:, 0], np.sqrt(ux * ux + uy * uy)


def _noise(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A cell's part in the rule for points on one circle: small, fixed, unlike its neighbours'."""
    h = (row.astype(np.int64) * 73856093) ^ (col.astype(np.int64) * 19349663)
    return ((h ^ (h >> 13)) * 1274126177 & 0xFFFFF) / 2.0**20 * 1e-6


def _in_reach(dx: np.ndarray, dy: np.ndarray, reach: int) -> np.ndarray:
    """Places that a circle within reach may touch; False where there is no point."""
    return (np.abs(dx) <= reach + 1e-6) & (np.abs(dy) <= reach + 1e-6)


def interpolate_cells(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray, low: tuple[int, int], size: tuple[int, int], reach: int, block: int = 4096) -> np.ndarray:
    """Values (size) of the cells from ``low`` on; points in cells up to ``reach`` around them, x and y in
    cells (a cell's middle is at half).  NaN where there is none."""
    shape = (size[0] + 2 * reach, size[1] + 2 * reach)
    r, c = row - low[0] + reach, col - low[1] + reach
    ok = (r >= 0) & (c >= 0) & (r < shape[0]) & (c < shape[1])
    grids = []
    for v in (x, y, value, _noise(row, col)):
        grids.append(np.full(shape, np.nan))
        grids[-1][r[ok], c[ok]] = v[ok]
    # a triangle that counts lies in its circle, and that within reach: points farther from the middle are no
    # candidates, and the middle must have candidates on its every side
    step = np.arange(-reach, reach + 1)
    mid_x, mid_y = np.arange(size[1]) + low[1] + 0.5, (np.arange(size[0]) + low[0] + 0.5)[:, None]
    count, most = np.zeros(size, np.int32), np.full((8, *size), -np.inf)
    for i in step + reach:
        for j in step + reach:
            dx, dy = (g[i : i + size[0], j : j + size[1]] - mid for g, mid in zip(grids, (mid_x, mid_y)))
            near = _in_reach(dx, dy, reach)
            count += near
            dx = np.where(near, dx, np.nan)
            for k, way in enumerate((dx, -dx, dy, -dy, dx + dy, dx - dy, dy - dx, -dx - dy)):
                np.fmax(most[k], way, out=most[k])
    # cells are worked on in the order of their counts, so that candidates are packed without gaps
    count = count.ravel()
    cells = np.flatnonzero((count >= 3) & (most.min(0) > -1e-6).ravel())
    cells = cells[np.argsort(count[cells], kind="stable")]
    gx, gy, gv, gn = (np.append(v, np.nan) for v in grids)  # the last one stands for no point
    around = (step[:, None] * shape[1] + step[None, :]).ravel()
    out = np.full(size[0] * size[1], np.nan)
    for lo in range(0, len(cells), block):
        q = cells[lo : lo + block]
        qr, qc = q // size[1], q % size[1]
        who = ((qr + reach) * shape[1] + qc + reach)[:, None] + around[None, :]
        i, j = np.nonzero(_in_reach(gx[who] - (qc + low[1] + 0.5)[:, None], gy[who] - (qr + low[0] + 0.5)[:, None], reach))
        packed = np.full((len(q), count[q[-1]]), -1)
        packed[i, np.arange(len(i)) - (np.cumsum(count[q]) - count[q])[i]] = who[i, j]
        who = packed
        px, py = gx[who] - (qc + low[1] + 0.5)[:, None], gy[who] - (qr + low[0] + 0.5)[:, None]
        three, weight = lowest_triangles(px, py, px**2 + py**2 + gn[who])
        found = np.flatnonzero(three[:, 0] >= 0)
        q, who, px, py, three, weight = (v[found] for v in (q, who, px, py, three, weight))
        place = np.argsort(three, 1)  # by cell: rounding doesn't depend on the way to the triangle
        three, weight = np.take_along_axis(three, place, 1), np.take_along_axis(weight, place, 1)
        tx, ty = np.take_along_axis(px, three, 1), np.take_along_axis(py, three, 1)
        cx, cy, rad = circles(tx, ty)
        near = np.maximum(np.abs(cx), np.abs(cy)) + rad <= reach
        z = (np.take_along_axis(gv[who], three, 1) * weight).sum(1)
        out[q[near]] = z[near]
    return out.reshape(size)


def centroids(points: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Points with coordinates in cells as one mean point a cell: (row, col, x, y, value, n)."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(x) + F.col(y) + F.col(value)))
    p = p.select(F.floor(F.col(y)).cast("long").alias("row"), F.floor(F.col(x)).cast("long").alias("col"), *(F.col(c).cast("double").alias(k) for c, k in ((x, "x"), (y, "y"), (value, "value"))))
    return p.groupBy("row", "col").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("value").alias("value"), F.count("*").alias("n"))


def interpolate(points: DataFrame, reach: int = 3, tile: int = 128, fill: bool = True) -> DataFrame:
    """(row, col, value, known) of every cell whose middle lies in a triangle of points (row, col, x, y,
    value); only of cells that have a point unless ``fill``.  known says whether the cell has one."""
    p = points.filter("row is not null and col is not null and x is not null and y is not null and value is not null")
    p = p.filter(~F.isnan(F.col("x") + F.col("y") + F.col("value"))).select(*(F.col(k).cast("long").alias(k) for k in ("row", "col")), *(F.col(k).cast("double").alias(k) for k in ("x", "y", "value")))
    for k in ("row", "col"):  # each point goes to the tiles whose halo it lies in, mostly one
        p = p.withColumn(f"t{k}", F.explode(F.sequence(F.floor((F.col(k) - reach) / tile), F.floor((F.col(k) + reach) / tile))))

    def one(key: tuple, d: pa.Table) -> pa.Table:
        low = (key[0].as_py() * tile, key[1].as_py() * tile)
        r, c, *p = (d[k].to_numpy() for k in ("row", "col", "x", "y", "value"))
        order = np.lexsort((*p[::-1], c, r))  # the smallest point of a cell comes first, and stays
        r, c = r[order], c[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
        r, c, order = r[new], c[new], order[new]
        got = interpolate_cells(r, c, *(v[order] for v in p), low, (tile, tile), reach)
        known = np.zeros(got.shape, bool)
        own = (r >= low[0]) & (r < low[0] + tile) & (c >= low[1]) & (c < low[1] + tile)
        known[r[own] - low[0], c[own] - low[1]] = True
        at = np.nonzero(np.isfinite(got) & (known | fill))
        return pa.table({"row": at[0] + low[0], "col": at[1] + low[1], "value": got[at], "known": known[at]})

    return p.groupBy("trow", "tcol").applyInArrow(one, "row long, col long, value double, known boolean")
