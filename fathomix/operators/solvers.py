"""Numerical kernels in NumPy, and the grouped operators that run them.

Each group is bounded by what it models (a curve has 90 points, a profile some hundred layers, a
tile a fixed number of cells), so one task's memory is too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seabed import level_array

# -- curves -----------------------------------------------------------------------------------


def smoothing_spline(x: np.ndarray, y: np.ndarray, n: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """Penalised least squares, weights n over their mean; four points or fewer pass through."""
    if len(x) <= 4:
        return y.astype(float)
    h = np.diff(x.astype(float))
    m = len(x)
    q, r = np.zeros((m, m - 2)), np.zeros((m - 2, m - 2))
    for j in range(m - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < m - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    w_inv = np.mean(n) / np.maximum(n.astype(float), 1e-12)
    g = np.linalg.solve(r + lam * q.T @ (w_inv[:, None] * q), q.T @ y)
    return y - lam * w_inv * (q @ g)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline."""
    h, m = np.diff(x), len(x)
    if m < 3:
        return np.interp(at, x, y)
    a = np.zeros((m, m))
    a[0, 0] = a[-1, -1] = 1
    b = np.zeros(m)
    for i in range(1, m - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    k = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at) - 1, 0, m - 2)
    u, v = x[i + 1] - at, at - x[i]
    return (k[i] * u**3 + k[i + 1] * v**3) / (6 * h[i]) + (y[i] / h[i] - k[i] * h[i] / 6) * u + (y[i + 1] / h[i] - k[i + 1] * h[i] / 6) * v


def spline_curves(curves: DataFrame, keys: list[str], lower: float = 3.0) -> DataFrame:
    """Curves (keys, bin, mean_db, n) smoothed from ``lower`` degrees on, raw below."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bin")
        s = smoothing_spline(p["bin"].to_numpy(), p["mean_db"].to_numpy(), p["n"].to_numpy())
        return p.assign(smooth_db=np.where(p["bin"] >= lower, s, p["mean_db"]))

    schema = curves.select(*keys, "bin", "mean_db", "n", F.lit(0.0).alias("smooth_db")).schema
    return curves.select(*keys, "bin", "mean_db", "n").groupBy(*keys).applyInPandas(one, schema)


def gsab_value(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, c, d, e, f = p
    lin = a * np.exp(-(x**2) / (2 * b * b)) + c * np.maximum(np.cos(np.radians(x)), 1e-9) ** d + e * np.exp(-(x**2) / (2 * f * f))
    return 10 * np.log10(np.maximum(lin, 1e-30))


def fit_gsab(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Six parameters by bounded, weighted Levenberg-Marquardt; levels in the parameters are dB."""
    w = np.sqrt(n / n.max())
    mean = 10 * np.log10(np.mean(10 ** (y / 10)))
    p = np.array([y.max(), 6.0, mean, 2.0, y.min(), 20.0])
    lo = np.array([y.min() - 20, 0.5, y.min() - 20, 0.0, y.min() - 40, 1.0])
    hi = np.array([y.max() + 20, 45.0, y.max() + 20, 10.0, y.max() + 20, 90.0])
    value = lambda q: gsab_value(np.array([10 ** (q[0] / 10), q[1], 10 ** (q[2] / 10), q[3], 10 ** (q[4] / 10), q[5]]), x)
    cost = lambda q: float(np.sum((w * (value(q) - y)) ** 2))
    damp, best = 1e-2, cost(p)
    for _ in range(rounds):
        base = value(p)
        jac = np.stack([(value(p + np.eye(6)[k] * 1e-4) - base) / 1e-4 for k in range(6)], 1) * w[:, None]
        step = np.linalg.lstsq(jac.T @ jac + damp * np.eye(6), jac.T @ (w * (y - base)), rcond=None)[0]
        q = np.clip(p + step, lo, hi)
        if (now := cost(q)) < best:
            p, best, damp = q, now, damp / 3
        else:
            damp = min(damp * 4, 1e8)
    return p


def gsab_curves(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Fitted parameters and the weighted root mean square of each curve."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["n"] > 0].sort_values("bin")
        x, y, n = (p[k].to_numpy(float) for k in ("bin", "mean_db", "n"))
        q = fit_gsab(x, y, n)
        e = gsab_value(np.array([10 ** (q[0] / 10), q[1], 10 ** (q[2] / 10), q[3], 10 ** (q[4] / 10), q[5]]), x) - y
        return p[keys].iloc[:1].assign(**dict(zip("abcdef", map(float, q))), rms=float(np.sqrt(np.average(e**2, weights=n))))

    schema = curves.select(*keys, *(F.lit(0.0).alias(k) for k in (*"abcdef", "rms"))).schema
    return curves.select(*keys, "bin", "mean_db", "n").groupBy(*keys).applyInPandas(one, schema)


def anneal(cost, start: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, seed: int, cycles: int = 15, each: int = 300) -> tuple[np.ndarray, float]:
    """Metropolis search, temperature 0.1 / log2(1 + cycle); outside the bounds costs 1e6."""
    rng = np.random.default_rng(seed)
    p, now = start.astype(float), cost(start)
    best, least = p, now
    for c in range(1, cycles + 1):
        t = 0.1 / math.log2(1 + c)
        for _ in range(each):
            q = p + rng.normal(size=len(p)) * step
            v = cost(q) if ((q >= low) & (q <= high)).all() else 1e6
            if v < now or rng.random() < math.exp(-(v - now) / t):
                p, now = q, v
                if now < least:
                    best, least = p, now
    return best, least


def invert_seabed(curves: DataFrame, keys: list[str], frequency: float, cycles: int = 15, each: int = 300, seed: int = 0) -> DataFrame:
    """Seabed properties (impedance, slope, second, volume_db) of each curve (bin, mean_db) by
    annealing, with the root mean square of what is left.

    A curve has a point per degree, so one is a task's small work.  Null levels don't count; a curve
    without points gives no row; the same curve and seed always give the same answer."""
    low, high = np.array([1.1, 2.0, 5.0, -45.0]), np.array([6.0, 25.0, 40.0, -5.0])

    def one(p: pd.DataFrame) -> pd.DataFrame:
        first, p = p[keys].iloc[:1], p[p["mean_db"].notna()]
        if not len(p):
            return first.iloc[:0].assign(impedance=0.0, slope=0.0, second=0.0, volume_db=0.0, rms=0.0)
        x, y = p["bin"].to_numpy(float), p["mean_db"].to_numpy(float)
        cost = lambda q: float(np.sqrt(np.mean((level_array(x, frequency, *q) - y) ** 2)))
        q, least = anneal(cost, (low + high) / 2, low, high, (high - low) / 40, seed, cycles, each)
        return first.assign(**dict(zip(("impedance", "slope", "second", "volume_db"), map(float, q))), rms=least)

    schema = curves.select(*keys, *(F.lit(0.0).alias(k) for k in ("impedance", "slope", "second", "volume_db", "rms"))).schema
    return curves.select(*keys, "bin", "mean_db").groupBy(*keys).applyInPandas(one, schema)


# -- series -----------------------------------------------------------------------------------


def butterworth(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order low-pass sections; cutoff as a share of half the sampling rate."""
    k = math.tan(math.pi * cutoff / 2)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * math.cos(math.pi * (2 * i + 1) / (2 * order)))
        d = 1 + k / q + k * k
        out.append((np.array([k * k, 2 * k * k, k * k]) / d, np.array([1, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d])))
    return out


def chebyshev2(order: int, attenuation: float, edge: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order low-pass sections of an even order that reach ``attenuation`` dB from ``edge`` on, a
    share of half the sampling rate; gain 1 at rest."""
    k = math.tan(math.pi * edge / 2)
    mu = math.asinh(math.sqrt(10 ** (attenuation / 10) - 1)) / order
    out = []
    for m in range(1, order, 2):
        turn = math.pi * m / (2 * order)
        pole = k / complex(-math.sinh(mu) * math.cos(turn), -math.cosh(mu) * math.sin(turn))
        zero = 1j * k / math.sin(turn)
        p, z = (1 + pole) / (1 - pole), (1 + zero) / (1 - zero)
        a, b = np.array([1.0, -2 * p.real, abs(p) ** 2]), np.array([1.0, -2 * z.real, abs(z) ** 2])
        out.append((b * a.sum() / b.sum(), a))
    return out


def filtfilt(sections: list[tuple[np.ndarray, np.ndarray]], v: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: forward and backward, with odd reflection at the ends."""
    pad = min(len(v) - 1, 300)
    x = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]) if pad > 0 else v
    for _ in range(2):
        for b, a in sections:
            y = np.empty_like(x, dtype=float)
            s1 = x[0] * (1 - b[0])
            s2 = x[0] * (b[2] - a[2])
            for i, u in enumerate(x):
                y[i] = b[0] * u + s1
                s1 = b[1] * u - a[1] * y[i] + s2
                s2 = b[2] * u - a[2] * y[i]
            x = y
        x = x[::-1]
    return x[pad : pad + len(v)] if pad > 0 else x


def low_pass(rows: DataFrame, keys: list[str], t: str, value: str, order: int = 4, cutoff: float = 0.1, attenuation: float | None = None) -> DataFrame:
    """Zero-phase low-pass of each series: Butterworth, or Chebyshev of the second kind if an
    attenuation in dB is given.  A series is a task's work; equal times keep any order."""
    sections = butterworth(order, cutoff) if attenuation is None else chebyshev2(order, attenuation, cutoff)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(t)
        return p.assign(filtered=filtfilt(sections, p[value].to_numpy(float)) if len(p) > 1 else p[value])

    schema = rows.select(*keys, t, value, F.lit(0.0).alias("filtered")).schema
    return rows.select(*keys, t, value).groupBy(*keys).applyInPandas(one, schema)


def tide(times: DataFrame, constituents: DataFrame, t: str = "hours", mean: float = 0.0) -> DataFrame:
    """Height as the sum of A cos(speed * t - phase), degrees; constituents are a short table."""
    c = constituents.agg(F.collect_list(F.struct("amplitude", "speed", "phase")).alias("_c"))
    j = times.crossJoin(F.broadcast(c))  # one row
    return j.withColumn("tide", F.aggregate("_c", F.lit(mean), lambda s, k: s + k["amplitude"] * F.cos(F.radians(k["speed"] * F.col(t) - k["phase"])))).drop("_c")


# -- geometry ---------------------------------------------------------------------------------


def _slope(v: np.ndarray) -> None:
    """Give layers without a gradient a negligible one, also where several follow one another."""
    for k in range(1, len(v)):
        if abs(v[k] - v[k - 1]) < 1e-6:
            v[k] = v[k - 1] + 1e-6


def ray_by_time(depths: np.ndarray, speeds: np.ndarray, seconds: np.ndarray, incidence: np.ndarray, tx_depth: float, sv_tx: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(horizontal distance, depth) of rays through layers of linear sound speed.

    Circular arcs by Snell's law; the profile starts at the transducer; a layer without gradient
    gets a negligible one; below the last depth the last speed goes on.
    """
    sv = float(np.interp(tx_depth, depths, speeds)) if sv_tx is None or not sv_tx > 0 else sv_tx
    below = depths > tx_depth
    z = np.concatenate([[tx_depth], depths[below], [12_000.0]])
    v = np.concatenate([[sv], speeds[below], [speeds[-1] if below.any() else sv]]).astype(float)
    _slope(v)
    x, depth, left = np.zeros(len(seconds)), np.full(len(seconds), tx_depth, float), seconds.astype(float).copy()
    p = np.sin(np.radians(np.abs(incidence))) / sv
    sign = np.sign(incidence)
    for i in np.flatnonzero(np.diff(z) > 0):
        g = (v[i + 1] - v[i]) / (z[i + 1] - z[i])
        c0, s1 = np.sqrt(np.maximum(0, 1 - (p * v[i]) ** 2)), np.minimum(1, p * v[i + 1])
        c1 = np.sqrt(1 - s1**2)
        dt = np.abs(np.log((v[i + 1] * (1 + c0)) / (v[i] * (1 + c1))) / g)
        whole, part = left >= dt, (left > 0) & (left < dt)
        flat = p < 1e-12
        dx = np.where(flat, 0.0, (c0 - c1) / np.where(flat, 1, p * g))
        x[whole] += dx[whole]
        depth[whole] = z[i + 1]
        if part.any():
            t0 = np.tan(np.arcsin(np.clip(p[part] * v[i], 0, 1)) / 2)
            th = 2 * np.arctan(t0 * np.exp(g * left[part]))
            ve = np.where(flat[part], v[i] * np.exp(g * left[part]), np.sin(th) / np.where(flat[part], 1, p[part]))
            depth[part] = z[i] + (ve - v[i]) / g
            x[part] += np.where(flat[part], 0.0, (c0[part] - np.cos(th)) / np.where(flat[part], 1, p[part] * g))
        left = np.where(whole, left - dt, 0.0)
    return x * sign, depth


def ray_by_depth(depths: np.ndarray, speeds: np.ndarray, target: np.ndarray, incidence: np.ndarray, tx_depth: float) -> tuple[np.ndarray, np.ndarray]:
    """(horizontal distance, seconds) of rays down to the target depths, through the layers of
    ``ray_by_time``; null above the transducer or where the ray has turned before."""
    sv = float(np.interp(tx_depth, depths, speeds))
    below = depths > tx_depth
    z = np.concatenate([[tx_depth], depths[below], [12_000.0]])
    v = np.concatenate([[sv], speeds[below], [speeds[-1] if below.any() else sv]]).astype(float)
    _slope(v)
    p = np.sin(np.radians(np.abs(incidence))) / sv
    x, t = np.zeros(len(target)), np.zeros(len(target))
    lost = target < tx_depth
    for i in np.flatnonzero(np.diff(z) > 0):
        g = (v[i + 1] - v[i]) / (z[i + 1] - z[i])
        end = np.clip(target, z[i], z[i + 1])
        ve = v[i] + g * (end - z[i])
        lost = lost | ((end > z[i]) & (p * np.maximum(v[i], ve) >= 1))
        c0, c1 = (np.sqrt(np.maximum(0, 1 - (p * w) ** 2)) for w in (v[i], ve))
        flat = p < 1e-12
        x += np.where(flat, 0.0, (c0 - c1) / np.where(flat, 1, p * g))
        t += np.abs(np.log(ve * (1 + c0) / (v[i] * (1 + c1))) / g)
    nan = np.where(lost, np.nan, 1.0)
    return x * np.sign(incidence) * nan, t * nan


def trace_to_depth(beams: DataFrame, depths: list[float], speeds: list[float], tx_depth: float) -> DataFrame:
    """beams (id, depth, incidence) with x and seconds; one profile, Arrow batches."""
    d, s = np.array(depths, float), np.array(speeds, float)

    def run(batches):
        for p in batches:
            x, t = ray_by_depth(d, s, p["depth"].to_numpy(float), p["incidence"].to_numpy(float), tx_depth)
            yield p.assign(x=x, seconds=t)

    return beams.select("id", "depth", "incidence").mapInPandas(run, beams.select("id", "depth", "incidence", F.lit(0.0).alias("x"), F.lit(0.0).alias("seconds")).schema)


def trace_rays(beams: DataFrame, depths: list[float], speeds: list[float], tx_depth: float) -> DataFrame:
    """beams (id, seconds, incidence) with x and depth; one profile, Arrow batches."""
    d, s = np.array(depths, float), np.array(speeds, float)

    def run(batches):
        for p in batches:
            x, z = ray_by_time(d, s, p["seconds"].to_numpy(float), p["incidence"].to_numpy(float), tx_depth)
            yield p.assign(x=x, depth=z)

    return beams.select("id", "seconds", "incidence").mapInPandas(run, beams.select("id", "seconds", "incidence", F.lit(0.0).alias("x"), F.lit(0.0).alias("depth")).schema)


def beam_vector(tx_steer: float, rx_steer: float, delta: float) -> tuple[float, float, float]:
    """Direction where a transmit and a receive cone meet, arrays at delta from the right angle."""
    y = -math.sin(rx_steer) / math.cos(delta) + math.sin(tx_steer) * math.tan(delta)
    x = math.sin(tx_steer)
    return x, y, math.sqrt(max(0.0, 1 - x * x - y * y))


def best_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, float, float, float]:
    """Unit normal (upwards) and distance of the plane of least squared distances."""
    pts = np.stack([x, y, z], 1).astype(float)
    mid = pts.mean(0)
    n = np.linalg.svd(pts - mid, full_matrices=False)[2][-1]
    n = n if n[2] >= 0 else -n
    return float(n[0]), float(n[1]), float(n[2]), float(n @ mid)


def planes(points: DataFrame, key: str) -> DataFrame:
    """Best plane of each key's points (x, y, z); three or more."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) < 3:
            return pd.DataFrame({key: p[key].iloc[:0], "a": [], "b": [], "c": [], "d": []})
        a, b, c, d = best_plane(p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy())
        return pd.DataFrame({key: p[key].iloc[:1], "a": a, "b": b, "c": c, "d": d})

    return points.select(key, "x", "y", "z").groupBy(key).applyInPandas(one, points.select(key, *(F.lit(0.0).alias(k) for k in "abcd")).schema)


def procrustes(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(rotation in degrees, shift, root mean square) that lays source on target."""
    ms, mt = source.mean(0), target.mean(0)
    u, _, vt = np.linalg.svd((source - ms).T @ (target - mt))
    flip = np.diag([1.0, np.sign(np.linalg.det((u @ vt).T))])
    rot = (u @ flip @ vt).T
    shift = mt - rot @ ms
    return math.degrees(math.atan2(rot[1, 0], rot[0, 0])), shift, float(np.sqrt(np.mean(np.sum((source @ rot.T + shift - target) ** 2, 1))))


def roots(coefficients: list[float]) -> np.ndarray:
    """Real roots of a polynomial, highest power first, in ascending order."""
    r = np.roots(np.trim_zeros(coefficients, "f"))
    return np.sort(r[np.abs(r.imag) < 1e-9 * (1 + np.abs(r.real))].real)


# -- tiles ------------------------------------------------------------------------------------


def with_tiles(grid: DataFrame, size: int, halo: int) -> DataFrame:
    """Cells with the tiles they belong to (own) or border on: a cell of a halo is sent to each
    neighbour tile, so a tile's task needs no other tile."""
    near = lambda k: F.sequence(F.floor((F.col(k) - halo) / size), F.floor((F.col(k) + halo) / size))
    t = grid.withColumn("_tr", F.explode(near("row"))).withColumn("_tc", F.explode(near("col")))
    return t.withColumn("_own", (F.floor(F.col("row") / size) == F.col("_tr")) & (F.floor(F.col("col") / size) == F.col("_tc")))


def quadrant_fill(values: np.ndarray, reach: int) -> np.ndarray:
    """Missing cells from the nearest value of each quadrant within reach, inverse-distance
    weighted, where three quadrants or more have one; of equals the one further south, then west.

    All cells look at one offset at a time, the nearest offsets first."""
    hole = np.isnan(values)
    wide = np.pad(values, reach, constant_values=np.nan)
    rows, cols = values.shape
    total, weight = np.zeros(values.shape), np.zeros(values.shape)
    have = np.zeros((4, *values.shape), bool)
    span = range(-reach, reach + 1)
    for d, i, j in sorted((i * i + j * j, i, j) for i in span for j in span if i or j):
        v = wide[reach + i : reach + i + rows, reach + j : reach + j + cols]
        q = 2 * (i + j >= 0) + (i - j >= 0)
        new = hole & ~have[q] & ~np.isnan(v)
        have[q] |= new
        total[new] += v[new] / d
        weight[new] += 1 / d
    ok = hole & (have.sum(0) >= 3)
    return np.where(ok, total / np.where(ok, weight, 1.0), values)


def harmonic_fills(values: np.ndarray, rounds: int = 400) -> np.ndarray:
    """``harmonic_fill`` of a stack of arrays of one shape.  Sweeps that change nothing end it."""
    hole = np.isnan(values)
    known = (~hole).any((1, 2))
    means = np.array([np.nanmean(v) if k else 0.0 for v, k in zip(values, known)])
    out = np.where(hole, means[:, None, None], values)
    quarter, fixed, plain = hole * 0.25, np.where(hole, 0.0, out), np.isfinite(out).all()
    p, s = np.pad(out, ((0, 0), (1, 1), (1, 1)), mode="edge"), np.empty_like(out)
    for k in range(rounds if hole.any() else 0):
        np.add(p[:, :-2, 1:-1], p[:, 2:, 1:-1], out=s)
        s += p[:, 1:-1, :-2]
        s += p[:, 1:-1, 2:]
        if plain:
            s *= quarter
            s += fixed
        else:
            s = np.where(hole, s / 4, out)
        if k % 16 == 15 and np.array_equal(s, p[:, 1:-1, 1:-1]):
            break
        p[:, 1:-1, 1:-1] = s
        p[:, 0, 1:-1], p[:, -1, 1:-1], p[:, 1:-1, 0], p[:, 1:-1, -1] = s[:, 0], s[:, -1], s[:, :, 0], s[:, :, -1]
    return p[:, 1:-1, 1:-1]


def harmonic_fill(values: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Missing cells by Laplace's equation from the cells around them."""
    return harmonic_fills(values[None], rounds)[0]


def fill_gaps(grid: DataFrame, layer: str, reach: int = 3, size: int = 128, how: str = "quadrant") -> DataFrame:
    """Missing cells inside the grid filled tile by tile: (row, col, value, flag 1).

    A tile's array is the box of its cells and of those within reach.  Tiles come in squares of some
    256 cells: cells are sent to a square once, and its tiles of one shape are swept together."""
    side = max(1, 256 // size) * size
    wide, at_once = side + 2 * reach, 8

    def one(key: tuple, t: pa.Table) -> pa.Table:
        top, left = (k.as_py() * side - reach for k in key)
        r, c = t["row"].to_numpy() - top, t["col"].to_numpy() - left
        a, there = np.full((wide, wide), np.nan), np.zeros((wide, wide), bool)
        a[r, c], there[r, c] = t[layer].to_numpy(), True
        todo: dict[tuple, list] = {}
        for i in range(0, side, size):
            for j in range(0, side, size):
                box = there[i : i + size + 2 * reach, j : j + size + 2 * reach]
                rows, cols = np.flatnonzero(box.any(1)), np.flatnonzero(box.any(0))
                if not len(rows):
                    continue
                r0, r1, c0, c1 = i + rows[0], i + rows[-1] + 1, j + cols[0], j + cols[-1] + 1
                own = np.zeros((r1 - r0, c1 - c0), bool)
                own[max(0, i + reach - r0) : max(0, i + reach + size - r0), max(0, j + reach - c0) : max(0, j + reach + size - c0)] = True
                own &= np.isnan(a[r0:r1, c0:c1])
                if own.any():
                    todo.setdefault(own.shape, []).append((r0, c0, own))
        out: list[list] = [[], [], []]
        for (h, w), tiles in todo.items():
            for k in range(0, len(tiles), at_once):
                some = tiles[k : k + at_once]
                arrays = np.stack([a[r0 : r0 + h, c0 : c0 + w] for r0, c0, _ in some])
                filled = np.stack([quadrant_fill(v, reach) for v in arrays]) if how == "quadrant" else harmonic_fills(arrays)
                for (r0, c0, own), v in zip(some, filled):
                    y, x = np.nonzero(own & ~np.isnan(v))
                    for o, new in zip(out, (y + r0 + top, x + c0 + left, v[y, x])):
                        o.append(new)
        row, col, value = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32)), "value": pa.array(value, pa.float64()), "flag": pa.array(np.ones(len(row), np.int32))})

    tiles = with_tiles(grid.select("row", "col", F.col(layer).cast("double").alias(layer)), side, reach).drop("_own")
    return tiles.groupBy("_tr", "_tc").applyInArrow(one, "row int, col int, value double, flag int")


def isolation_scores(x: np.ndarray, seed: int, trees: int = 50, sample: int = 256) -> np.ndarray:
    """Isolation-forest scores of rows, seeded."""
    rng = np.random.default_rng(seed)
    depth, n = np.zeros(len(x)), min(sample, len(x))
    norm = lambda k: 2 * (math.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k if k > 2 else float(k > 1)

    def walk(train: np.ndarray, rows: np.ndarray, level: int, limit: int) -> None:
        if level >= limit or len(train) <= 1:
            depth[rows] += level + norm(len(train))
            return
        k = int(rng.integers(x.shape[1]))
        lo, hi = train[:, k].min(), train[:, k].max()
        if lo == hi:
            depth[rows] += level + norm(len(train))
            return
        cut = rng.uniform(lo, hi)
        left = x[rows, k] < cut
        walk(train[train[:, k] < cut], rows[left], level + 1, limit)
        walk(train[train[:, k] >= cut], rows[~left], level + 1, limit)

    for _ in range(trees):
        walk(x[rng.choice(len(x), n, replace=False)], np.arange(len(x)), 0, math.ceil(math.log2(max(n, 2))))
    return 2 ** (-depth / trees / max(norm(n), 1e-9))


def outliers(points: DataFrame, key: list[str], contamination: float = 0.05, seed: int = 0) -> DataFrame:
    """Points (key, id, x, y, z) with the share of ``contamination`` that isolates first marked."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        s = isolation_scores(p[["x", "y", "z"]].to_numpy(float), seed) if len(p) > 2 else np.zeros(len(p))
        return p[[*key, "id"]].assign(score=s, outlier=s > np.quantile(s, 1 - contamination) if len(p) > 2 else False)

    return points.select(*key, "id", "x", "y", "z").groupBy(*key).applyInPandas(one, points.select(*key, "id", F.lit(0.0).alias("score"), F.lit(True).alias("outlier")).schema)
