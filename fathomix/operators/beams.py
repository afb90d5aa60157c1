"""Beams of two arrays: where their footprints cross, where they point to, where they land.

A transmit array sends a cone about its axis, a receive array listens on another one.  On a plane
below them both cones are hyperbola branches (lines where an array isn't steered); a beam's footprint
is where the branches cross.  From travel time and a sound-speed profile the plane's depth follows
by iteration; with the platform's attitude that gives the sounding's place.

Frames: x forward, y starboard, z down, angles in degrees.  ``delta`` is how far the receive array is
from the right angle to the transmit array.  Everything is solved for all beams of a group at once in
arrays, in batches of bounded size.

Defined cases: a beam with a null or impossible input (cones that don't meet, a ray that turns before
the bottom, a ping before the first profile) has null results; repeated rows are solved alike; an empty
table gives no rows; columns of beams other than those named pass through unless they bear the names
of results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof

# -- hyperbolas -----------------------------------------------------------------------------------


def _in_frame(dx: np.ndarray, dy: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector in a frame turned by ``turn`` radians."""
    return np.cos(turn) * dx + np.sin(turn) * dy, np.cos(turn) * dy - np.sin(turn) * dx


def branch_crossings(c1, a1, b1, turn1, c2, a2, b2, turn2, near) -> np.ndarray:
    """Where two hyperbola branches cross, one point (x, y) each pair; NaN where they don't.

    A branch has a centre, half axes a and b and the turn of its focal axis; it is the one on the
    side of a's sign, and the line through the centre at a right angle to the focal axis if a is 0.
    Of several crossings the one nearest to the point ``near`` is taken.

    On the first branch x = a cosh s and y = b sinh s.  With e = exp(s) the second branch's equation
    is a quartic in e; its positive roots on the right side of the second centre are crossings."""
    c1, c2, near = (np.asarray(v, float).reshape(-1, 2) for v in (c1, c2, near))
    a1, b1, turn1, a2, b2, turn2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (a1, b1, turn1, a2, b2, turn2)))
    n = max(len(c1), len(c2), a1.size, len(near))
    c1, c2, near = (np.broadcast_to(v, (n, 2)) for v in (c1, c2, near))
    a1, b1, turn1, a2, b2, turn2 = (np.broadcast_to(v, (n,)) for v in (a1, b1, turn1, a2, b2, turn2))
    unit = np.abs(b2)
    # the second frame's coordinates of the first branch, times e, as coefficients of 1, e, e²
    (ax, ay), (bx, by) = _in_frame(a1 * np.cos(turn1), a1 * np.sin(turn1), turn2), _in_frame(-b1 * np.sin(turn1), b1 * np.cos(turn1), turn2)
    ox, oy = _in_frame(c1[:, 0] - c2[:, 0], c1[:, 1] - c2[:, 1], turn2)
    x = np.stack([(ax - bx) / 2, ox, (ax + bx) / 2]) / unit
    y = np.stack([(ay - by) / 2, oy, (ay + by) / 2]) / unit
    k = a2 / unit
    square = lambda v: np.stack([v[0] ** 2, 2 * v[0] * v[1], v[1] ** 2 + 2 * v[0] * v[2], 2 * v[1] * v[2], v[2] ** 2])
    quartic = square(x) - k**2 * square(y)
    quartic[2] -= k**2
    good = np.isfinite(quartic).all(0)
    quartic = np.where(good, quartic, 1.0)
    roots = np.concatenate([_roots(quartic), 1 / _roots(quartic[::-1])], 1)  # either end may vanish
    with np.errstate(all="ignore"):
        real = np.where((np.abs(roots.imag) < 1e-3 * np.abs(roots)) & (roots.real > 0), roots.real, np.nan)
        s = np.log(real)

        def miss(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Signed distance along the focal axis from the second branch, and its slope."""
            e, f = np.exp(s), np.exp(-s)
            px, py = (v[0][:, None] * f + v[1][:, None] + v[2][:, None] * e for v in (x, y))
            dx, dy = (v[2][:, None] * e - v[0][:, None] * f for v in (x, y))
            root = np.sqrt(1 + py**2)
            return px - k[:, None] * root, dx - k[:, None] * py * dy / root

        for _ in range(6):
            g, slope = miss(s)
            s = s - np.clip(g / slope, -1, 1)
        g, slope = miss(s)
        size = np.maximum(1.0, np.abs(np.exp(np.abs(s)) * np.abs(x).max(0)[:, None]))
        s = np.where(np.abs(g) < 1e-9 * size, s, np.nan)
        lx, ly = a1[:, None] * np.cosh(s), b1[:, None] * np.sinh(s)
        px = c1[:, :1] + np.cos(turn1)[:, None] * lx - np.sin(turn1)[:, None] * ly
        py = c1[:, 1:] + np.sin(turn1)[:, None] * lx + np.cos(turn1)[:, None] * ly
        far = np.hypot(px - near[:, :1], py - near[:, 1:])
    far = np.where(np.isfinite(far) & good[:, None], far, np.inf)
    best = far.argmin(1)
    at = np.arange(n)
    return np.where(np.isfinite(far[at, best])[:, None], np.stack([px[at, best], py[at, best]], 1), np.nan)


def _roots(c: np.ndarray) -> np.ndarray:
    """Four complex roots of each quartic; coefficients from the constant on.  NaN where the leading
    coefficient is next to nothing."""
    lead = c[4]
    scale = np.abs(c).max(0)
    tiny = np.abs(lead) <= 1e-13 * scale
    monic = c[:4] / np.where(tiny, 1.0, lead)
    m = np.zeros((c.shape[1], 4, 4))
    m[:, 1:, :3] = np.eye(3)
    m[:, :, 3] = -monic.T
    m[tiny] = 0
    out = np.linalg.eigvals(m)
    return np.where(tiny[:, None] | (out == 0), np.nan, out)


def concentric(tx: np.ndarray, rx: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Unit vectors (n, 3) where the cones would meet if both arrays were in one place; NaN where
    they don't."""
    t, r, d = (np.radians(np.asarray(v, float)) for v in (tx, rx, delta))
    x = np.sin(t)
    y = x * np.tan(d) - np.sin(r) / np.cos(d)
    with np.errstate(invalid="ignore"):
        return np.stack(np.broadcast_arrays(x, y, np.sqrt(1 - x * x - y * y)), 1)


def footprints(depth: np.ndarray, tx: np.ndarray, rx: np.ndarray, delta: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where both cones meet on a plane ``depth`` below the transmit array; ``apart`` (n, 3) is the
    receive array's place."""
    t, r, d = (np.radians(np.asarray(v, float)) for v in (tx, rx, delta))
    depth, apart = np.asarray(depth, float), np.asarray(apart, float).reshape(-1, 3)
    way = concentric(tx, rx, delta)
    with np.errstate(all="ignore"):
        near = np.nan_to_num(way[:, :2] / way[:, 2:] * depth.reshape(-1, 1))
        low = depth - apart[:, 2]
        ok = (depth > 0) & (low > 0)
    safe, low = np.where(ok, depth, 1.0), np.where(ok, low, 1.0)
    zero = np.zeros((len(near), 2))
    found = branch_crossings(zero, safe * np.tan(t), safe, 0.0, apart[:, :2], low * np.tan(-r), low, d + np.pi / 2, near)
    return np.where(ok[:, None], found, np.nan)


# -- rays -----------------------------------------------------------------------------------------


def rays(depths: np.ndarray, speeds: np.ndarray, start: np.ndarray, speed: np.ndarray, target: np.ndarray, incidence: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distance, seconds, speed, incidence) at the target depths of rays that leave at depth
    ``start`` with ``speed`` there (NaN: the profile's).

    Sound speed is linear from the start to the profile's next depth and between its depths, and
    constant below the last; rays obey Snell's law.  NaN where a ray turns before, or goes up."""
    depths, speeds = np.asarray(depths, float), np.asarray(speeds, float)
    start, target, incidence = (np.asarray(v, float) for v in (start, target, incidence))
    speed = np.where(np.isnan(speed), np.interp(start, depths, speeds), speed)
    p = np.sin(np.radians(incidence)) / speed
    x, t, here = np.zeros_like(start), np.zeros_like(start), speed.copy()
    lost = ~(target >= start) | ~(np.abs(incidence) < 90)
    edges = np.concatenate([[-np.inf], depths, [np.inf]])
    ends = np.concatenate([speeds[:1], speeds, speeds[-1:]])
    with np.errstate(all="ignore"):
        for k in range(len(edges) - 1):
            top, full = np.maximum(edges[k], start), edges[k + 1]
            low = np.minimum(full, target)
            h = low - top
            on = h > 0
            c0 = np.where(start > edges[k], speed, ends[k])
            g = (ends[k + 1] - c0) / (full - top) if np.isfinite(full) else np.zeros_like(c0)
            c1 = c0 + g * h
            s0, s1 = p * c0, p * c1
            lost |= on & (np.maximum(np.abs(s0), np.abs(s1)) >= 1)
            q0, q1 = np.sqrt(1 - s0**2), np.sqrt(1 - s1**2)
            # both forms stay exact where speed or angle hardly change
            x += np.where(on, h * (s0 + s1) / (q0 + q1), 0)
            turn = np.log1p((c1 - c0) / c0) + np.log1p(q0) - np.log1p(q1)
            t += np.where(on, np.where(np.abs(c1 - c0) < 1e-7 * c0, h * 2 / ((c0 + c1) * (q0 + q1) / 2), turn / np.where(g == 0, 1, g)), 0)
            here = np.where(on, c1, here)
    bad = np.where(lost, np.nan, 1.0)
    return x * bad, t * bad, here * bad, np.degrees(np.arcsin(np.clip(p * here, -1, 1))) * bad


def turned(v: np.ndarray, roll: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """Vectors (n, 3) of the arrays in the level frame: rolled about x, then pitched about y."""
    a, b = np.radians(roll), np.radians(pitch)
    x, y, z = v.T
    y, z = np.cos(a) * y - np.sin(a) * z, np.sin(a) * y + np.cos(a) * z
    return np.stack([np.cos(b) * x + np.sin(b) * z, y, np.cos(b) * z - np.sin(b) * x], 1)


def aim(method: str, seconds: np.ndarray, tx: np.ndarray, rx: np.ndarray, delta: np.ndarray, apart: np.ndarray, roll: np.ndarray, pitch: np.ndarray, depth: np.ndarray, speed: np.ndarray, depths: np.ndarray, speeds: np.ndarray, tolerance: float = 1e-6, most: int = 10) -> dict[str, np.ndarray]:
    """Beams from two-way times: incidence, azimuth, one_way (seconds from the transmit array) and the
    sounding's x, y, z from it, in the level frame.

    ``method`` is "cones" (crossing of the footprints on a plane), "triangles" (slant ranges along both
    arrays) or "concentric" (the receive array's place is ignored).  The plane's depth, or the ranges,
    are changed by what the traced two-way time is short of, until that is below ``tolerance`` for
    every beam or ``most`` rounds are done."""
    apart = np.asarray(apart, float).reshape(-1, 3)
    speed = np.where(np.isnan(speed), np.interp(depth, depths, speeds), speed)
    way = concentric(tx, rx, delta)
    reach = seconds / 2 * speed
    t, r, d = (np.radians(np.asarray(v, float)) for v in (tx, rx, delta))
    if method == "concentric":
        apart = np.zeros_like(apart)
    first = way * reach[:, None]
    plane, near = first[:, 2].copy(), np.sqrt(((first - apart) ** 2).sum(1))
    rx_depth = depth + turned(apart, roll, pitch)[:, 2]
    out = {k: np.full(len(seconds), np.nan) for k in ("incidence", "azimuth", "one_way", "x", "y", "z")}
    open_ = np.isfinite(plane) & np.isfinite(depth) & np.isfinite(roll) & np.isfinite(pitch)
    for _ in range(most):
        if not open_.any():
            break
        i = np.flatnonzero(open_)
        if method == "triangles":
            x = reach[i] * np.sin(t[i])
            y = -near[i] * np.sin(r[i]) / np.cos(d[i]) + (x - apart[i, 0]) * np.tan(d[i]) + apart[i, 1]
            with np.errstate(invalid="ignore"):
                v = np.stack([x, y, np.sqrt(reach[i] ** 2 - x**2 - y**2)], 1)
        elif method == "cones":
            v = np.column_stack([footprints(plane[i], np.asarray(tx)[i], np.asarray(rx)[i], np.asarray(delta)[i], apart[i]), plane[i]])
        else:
            v = way[i] * reach[i, None]
        out_v, back_v = turned(v, roll[i], pitch[i]), turned(v - apart[i], roll[i], pitch[i])
        flat, back = np.hypot(out_v[:, 0], out_v[:, 1]), np.hypot(back_v[:, 0], back_v[:, 1])
        inc = np.degrees(np.arctan2(flat, out_v[:, 2]))
        along, down, c, end = rays(depths, speeds, depth[i], speed[i], depth[i] + out_v[:, 2], inc)
        _, up, _, _ = rays(depths, speeds, rx_depth[i], speed[i], rx_depth[i] + back_v[:, 2], np.degrees(np.arctan2(back, back_v[:, 2])))
        short = seconds[i] - down - up
        azimuth = np.arctan2(out_v[:, 1], out_v[:, 0])
        done = {"incidence": inc, "azimuth": np.degrees(azimuth), "one_way": down, "x": along * np.cos(azimuth), "y": along * np.sin(azimuth), "z": out_v[:, 2]}
        for k, value in done.items():
            out[k][i] = np.where(np.isfinite(short), value, np.nan)
        with np.errstate(invalid="ignore"):
            more = np.isfinite(short) & (np.abs(short) > tolerance)
        step = np.where(more, short / 2 * c, 0)
        plane[i] += step * np.cos(np.radians(np.nan_to_num(end)))
        reach[i] += step
        near[i] += step
        open_[i] = more
    return out


# -- on tables --------------------------------------------------------------------------------------

INPUTS = ["seconds", "tx_steer", "rx_steer", "delta", "sx", "sy", "sz", "roll", "pitch", "tx_depth", "speed"]
RESULTS = ["incidence", "azimuth", "one_way", "x", "y", "z"]


def footprint_table(beams: DataFrame, depth: str = "depth") -> DataFrame:
    """beams (tx_steer, rx_steer, delta, sx, sy, sz and the plane's depth) with fx, fy; Arrow batches,
    no shuffle."""
    need = [depth, "tx_steer", "rx_steer", "delta", "sx", "sy", "sz"]
    rest = [c for c in beams.columns if c not in ("fx", "fy")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            z, tx, rx, d, *apart = (p[c].to_numpy(float) for c in need)
            xy = footprints(z, tx, rx, d, np.stack(apart, 1)) if len(p) else np.zeros((0, 2))
            yield p.assign(fx=_nulls(xy[:, 0]), fy=_nulls(xy[:, 1]))

    rows = beams.select(*rest)
    return rows.mapInPandas(run, rows.withColumns({"fx": F.lit(None).cast("double"), "fy": F.lit(None).cast("double")}).schema)


def _nulls(v: np.ndarray) -> pd.Series:
    """NaN as null."""
    return pd.Series(v).astype(object).where(np.isfinite(v), None) if not np.isfinite(v).all() else pd.Series(v)


#: Rows and bytes that a worker solves at once, profiles and their layers, and distinct times that are broadcast.
AT_ONCE, BYTES_AT_ONCE = 1 << 16, 1 << 26
FEW_PROFILES, FEW_LAYERS, FEW_TIMES = 256, 20_000, 200_000


def launch(beams: DataFrame, profiles: DataFrame, t: str, slab: int, method: str = "cones") -> DataFrame:
    """beams (profile, INPUTS, and time t, a whole number) with RESULTS by the profile's layers.

    ``profiles`` is (profile, depth, speed), a row a layer; of layers at one depth that of the least speed counts.
    Few profiles are broadcast and beams stay where they are; else beams of one profile are cut into slabs
    of time, so that a profile that holds for very long is no single task's load.  A task solves its
    beams in batches, so what a worker holds doesn't grow with the table."""
    rest = [c for c in beams.columns if c not in RESULTS]
    b = beams.select(*rest)
    layers = profiles.select(F.col("profile").alias("_of"), F.col("depth").cast("double").alias("d"), F.col("speed").cast("double").alias("s"))
    layers = layers.filter("_of is not null and d is not null and s is not null and not isnan(d) and not isnan(s)")
    layers = layers.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("_l")).select("_of", F.col("_l.d").alias("_depths"), F.col("_l.s").alias("_speeds"))
    many = layers.agg(F.count("*"), F.sum(F.size("_depths"))).first()
    if many[0] <= FEW_PROFILES and (many[1] or 0) <= FEW_LAYERS:
        b = b.join(F.broadcast(layers), F.col("profile") == F.col("_of"), "left").drop("_of")
    else:
        b = b.withColumn("_slab", F.floor(F.col(t) / slab))
        used = b.select(F.col("profile").alias("_profile"), F.col("_slab").alias("_part")).distinct()
        layers = layers.join(used, F.col("_of") == F.col("_profile")).drop("_of")
        b = b.join(layers, F.col("profile").eqNullSafe(F.col("_profile")) & F.col("_slab").eqNullSafe(F.col("_part")), "left").sortWithinPartitions("profile", "_slab").drop("_profile", "_part", "_slab")

    def solved(p: pa.Table) -> pa.Table:
        v = {k: p[k].cast(pa.float64()).to_numpy() for k in INPUTS}
        out = {k: np.full(len(p), np.nan) for k in RESULTS}
        codes = p["profile"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.argsort(codes, kind="stable")
        for i in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            depths, speeds = (p[k][int(i[0])].values for k in ("_depths", "_speeds"))
            if depths is None or not len(depths):
                continue
            depths, new = np.unique(depths.to_numpy(), return_index=True)
            x = {k: w[i] for k, w in v.items()}
            found = aim(method, x["seconds"], x["tx_steer"], x["rx_steer"], x["delta"], np.stack([x["sx"], x["sy"], x["sz"]], 1), x["roll"], x["pitch"], x["tx_depth"], x["speed"], depths, speeds.to_numpy()[new])
            for k in RESULTS:
                out[k][i] = found[k]
        p = p.drop_columns(["_depths", "_speeds"])
        for k in RESULTS:
            p = p.append_column(k, pa.array(out[k], mask=~np.isfinite(out[k])))
        return p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= AT_ONCE or sum(h.nbytes for h in held) >= BYTES_AT_ONCE:
                yield from solved(pa.Table.from_batches(held)).to_batches()
                held = []
        if sum(h.num_rows for h in held):
            yield from solved(pa.Table.from_batches(held)).to_batches()

    return b.mapInArrow(run, beams.select(*rest).withColumns({k: F.lit(None).cast("double") for k in RESULTS}).schema)


def by_times(pings: DataFrame, keys: list[str], t: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pings with the columns that ``add`` gives to their distinct keys and times.  Many beams share a
    ping's time, so the table that ``add`` deals and orders is small; where it is, it is broadcast."""
    got = add(pings.select(*keys, t).distinct())
    new = [k for k in got.columns if k not in (*keys, t)]
    got = got.select(*(F.col(k).alias(f"_by_{k}") for k in (*keys, t)), *new)
    few = got.select(f"_by_{t}").limit(FEW_TIMES + 1).count() <= FEW_TIMES
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in (*keys, t)]
    return pings.drop(*new).join(F.broadcast(got) if few else got, on, "left").drop(*(f"_by_{k}" for k in (*keys, t)))


def with_profile(pings: DataFrame, taken: DataFrame, keys: list[str], t: str, slab: int | None = None) -> DataFrame:
    """pings with the profile that was taken last at or before their time; the first one before that."""
    return by_times(pings, keys, t, lambda d: asof(d, taken, keys, t, "profile", edges="first", slab=slab))


def with_attitude(pings: DataFrame, attitude: DataFrame, keys: list[str], t: str, columns: tuple[str, ...] = ("roll", "pitch", "heave"), slab: int | None = None) -> DataFrame:
    """pings with the attitude (columns) interpolated at their time; null outside of its span."""
    return by_times(pings, keys, t, lambda d: _attitude(d, attitude, keys, t, columns, slab))


def _attitude(times: DataFrame, attitude: DataFrame, keys: list[str], t: str, columns: tuple[str, ...], slab: int | None) -> DataFrame:
    """Each row of attitude is joined with the next one, so times meet both in one as-of join; rows with a
    null are left out, and of rows of one time the least counts."""
    one = attitude.dropna(subset=[t, *columns]).groupBy(*keys, t).agg(F.min(F.struct(*(F.col(k).cast("double").alias(k) for k in columns))).alias("_a"))
    here = F.struct(F.col(t).alias("t"), "_a.*")
    pair = one.select(*keys, t, F.struct(here.alias("a"), F.lead(here).over(Window.partitionBy(*keys).orderBy(t)).alias("b")).alias("_pair"))
    got = asof(times, pair, keys, t, "_pair", slab=slab)
    at, a, b = F.col(t), F.col("_pair.a"), F.col("_pair.b")
    value = lambda k: F.when(at == a["t"], a[k]).otherwise(a[k] + (b[k] - a[k]) * (at - a["t"]) / (b["t"] - a["t"]))
    return got.withColumns({k: value(k) for k in columns}).drop("_pair")


def relaunch(beams: DataFrame, attitude: DataFrame, taken: DataFrame, profiles: DataFrame, keys: list[str], t: str, slab: int, method: str = "cones") -> DataFrame:
    """Soundings anew after a change of attitude: beams (INPUTS but roll and pitch, draught for
    tx_depth, and time t) with the attitude (keys, t, roll, pitch, heave) interpolated at their
    time and the profile then in force; RESULTS, and depth below the surface.

    Beams outside of the attitude's span keep null results, as rejected ones."""
    seen = lambda d: asof(_attitude(d, attitude, keys, t, ("roll", "pitch", "heave"), slab), taken, keys, t, "profile", edges="first", slab=slab)
    b = by_times(beams, keys, t, seen).withColumn("tx_depth", F.col("tx_depth") + F.col("heave"))
    out = launch(b, profiles, t, slab, method)
    return out.withColumn("depth", F.col("tx_depth") + F.col("z"))
