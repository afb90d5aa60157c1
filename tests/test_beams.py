"""Beam geometry against searches on a fine grid and rays integrated in small steps."""

import numpy as np
import pandas as pd
import pytest

from fathomix.operators import beams as bm

RNG = np.random.default_rng(4)


def one_cone(n):
    return RNG.uniform(-8, 8, n), RNG.uniform(-55, 55, n), RNG.uniform(-4, 4, n), RNG.uniform(-3, 3, (n, 3)), RNG.uniform(8, 200, n)


def test_footprints_lie_on_both_cones_and_match_a_search():
    tx, rx, d, apart, depth = one_cone(300)
    xy = bm.footprints(depth, tx, rx, d, apart)
    t, r, m = np.radians(tx), np.radians(rx), np.radians(d)
    for k in range(300):
        lo, hi = -3000.0, 3000.0  # the receive cone's misfit grows along the transmit branch

        def miss(y):
            x = np.tan(t[k]) * np.hypot(y, depth[k])
            u, v = np.cos(m[k]) * (x - apart[k, 0]) + np.sin(m[k]) * (y - apart[k, 1]), np.cos(m[k]) * (y - apart[k, 1]) - np.sin(m[k]) * (x - apart[k, 0])
            return v - np.tan(-r[k]) * np.hypot(u, depth[k] - apart[k, 2])

        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if miss(mid) < 0 else (lo, mid)
        assert xy[k] == pytest.approx([np.tan(t[k]) * np.hypot(lo, depth[k]), lo], abs=1e-6)


def test_lines_and_branches_in_any_frame():
    far = [50.0, 50.0]
    assert bm.branch_crossings([[0, 0]], 0, 1, 0, [[3, 4]], 0, 1, np.pi / 2, far)[0] == pytest.approx([0, 4])
    assert np.isnan(bm.branch_crossings([[0, 0]], 0, 1, 0, [[3, 4]], 0, 1, 0, far)[0]).all()  # parallel lines
    got = bm.branch_crossings([[0, 0]], 2, 1, 0, [[0, 1]], 0, 1, np.pi / 2, far)[0]
    assert got == pytest.approx([2 * np.sqrt(2), 1])
    assert np.isnan(bm.branch_crossings([[0, 0]], 2, 1, 0, [[0, 0]], -2, 1, 0, far)[0]).all()  # opposite branches
    for _ in range(200):  # a point laid on two turned branches is found again
        s1, s2 = RNG.uniform(-1.5, 1.5, 2)
        (a1, a2), (b1, b2), (w1, w2) = RNG.uniform(-3, 3, 2), RNG.uniform(0.5, 4, 2), RNG.uniform(-3, 3, 2)
        at = RNG.uniform(-5, 5, 2)
        centres = []
        for s, a, b, w in ((s1, a1, b1, w1), (s2, a2, b2, w2)):
            p = np.array([a * np.cosh(s), b * np.sinh(s)])
            centres.append(at - np.array([np.cos(w) * p[0] - np.sin(w) * p[1], np.sin(w) * p[0] + np.cos(w) * p[1]]))
        assert bm.branch_crossings([centres[0]], a1, b1, w1, [centres[1]], a2, b2, w2, at)[0] == pytest.approx(at, abs=1e-5)


def test_missing_and_impossible_beams():
    xy = bm.footprints(np.array([10.0, np.nan, -5.0, 10.0]), np.array([0.0, 1, 1, np.nan]), np.array([0.0, 1, 1, 5]), np.zeros(4), np.zeros((4, 3)))
    assert xy[0] == pytest.approx([0, 0], abs=1e-9) and np.isnan(xy[1:]).all()
    assert np.isnan(bm.concentric(np.array([80.0]), np.array([80.0]), np.array([0.0]))[0, 2])


D, S = np.array([0.0, 20, 60, 61, 200]), np.array([1500.0, 1490, 1490, 1520, 1480])


def slow_ray(z0, c0, z1, inc, n=40_000):
    """Travel in thin layers of constant speed."""
    z = np.linspace(z0, z1, n + 1)
    mid = (z[1:] + z[:-1]) / 2
    below = D[D > z0]
    c = np.interp(mid, np.concatenate([[z0], below, [1e9]]), np.concatenate([[c0], S[D > z0], [S[-1]]]))
    s = np.sin(np.radians(inc)) / c0 * c
    return (np.diff(z) * s / np.sqrt(1 - s * s)).sum(), (np.diff(z) / c / np.sqrt(1 - s * s)).sum()


def test_rays_like_thin_layers():
    z0, c0, z1, inc = RNG.uniform(0, 30, 40), RNG.uniform(1480, 1510, 40), RNG.uniform(40, 400, 40), RNG.uniform(-60, 60, 40)
    x, t, _, _ = bm.rays(D, S, z0, c0, z1, inc)
    for k in range(40):
        assert (x[k], t[k]) == pytest.approx(slow_ray(z0[k], c0[k], z1[k], inc[k]), rel=1e-5)
    x, t, c, i = bm.rays(np.array([0.0]), np.array([1500.0]), np.array([5.0, 5, 5]), np.full(3, np.nan), np.array([105.0, 1.0, 105]), np.array([45.0, 0, 90]))
    assert (x[0], t[0], c[0], i[0]) == pytest.approx((100, 100 * np.sqrt(2) / 1500, 1500, 45)) and np.isnan(x[1:]).all()


@pytest.mark.parametrize("method", ["cones", "triangles"])
def test_planted_soundings_in_even_water(method):
    """Both methods are exact where sound goes straight."""
    n = 200
    roll, pitch, d = RNG.uniform(-6, 6, n), RNG.uniform(-3, 3, n), RNG.uniform(-3, 3, n)
    apart, depth = RNG.uniform(-2, 2, (n, 3)), RNG.uniform(1, 5, n)
    v = np.stack([RNG.uniform(-5, 5, n), RNG.uniform(-80, 80, n), RNG.uniform(60, 120, n)], 1)
    back = v - apart
    tl, rl, m = np.linalg.norm(v, axis=1), np.linalg.norm(back, axis=1), np.radians(d)
    tx = np.degrees(np.arcsin(v[:, 0] / tl))
    rx = np.degrees(np.arcsin(-(np.cos(m) * back[:, 1] - np.sin(m) * back[:, 0]) / rl))
    out = bm.aim(method, (tl + rl) / 1500, tx, rx, d, apart, roll, pitch, depth, np.full(n, np.nan), np.array([0.0, 50]), np.array([1500.0, 1500]), 1e-9, 40)
    want = bm.turned(v, roll, pitch)
    ok = np.hypot(want[:, 0], want[:, 1]) < 3 * want[:, 2]
    assert np.stack([out["x"], out["y"], out["z"]], 1)[ok] == pytest.approx(want[ok], abs=0.01 if method == "cones" else 0.2)
    assert out["one_way"][ok] == pytest.approx(tl[ok] / 1500, abs=1e-5 if method == "cones" else 2e-4)


def test_times_and_cones_hold_in_layered_water():
    n = 60
    tx, rx, d, apart, _ = one_cone(n)
    seconds, depth, speed = RNG.uniform(0.08, 0.3, n), RNG.uniform(1, 6, n), RNG.uniform(1490, 1500, n)
    zero = np.zeros(n)
    out = bm.aim("cones", seconds, tx, rx, d, apart, zero, zero, depth, speed, D, S, 1e-9, 60)
    assert np.isfinite(out["x"]).all()
    for k in range(n):
        z = out["z"][k]
        x, down = slow_ray(depth[k], speed[k], depth[k] + z, out["incidence"][k])
        assert down == pytest.approx(out["one_way"][k], abs=1e-6) and x == pytest.approx(np.hypot(out["x"][k], out["y"][k]), abs=1e-3)
        v = np.append(bm.footprints(z[None], tx[k : k + 1], rx[k : k + 1], d[k : k + 1], apart[k : k + 1])[0], z)
        back = v - apart[k]
        _, up = slow_ray(depth[k] + apart[k, 2], speed[k], depth[k] + z, np.degrees(np.arctan2(np.hypot(*back[:2]), back[2])))
        assert down + up == pytest.approx(seconds[k], abs=2e-6)
        m = np.radians(d[k])
        assert np.sin(np.radians(tx[k])) == pytest.approx(v[0] / np.linalg.norm(v), abs=1e-7)
        assert np.sin(np.radians(-rx[k])) == pytest.approx((np.cos(m) * back[1] - np.sin(m) * back[0]) / np.linalg.norm(back), abs=1e-7)


def test_relaunch_table(spark):
    """The table gives what the kernel gives with the profile in force and the attitude at the time."""
    rows = [("a", 10 * k, k, 0.1 + k / 500, (k % 5) - 2.0, 4.0 * k - 40, 1.0, 0.5, -1.0, 0.2, 3.0, None, "kept") for k in range(20)]
    rows += [("a", 400, 90, 0.1, 0.0, 0.0, 1.0, 0.5, -1.0, 0.2, 3.0, None, "late"), ("a", 50, 91, None, 0.0, 0.0, 1.0, 0.5, -1.0, 0.2, 3.0, 1500.0, "null")]
    b = spark.createDataFrame(rows, "k string, t long, id int, seconds double, tx_steer double, rx_steer double, delta double, sx double, sy double, sz double, tx_depth double, speed double, _note string")
    att = spark.createDataFrame([("a", 0, 0.0, 1.0, 0.0), ("a", 200, 4.0, -1.0, 0.5)], "k string, t long, roll double, pitch double, heave double")
    taken = spark.createDataFrame([("a", 30, "p1"), ("a", 120, "p2")], "k string, t long, profile string")
    layers = spark.createDataFrame([("p1", float(z), float(c)) for z, c in zip(D, S)] + [("p2", 0.0, 1470.0), ("p2", 90.0, 1500.0)], "profile string, depth double, speed double")
    got = bm.relaunch(b, att, taken, layers, ["k"], "t", 60).toPandas().set_index("id")
    assert len(got) == 22 and got.loc[[90, 91], bm.RESULTS].isna().all(axis=None) and set(got["_note"]) == {"kept", "late", "null"}
    for k in range(20):
        t = 10 * k
        dd, ss = (D, S) if t < 120 else (np.array([0.0, 90]), np.array([1470.0, 1500]))
        one = lambda v: np.array([v], float)
        r = rows[k]
        want = bm.aim("cones", one(r[3]), one(r[4]), one(r[5]), one(1.0), one([0.5, -1.0, 0.2]), one(t / 50), one(1 - t / 100), one(3 + t / 400), one(np.nan), dd, ss)
        assert got.loc[k, bm.RESULTS].to_numpy(float) == pytest.approx(np.array([want[x][0] for x in bm.RESULTS]), abs=1e-9)
    none = bm.launch(b.limit(0).withColumn("profile", bm.F.lit("p1")).withColumn("roll", bm.F.lit(0.0)).withColumn("pitch", bm.F.lit(0.0)), layers, "t", 60)
    assert none.count() == 0
    assert isinstance(got, pd.DataFrame)
