"""Contour registration: planted shifts, and kernels against plain loops."""

import math

import numpy as np
import pytest

from fathomix.operators import registration as rg

RNG = np.random.default_rng(8)


def wavy(n, x0=0.0, y0=0.0, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.cumsum(rng.normal(0, 0.25, n))
    step = rng.uniform(4, 12, n)
    return np.stack([x0 + np.cumsum(step * np.cos(turn)), y0 + np.cumsum(step * np.sin(turn))], 1)


def test_sliding_sums_like_loops():
    s, t = RNG.normal(size=7), RNG.normal(size=11)
    got = rg.sliding_sums(s, t, lambda a, b: np.abs(a[:, None] - b[None, :]), block=4)
    want = [sum(abs(t[j] - s[k]) for j in range(11) for k in range(7) if j - k == i - 6) for i in range(17)]
    assert got == pytest.approx(want)
    assert rg.overlaps(7, 11).tolist() == [sum(1 for j in range(11) for k in range(7) if j - k == i - 6) for i in range(17)]


def test_chain_codes_like_a_rolling_window():
    xy = rg.even_vertices(wavy(40, seed=2), 4)
    step = np.diff(xy, axis=0)
    azimuth = np.unwrap([math.degrees(math.atan2(dx, dy)) for dx, dy in step], period=360)
    along = np.cumsum([math.hypot(*v) for v in step])
    for row, width in zip(rg.chain_codes(xy), rg.WINDOWS):
        for k, d in enumerate(along):
            x = [a for a, at in zip(azimuth, along) if abs(at - d) <= width / 2 + 1e-9]
            assert row[k] == pytest.approx(np.mean(x[len(x) // 2 :]) - np.mean(x[: math.ceil(len(x) / 2)]), abs=1e-8)


def test_even_vertices():
    assert rg.even_vertices(np.array([[0.0, 0], [3, 0], [3, 4]]), 1.0).tolist() == [[k, 0] for k in range(4)] + [[3, k] for k in range(1, 5)]


def test_part_of_a_line_is_found_and_shifted():
    whole = wavy(160, seed=3)
    got = rg.shift_of(whole[40:110] - [13, -9], whole, 4, 6, 100, 20)
    assert (got["east"], got["north"]) == (pytest.approx(13, abs=1.5), pytest.approx(-9, abs=1.5)) and abs(got["turn"]) < 3
    assert rg.shift_of(whole[40:110] - [130, 0], whole, 4, 6, 100, 20) is None  # too far
    assert rg.shift_of(whole[:3], whole, 4, 30, 100, 20) is None  # too short


def rows(line, level, xy):
    return [(line, level, k, float(x), float(y)) for k, (x, y) in enumerate(xy)]


def test_vectors_of_tables(spark):
    schema = "line string, level int, i int, x double, y double"
    src, dst = [], []
    for k in range(6):
        xy = wavy(120, 4000.0 * k, 0.0, seed=10 + k)
        src += rows(f"s{k}", k % 2, xy)
        dst += rows(f"t{k}", k % 2, xy + [5.0 * k - 10, 3.0 - k])
        dst += rows(f"other{k}", 7, xy)  # another level
    src += [("s0", 0, 5, 1e6, 0.0), ("s0", 0, None, 1.0, 1.0), ("short", 0, 0, 0.0, 0.0), ("away", 0, 0, 9e5, 9e5), ("away", 0, 1, 9e5 + 500, 9e5)]
    nav = [(100 * k, *wavy(120, 4000.0 * k, 0.0, seed=10 + k)[60]) for k in range(5)] + [(9, 0.0, 9e6)]
    s, t, n = spark.createDataFrame(src, schema), spark.createDataFrame(dst, schema), spark.createDataFrame([(a, float(b), float(c)) for a, b, c in nav], "t long, x double, y double")
    got = {r.line: r for r in rg.shift_vectors(s, t).collect()}
    assert set(got) == {f"s{k}" for k in range(6)}
    for k in range(6):
        r = got[f"s{k}"]
        assert r.target == f"t{k}" and (r.east, r.north) == (pytest.approx(5 * k - 10, abs=0.01), pytest.approx(3 - k, abs=0.01)) and r.overlap > 100
    timed = {r.line: r.t for r in rg.shift_vectors(s, t, n).collect()}
    assert timed == {f"s{k}": 100 * k for k in range(5)}
    assert rg.shift_vectors(s.limit(0), t).count() == 0


def test_nearest_lines_like_a_search(spark):
    """Against the least distance of finely cut lines."""
    schema = "line string, level int, i int, x double, y double"
    src = {f"s{k}": RNG.uniform(0, 300, (4, 2)) for k in range(6)}
    dst = {f"t{k}": RNG.uniform(0, 300, (4, 2)) for k in range(6)}
    frame = lambda d: spark.createDataFrame([r for k, xy in d.items() for r in rows(k, 0, xy)], schema)
    got = {r.line: r for r in rg.nearest_lines(frame(src), frame(dst), 60.0).collect()}
    fine = {k: rg.even_vertices(v, 0.25) for k, v in (src | dst).items()}
    for s in src:
        d = {t: min(np.hypot(*(fine[s][i : i + 50, None] - fine[t][None]).transpose(2, 0, 1)).min() for i in range(0, len(fine[s]), 50)) for t in dst}
        if min(d.values()) <= 59.5:
            assert got[s].distance == pytest.approx(min(d.values()), abs=0.3) and d[got[s].target] <= min(d.values()) + 0.3
        elif min(d.values()) > 60.5:
            assert s not in got
