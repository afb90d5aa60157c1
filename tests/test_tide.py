"""Antenna tide: the kernel against the recursive filter, slabs against the whole, and defined cases."""

import numpy as np
import pytest

from fathomix.operators import tide
from fathomix.operators.solvers import chebyshev2, filtfilt

SECTIONS = chebyshev2(2, 40.0, 2 * 10 / 300)


def test_kernel_is_the_filter_run_both_ways():
    k = tide.kernel(SECTIONS)
    assert len(k) % 2 == 1 and np.allclose(k, k[::-1]) and abs(k.sum() - 1) < 1e-12
    rng = np.random.default_rng(0)
    v = np.concatenate([np.zeros(len(k)), rng.normal(size=400), np.zeros(len(k))])
    assert np.abs(tide.low_passed(v, k) - filtfilt(SECTIONS, v)).max() < 1e-7
    line = np.linspace(3, 9, 500)
    assert np.allclose(tide.low_passed(line, k)[100:-100], line[100:-100], atol=0.05) and tide.low_passed(line[:1], k).tolist() == [3.0]


def series(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([3.0, 7.0, 12.0, 65.0], n))
    t[n // 2 :] += 4000  # a gap that ends a stretch
    h = 2 * np.sin(t / 9000) + rng.normal(size=n) + 40
    return [("f", int(a * 1e6), float(b), 40.0, float(np.cos(a / 7000))) for a, b in zip(t, h)]


def plain(rows, slabless=10**9):
    step = {}
    for _, t, h, r, p in rows:
        step.setdefault(t // 10_000_000, []).append((h - r - p, p))
    at = np.array(sorted(step))
    v, p = (np.array([np.mean([x[i] for x in step[a]]) for a in at]) for i in (0, 1))
    out = {}
    k = tide.kernel(SECTIONS)
    first = 0
    for i in [*(np.flatnonzero(np.diff(at) > 60) + 1), len(at)]:
        whole = np.arange(at[first], at[i - 1] + 1)
        x = np.interp(whole, at[first:i], v[first:i])
        m = min(len(x) - 1, len(k) // 2)
        pad = np.concatenate([[2 * x[0] - x[m]] * (len(k) // 2 - m), 2 * x[0] - x[m:0:-1], x, 2 * x[-1] - x[-2 : -m - 2 : -1], [2 * x[-1] - x[-m - 1]] * (len(k) // 2 - m)])
        y = np.convolve(pad, k, "valid") + np.interp(whole, at, p)
        for a, b in zip(whole, y):
            m_ = a * 10 + 5
            o = int(np.floor(m_ / 300 + 0.5))
            if o not in out or (abs(m_ - o * 300), m_) < out[o][0]:
                out[o] = ((abs(m_ - o * 300), m_), b)
        first = i
    return {o * 300_000_000: b for o, (_, b) in out.items()}


@pytest.mark.parametrize("slab", [200, 1111, 10**6])
def test_slabs_dont_change_the_tide(spark, slab):
    rows = series()
    df = spark.createDataFrame(rows, "file string, t long, h double, r double, p double")
    got = {r.t: r.tide for r in tide.antenna_tide(df, "file", "t", "h", "r", "p", slab=slab).collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and len(got) > 150
    assert max(abs(got[t] - want[t]) for t in want) < 1e-7


def test_defined_cases(spark):
    odd = [("a", 5_000_000, 3.0, None, None), ("a", 5_000_000, 5.0, 1.0, None), (None, 1, 1.0, 0.0, 0.0), ("a", None, 1.0, 0.0, 0.0), ("a", 1, None, 0.0, 0.0), ("a", 1, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(odd, "file string, t long, h double, r double, p double")
    assert [(r.file, r.t, r.tide) for r in tide.antenna_tide(df, "file", "t", "h", "r", "p", water_level=0.5).collect()] == [("a", 0, 3.0)]
    assert tide.antenna_tide(df.limit(0), "file", "t", "h").count() == 0
