"""Tide from the heights of a satellite positioning antenna.

Heights less a reference surface (and less a predicted tide, in predictive mode) are averaged in steps,
short gaps are bridged by lines, the series is low-passed without a shift, the prediction is added
again, and each output time takes the nearest step.

The low-pass runs a recursive filter forward and backward.  Its response to an impulse is the filter's
autocorrelation; cut where no more than ``TAIL`` of its weight is left, it is a kernel of finite reach.
So a series is cut into slabs that overlap by that reach: a long file is many tasks' work, and the
length of a slab doesn't change the result beyond rounding.  The kernel differs from the endless one
by at most TAIL times the series' range.

Defined cases: rows with a null or NaN height, or a null time or file, are left out; a null reference
or prediction counts 0; equal times are averaged; a gap of more than ``gap`` seconds ends a stretch,
and stretches are filtered alone, mirrored at their ends through the end value (what the mirror can't
reach keeps its last value); a stretch of one step is its own result; output times without a step
within half an interval don't come out, and of two steps equally near the earlier one is taken; an
empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solvers import chebyshev2

TAIL = 1e-9


def kernel(sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Symmetric weights of the forward and backward filter, with a sum of 1."""
    slowest = max(abs(z) for _, a in sections for z in np.roots(a))
    n = int(np.ceil(np.log(TAIL / 100) / np.log(slowest))) + 1
    h = np.zeros(n)
    h[0] = 1.0
    for b, a in sections:
        x, h = h, np.zeros(n)
        for i in range(n):
            h[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * h[i - k] for k in (1, 2) if i >= k)
    k = np.convolve(h, h[::-1])
    rest = np.cumsum(np.abs(k))[: n - 1] * 2  # weight beyond each reach, both sides
    cut = int(np.searchsorted(rest, TAIL))
    k = k[cut : len(k) - cut]
    return k / k.sum()


def low_passed(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A stretch under a symmetric kernel, mirrored through its end values."""
    reach, m = len(k) // 2, min(len(v) - 1, len(k) // 2)
    if m == 0:
        return v.astype(float)
    left, right = 2 * v[0] - v[m:0:-1], 2 * v[-1] - v[-2 : -m - 2 : -1]
    x = np.concatenate([np.full(reach - m, left[0]), left, v, right, np.full(reach - m, right[-1])])
    size = 1 << int(len(x) + len(k)).bit_length()
    out = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(k, size), size)
    return out[2 * reach : 2 * reach + len(v)]


def stretches(at: np.ndarray, v: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(steps, values) of each stretch of sorted steps, gaps of up to ``most`` steps bridged by lines."""
    out = []
    for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > most) + 1):
        whole = np.arange(at[own[0]], at[own[-1]] + 1) if len(own) else at[:0]
        out.append((whole, np.interp(whole, at[own], v[own]) if len(own) else v[:0]))
    return out


def antenna_tide(
    heights: DataFrame, file: str, t: str, height: str, reference: str | None = None, predicted: str | None = None, water_level: float = 0.0, step: float = 10.0, stop: float = 1 / 300,
    attenuation: float = 40.0, gap: float = 600.0, interval: float = 300.0, slab: int = 8640,
) -> DataFrame:
    """(file, t, tide) every ``interval`` seconds, t in microseconds; ``stop`` is the frequency in hertz
    from which on the filter's two runs each attenuate by ``attenuation`` dB, ``slab`` the steps of one task."""
    k = kernel(chebyshev2(2, attenuation, 2 * stop * step))
    most = max(1, int(gap // step))
    halo = len(k) // 2 + most
    other = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(0.0)
    rows = heights.select(F.col(file).alias("file"), F.col(t).cast("long").alias("t"), F.col(height).cast("double").alias("h"), other(reference).alias("r"), other(predicted).alias("p"))
    rows = rows.filter("file is not null and t is not null and h is not null and not isnan(h)")
    steps = rows.groupBy("file", F.floor(F.col("t") / (step * 1e6)).cast("long").alias("at")).agg((F.avg(F.col("h") - F.col("r") - F.col("p")) - water_level).alias("v"), F.avg("p").alias("p"))
    # a step goes to its slab and to those whose halo it lies in
    steps = steps.withColumn("slab", F.explode(F.sequence(F.floor((F.col("at") - halo) / slab), F.floor((F.col("at") + halo) / slab))))

    def one(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("at")
        at, low = d["at"].to_numpy(), int(key[1]) * slab
        got = []
        for whole, v in stretches(at, d["v"].to_numpy(), most):
            core = (whole >= low) & (whole < low + slab)
            if core.any():
                got.append(np.stack([whole[core], (low_passed(v, k) + np.interp(whole, at, d["p"].to_numpy()))[core]]))
        both = np.concatenate(got, axis=1) if got else np.zeros((2, 0))
        return pd.DataFrame({"file": [key[0]] * both.shape[1], "at": both[0].astype(np.int64), "tide": both[1]}).astype({"file": d["file"].dtype})

    smooth = steps.groupBy("file", "slab").applyInPandas(one, f"file {dict(steps.dtypes)['file']}, at long, tide double")
    middle = (F.col("at") * step + step / 2).alias("m")
    near = smooth.select("file", "tide", middle).withColumn("out", F.floor(F.col("m") / interval + 0.5))
    best = near.groupBy("file", "out").agg(F.min_by("tide", F.struct(F.abs(F.col("m") - F.col("out") * interval), "m")).alias("tide"))
    return best.select("file", (F.col("out") * interval * 1e6).cast("long").alias("t"), "tide")
