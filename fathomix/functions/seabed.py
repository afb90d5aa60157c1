"""Backscatter of a seabed from its properties: facets, small-scale roughness, volume.

Angles in degrees, levels in dB.  Defined cases: an angle counts by its size; 0 and 90 are taken a
hair inside; any null parameter gives null; beyond total reflection there is no volume part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import Num, c

# Regressions and constants of the model.
SPEED_RATIO = (0.7030, 0.2055)  # of impedance
GAMMA, REFERENCE_HZ = 10 / 3, 150_000.0
DROP_DB, VOLUME_DEG, VOLUME_POWER = 15.0, 10.0, 0.65
_EDGE, _STEPS = 1e-8, 40


def _bragg_factor(gamma: float) -> tuple[float, float]:
    d = (gamma - 2) / 2
    return d, 2 ** (gamma - 5) * math.pi ** (gamma - 3) * (4 - gamma) ** d * (gamma - 2) ** (1 - d)


def crossing_tangent(delta: Column) -> Column:
    """Squared tangent of the angle where a facet lobe of squared slope ``delta`` is 15 dB down, by
    fixed-point steps on u = 2 delta (2 ln(1 + u) + ln of the drop)."""
    drop = DROP_DB / 10 * math.log(10)
    step = lambda u, _: 2 * delta * (2 * F.log(1 + u) + drop)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), 2 * delta * drop, step)


def level(angle: Num, frequency: Num, impedance: Num, slope: Num, second: Num, volume_db: Num, gamma: float = GAMMA, reference: float = REFERENCE_HZ) -> Column:
    """Level at an incidence angle: ``slope`` and ``second`` are the facets' slopes in degrees (the
    first at the reference frequency), ``volume_db`` the volume parameter there."""
    t = F.greatest(F.lit(_EDGE), F.least(F.lit(math.pi / 2 - _EDGE), F.radians(F.abs(c(angle)))))
    z, f = c(impedance), c(frequency) / reference
    ratio = SPEED_RATIO[0] + SPEED_RATIO[1] * z
    s = ratio * F.sin(t)
    down = F.sqrt(F.greatest(F.lit(0.0), 1 - s * s))
    v = (z * F.cos(t) - down) / (z * F.cos(t) + down)
    v2 = F.when(s < 1, v * v).otherwise(1.0)
    d, factor = _bragg_factor(gamma)
    d1 = F.pow(F.radians(c(slope) * F.pow(f, F.lit(d / 2))), F.lit(2.0))
    d2 = F.pow(F.radians(c(second)), F.lit(2.0))
    v0 = F.pow((z - 1) / (z + 1), F.lit(2.0))
    tan2, cos4 = F.pow(F.tan(t), F.lit(2.0)), F.pow(F.cos(t), F.lit(4.0))
    facet = lambda q: v0 * F.exp(-tan2 / (2 * q)) / (8 * math.pi * q * cos4) * math.exp(-1)
    bragg = factor * v2 * cos4 / F.pow(F.sin(t), F.lit(gamma)) * F.pow(d1, F.lit(d))
    cross = F.atan(F.sqrt(crossing_tangent(d1)))
    inner = 1 / (1 + F.exp(-F.degrees(t - cross)))
    surface = (bragg + facet(d2)) * inner + (1 - inner) * facet(d1)
    inside = F.pow(F.lit(10.0), c(volume_db) / 10) * F.pow(f, F.lit(VOLUME_POWER)) * F.pow(1 - v2, F.lit(2.0)) * ratio * ratio * F.pow(F.cos(t), F.lit(2.0)) / F.greatest(down, F.lit(1e-6))
    volume = F.when(s < 1, inside / (1 + F.exp(-F.degrees(t - math.radians(VOLUME_DEG)) / 2))).otherwise(0.0)
    return 10 * F.log10(surface + volume + 1e-15)


def level_array(angle: np.ndarray, frequency: float, impedance: float, slope: float, second: float, volume_db: float, gamma: float = GAMMA, reference: float = REFERENCE_HZ) -> np.ndarray:
    """The same for many angles at once, for solvers that try many parameters."""
    t = np.clip(np.radians(np.abs(angle)), _EDGE, math.pi / 2 - _EDGE)
    f, ratio = frequency / reference, SPEED_RATIO[0] + SPEED_RATIO[1] * impedance
    s = ratio * np.sin(t)
    down = np.sqrt(np.maximum(0.0, 1 - s * s))
    v2 = np.where(s < 1, ((impedance * np.cos(t) - down) / (impedance * np.cos(t) + down)) ** 2, 1.0)
    d, factor = _bragg_factor(gamma)
    d1, d2 = math.radians(slope * f ** (d / 2)) ** 2, math.radians(second) ** 2
    v0 = ((impedance - 1) / (impedance + 1)) ** 2
    tan2, cos4 = np.tan(t) ** 2, np.cos(t) ** 4
    one, two = (v0 * np.exp(-tan2 / (2 * q)) / (8 * math.pi * q * cos4) * math.exp(-1) for q in (d1, d2))
    drop = DROP_DB / 10 * math.log(10)
    u = 2 * d1 * drop
    for _ in range(_STEPS):
        u = 2 * d1 * (2 * math.log(1 + u) + drop)
    inner = 1 / (1 + np.exp(-np.degrees(t - math.atan(math.sqrt(u)))))
    surface = (factor * v2 * cos4 / np.sin(t) ** gamma * d1**d + two) * inner + (1 - inner) * one
    inside = 10 ** (volume_db / 10) * f**VOLUME_POWER * (1 - v2) ** 2 * ratio**2 * np.cos(t) ** 2 / np.maximum(down, 1e-6)
    volume = np.where(s < 1, inside / (1 + np.exp(-np.degrees(t - math.radians(VOLUME_DEG)) / 2)), 0.0)
    return 10 * np.log10(surface + volume + 1e-15)
