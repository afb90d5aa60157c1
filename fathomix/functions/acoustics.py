"""Column expressions for levels, angles and backscatter corrections.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import Num, c

ENERGY, AMPLITUDE = 10.0, 20.0


def nan_to_null(x: Num) -> Column:
    """NaN is the missing value of measured layers; null is ours."""
    return F.when(F.isnan(c(x)), None).otherwise(c(x))


def to_linear(db: Num, scale: float = ENERGY) -> Column:
    return F.pow(F.lit(10.0), c(db) / scale)


def to_db(x: Num, scale: float = ENERGY) -> Column:
    """Null where x isn't positive."""
    return F.when(c(x) > 0, scale * F.log10(c(x)))


def mean_db(db: Num, scale: float = ENERGY) -> Column:
    """Mean of levels, taken on linear values (aggregate)."""
    return to_db(F.avg(to_linear(db, scale)), scale)


def max_db(db: Num) -> Column:
    return F.max(c(db))


def weighted_mean(v: Num, w: Num) -> Column:
    """Sum of v*w over sum of w, over rows with both; null if the weights sum to 0."""
    ok = c(v).isNotNull() & c(w).isNotNull()
    return F.sum(F.when(ok, c(v) * c(w))) / F.nullif(F.sum(F.when(ok, c(w))), F.lit(0.0))


def closed_bin(x: Num, lo: float, hi: float, width: float) -> Column:
    """Number of the bin of x in [lo, hi]; the last bin holds its upper edge; else null."""
    n = round((hi - lo) / width)
    return F.when(c(x).between(lo, hi), F.least(F.floor((c(x) - lo) / width), F.lit(n - 1)).cast("int"))


def round_bin(x: Num, width: float) -> Column:
    """Bin centre, halves to even."""
    return width * F.rint(c(x) / width)


def oblique_weight(angle: Num, centre: float = 45.0, spread: float = 15.0) -> Column:
    """Weight of a beam by its angle."""
    return F.exp(-0.5 * F.pow((c(angle) - centre) / spread, F.lit(2.0)))


def lambert(rng: Num, normal: Num) -> Column:
    """20 log10(R / Rn), R at least Rn."""
    return 20.0 * F.log10(F.greatest(c(rng), c(normal)) / c(normal))


def specular(rng: Num, normal: Num, bsn: Num, bso: Num, crossover_deg: Num) -> Column:
    """Level law between normal incidence and the crossover angle."""
    r, cross = F.greatest(c(rng), c(normal)), c(normal) / F.cos(F.radians(c(crossover_deg)))
    return F.when(r < cross, (F.sqrt((r - c(normal)) / (cross - c(normal))) - 1.0) * (c(bsn) - c(bso))).otherwise(0.0)


def area_by_pulse(rng: Num, normal: Num, rate: Num, pointing: Num, pulse: Num, speed: Num, along_bw: Num, across_bw: Num) -> Column:
    """Insonified area in dB, the smaller of the pulse-limited and the beam-limited one."""
    along, across = F.radians(c(along_bw)), F.radians(c(across_bw) / F.cos(F.radians(c(pointing))))
    rn = c(normal) * c(speed) / (2.0 * c(rate))
    r = F.greatest(c(rng) * c(speed) / (2.0 * c(rate)), rn)
    slant = F.sqrt(1.0 - F.pow(rn / r, F.lit(2.0)))
    oblique = F.when(slant > 0, c(speed) * c(pulse) * along * r / (2.0 * slant))
    return to_db(F.least(oblique, across * along * r * r))


def area_by_incidence(rng: Num, rate: Num, pointing: Num, pulse: Num, speed: Num, along_bw: Num, across_bw: Num, across_inc: Num, along_inc: Num) -> Column:
    """Insonified area in dB from seafloor incidence and aspect."""
    ac, al = F.radians(c(across_inc)), F.radians(c(along_inc))
    inc, aspect = F.radians(seafloor_incidence(across_inc, along_inc)), F.atan2(F.tan(ac), F.tan(al))
    open_al, open_ac = F.tan(F.radians(c(along_bw))), F.tan(F.radians(c(across_bw))) / F.cos(F.radians(c(pointing)))
    r = c(rng) * c(speed) / (2.0 * c(rate))
    normal = (open_ac * r / F.cos(ac)) * (open_al * r / F.cos(al))
    reach = F.abs(F.sin(inc))
    oblique = F.when(reach > 0, c(speed) * c(pulse) / (2.0 * reach) * r * F.sqrt(F.pow(open_al * F.sin(aspect), F.lit(2.0)) + F.pow(open_ac * F.cos(aspect), F.lit(2.0))))
    return to_db(F.least(oblique, normal))


def seafloor_incidence(across_deg: Num, along_deg: Num) -> Column:
    """Full incidence angle from its across and along parts, within +-90 degrees."""
    t = F.sqrt(F.pow(F.tan(F.radians(c(across_deg))), F.lit(2.0)) + F.pow(F.tan(F.radians(c(along_deg))), F.lit(2.0)))
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.degrees(F.atan(t))))


def corrected_level(raw: Num, snippet: Num, specular_db: Num, lambert_db: Num, calibration: Num = 0.0) -> Column:
    """Snippets lose the compensation laws first; else the beam's own level; calibration added."""
    return F.coalesce(c(snippet) - c(specular_db) - c(lambert_db), c(raw)) + c(calibration)


def gsab(angle: Num, a: Num, b: Num, cc: Num, d: Num, e: Num, f: Num) -> Column:
    """Six-parameter angular response in dB; a, cc and e are energies."""
    x = c(angle)
    lin = c(a) * F.exp(-x * x / (2.0 * c(b) * c(b))) + c(cc) * F.pow(F.cos(F.radians(x)), c(d)) + c(e) * F.exp(-x * x / (2.0 * c(f) * c(f)))
    return to_db(lin)


# Speed ratio and absorption by impedance ratio.
SPEED_RATIO = (0.7030, 0.2055)
ABSORPTION = [(1.8, 0.05), (3.0, 0.4)]
ABSORPTION_ABOVE = 0.1


def geoacoustics(z: Num) -> tuple[Column, Column, Column]:
    """(speed ratio, density ratio, absorption) of a bottom with impedance ratio z."""
    ratio = SPEED_RATIO[0] + SPEED_RATIO[1] * c(z)
    beta = F.lit(ABSORPTION_ABOVE)
    for limit, v in reversed(ABSORPTION):
        beta = F.when(c(z) < limit, v).otherwise(beta)
    return ratio, c(z) / ratio, beta


def effective_pulse(nominal: Num, model: Num, cw: Column) -> Column:
    """Effective pulse length of continuous-wave pulses; one sounder model has its own factor."""
    return F.when(~cw, c(nominal)).when(c(model) == 850, c(nominal) * 0.7).otherwise(c(nominal) / 0.7 * 0.375)


def range_samples(two_way_time: Num, rate: Num) -> Column:
    return c(two_way_time) * c(rate)


def refracted_incidence(angle_deg: Num, surface_speed: Num, bottom_speed: Num) -> Column:
    """Snell's law from the transducer to the bottom; null beyond the critical angle."""
    s = F.sin(F.radians(c(angle_deg))) * c(bottom_speed) / c(surface_speed)
    return F.when(F.abs(s) <= 1, F.degrees(F.asin(s)))


def surface_pointing(pointing: Num, roll_offset: Num, roll: Num) -> Column:
    return c(pointing) - c(roll_offset) - c(roll)


def uncertainty_limit(depth: Num, a: float, b: float) -> Column:
    """Largest vertical uncertainty of a survey order at a depth."""
    return F.sqrt(F.lit(a * a) + F.pow(b * c(depth), F.lit(2.0)))


# Survey orders.
ORDERS = {"2": (1.0, 0.023), "special": (0.25, 0.0075), "exclusive": (0.15, 0.0075), "1a": (0.5, 0.013), "1b": (0.5, 0.013)}


def quality_mask(angle: Num, invalid_rate: Num, mean_rate: Num, stdev: Num, near_stdev: Num, count: Num, interpolated: Num, elevation: Num) -> Column:
    """Bit mask of what speaks against a cell; 255 without elevation."""
    bits = [(F.abs(c(angle)) > 65, 1), (c(invalid_rate) / F.nullif(c(mean_rate), F.lit(0.0)) > 1.5, 2), (c(stdev) > c(near_stdev), 4), (c(count) < 5, 8), (c(interpolated) == 1, 16)]
    total = F.lit(0)
    for cond, bit in bits:
        total = total + F.when(cond, bit).otherwise(0)
    return F.when(c(elevation).isNull(), 255).otherwise(total)


def shoulder(x: Num, strength: Num, threshold: Num) -> Column:
    """Display curve: linear below the threshold, compressed above."""
    over = c(x) - c(threshold)
    return F.when(over > 0, c(threshold) + over / (1.0 + c(strength) * over)).otherwise(c(x))


def gamma(x: Num, g: Num) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(x))), 1.0 / c(g))


def across_angle(y: Num, z: Num, y_rx: Num, z_rx: Num) -> Column:
    """Angle of a detection across the track as its receiver sees it, in degrees."""
    return F.degrees(F.atan2(c(y) - c(y_rx), c(z) - c(z_rx)))
