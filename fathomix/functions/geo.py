"""Column expressions for positions, distances, cells and polygons."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._cols import Num, c

# The WGS84 ellipsoid and the mean sphere.
SEMI_MAJOR, SEMI_MINOR = 6378137.0, 6356752.314245179
E2 = 1.0 - (SEMI_MINOR / SEMI_MAJOR) ** 2
SPHERE = 6371000.0


def haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = p2 - p1, F.radians(c(lon2) - c(lon1))
    a = F.pow(F.sin(dp / 2.0), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2.0), F.lit(2.0))
    return 2.0 * SPHERE * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1.0 - a)))


@F.pandas_udf(T.DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Ellipsoidal distance in metres: Vincenty's inverse, a fixed number of rounds on whole
    Arrow batches.  Nearly antipodal points, for which the series doesn't settle, are beyond it."""
    f = 1.0 - SEMI_MINOR / SEMI_MAJOR
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v.to_numpy(float)))) for v in (lat1, lat2))
    big_l = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(12):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            ca = 1.0 - sa * sa
            cm = np.where(ca > 0, cs - 2.0 * s1 * s2 / ca, 0.0)
            k = f / 16.0 * ca * (4.0 + f * (4.0 - 3.0 * ca))
            lam = big_l + (1.0 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2.0 * cm * cm - 1.0)))
    u = ca * (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2
    a = 1.0 + u / 16384.0 * (4096.0 + u * (-768.0 + u * (320.0 - 175.0 * u)))
    b = u / 1024.0 * (256.0 + u * (-128.0 + u * (74.0 - 47.0 * u)))
    d = b * ss * (cm + b / 4.0 * (cs * (2.0 * cm * cm - 1.0) - b / 6.0 * cm * (4.0 * ss * ss - 3.0) * (4.0 * cm * cm - 3.0)))
    return pd.Series(SEMI_MINOR * a * (sigma - d))


def norm_and_radius(lat: Num) -> tuple[Column, Column]:
    """Prime-vertical and meridian radii of curvature."""
    k = 1.0 - E2 * F.pow(F.sin(F.radians(c(lat))), F.lit(2.0))
    n = SEMI_MAJOR / F.sqrt(k)
    return n, n * (1.0 - E2) / k


def offset_position(along: Num, across: Num, lon: Num, lat: Num, heading: Num) -> tuple[Column, Column]:
    """(lon, lat) of a point given in the platform's frame."""
    n, r = norm_and_radius(lat)
    s, k = F.sin(F.radians(c(heading))), F.cos(F.radians(c(heading)))
    east, north = c(along) * s + c(across) * k, c(along) * k - c(across) * s
    return F.degrees(east / n) / F.cos(F.radians(c(lat))) + c(lon), F.degrees(north / r) + c(lat)


def wrap_longitude(lon: Num) -> Column:
    """Into [-180, 180)."""
    return F.pmod(c(lon) + 180.0, F.lit(360.0)) - 180.0


def fold_latitude(lat: Num) -> Column:
    """Into [-90, 90], folded at the poles."""
    y = F.pmod(c(lat) + 90.0, F.lit(360.0))
    return F.when(y <= 180.0, y).otherwise(360.0 - y) - 90.0


def utm_zone(lon: Num, lat: Num) -> Column:
    """Zone number with its northern exceptions."""
    x, y = c(lon), c(lat)
    plain = F.floor((x + 180.0) / 6.0) + 1
    north = y.between(72, 84)
    return (
        F.when((y >= 56) & (y < 64) & (x >= 3) & (x < 12), 32)
        .when(north & (x >= 0) & (x < 9), 31).when(north & (x >= 9) & (x < 21), 33)
        .when(north & (x >= 21) & (x < 33), 35).when(north & (x >= 33) & (x < 42), 37)
        .otherwise(plain).cast("int")
    )


def utm_definition(lon: Num, lat: Num) -> Column:
    south = F.when(c(lat) < 0, " +south").otherwise("")
    return F.concat(F.lit("+proj=utm +zone="), utm_zone(lon, lat).cast("string"), south, F.lit(" +datum=WGS84 +units=m +no_defs"))


def to_mercator(lon: Num, lat: Num) -> tuple[Column, Column]:
    """Spherical web Mercator."""
    return F.radians(c(lon)) * SEMI_MAJOR, SEMI_MAJOR * F.log(F.tan(math.pi / 4 + F.radians(c(lat)) / 2.0))


def from_mercator(x: Num, y: Num) -> tuple[Column, Column]:
    return F.degrees(c(x) / SEMI_MAJOR), F.degrees(2.0 * F.atan(F.exp(c(y) / SEMI_MAJOR)) - math.pi / 2)


def to_utm(lon: Num, lat: Num, zone: Num) -> tuple[Column, Column]:
    """Transverse Mercator of a zone, series to sixth order."""
    k0, ep = 0.9996, E2 / (1 - E2)
    phi, lam = F.radians(c(lat)), F.radians(c(lon) - (c(zone) * 6.0 - 183.0))
    n = SEMI_MAJOR / F.sqrt(1.0 - E2 * F.pow(F.sin(phi), F.lit(2.0)))
    t, g, a = F.pow(F.tan(phi), F.lit(2.0)), ep * F.pow(F.cos(phi), F.lit(2.0)), F.cos(phi) * lam
    m = SEMI_MAJOR * (
        (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2.0 * phi)
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4.0 * phi) - (35 * E2**3 / 3072) * F.sin(6.0 * phi)
    )
    p = lambda k: F.pow(a, F.lit(float(k)))
    x = k0 * n * (a + (1.0 - t + g) * p(3) / 6.0 + (5.0 - 18.0 * t + t * t + 72.0 * g - 58.0 * ep) * p(5) / 120.0) + 500000.0
    y = k0 * (m + n * F.tan(phi) * (p(2) / 2.0 + (5.0 - t + 9.0 * g + 4.0 * g * g) * p(4) / 24.0 + (61.0 - 58.0 * t + t * t + 600.0 * g - 330.0 * ep) * p(6) / 720.0))
    return x, F.when(c(lat) < 0, y + 10000000.0).otherwise(y)


def in_ring(x: Num, y: Num, ring: Column) -> Column:
    """Even-odd rule against a closed ring, an array of (x, y) structs; empty ring: everywhere."""
    px, py, n = c(x), c(y), F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        ay, by, ax, bx = a["y"], b["y"], a["x"], b["x"]
        return F.when(((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(n > 0, crosses(i)).otherwise(1))
    return hits % 2 == 1


def rotate(x: Num, y: Num, z: Num, roll: Num, pitch: Num, yaw: Num) -> tuple[Column, Column, Column]:
    """Platform frame to the level, north-oriented frame: roll, then pitch, then yaw, degrees."""
    r, p, w = (F.radians(c(v)) for v in (roll, pitch, yaw))
    x1, y1, z1 = c(x), c(y) * F.cos(r) - c(z) * F.sin(r), c(y) * F.sin(r) + c(z) * F.cos(r)
    x2, y2, z2 = x1 * F.cos(p) + z1 * F.sin(p), y1, z1 * F.cos(p) - x1 * F.sin(p)
    return x2 * F.cos(w) - y2 * F.sin(w), x2 * F.sin(w) + y2 * F.cos(w), z2


def azimuth(dx: Num, dy: Num) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(c(dx), c(dy))), F.lit(360.0))


@dataclass(frozen=True)
class GridSpec:
    """A regular grid; row 0 is the south edge."""

    west: float
    south: float
    res_x: float
    res_y: float
    rows: int
    cols: int
    srs: str = "EPSG:4326"

    @property
    def east(self) -> float:
        return self.west + self.cols * self.res_x

    @property
    def north(self) -> float:
        return self.south + self.rows * self.res_y

    @classmethod
    def of_extent(cls, west: float, east: float, south: float, north: float, res_x: float, res_y: float, srs: str = "EPSG:4326") -> GridSpec:
        """Counts are the ceiling of the extent, rounded to ten digits, over the resolution."""
        width = east - west + (360.0 if east < 0 < west else 0.0)
        return cls(west, south, res_x, res_y, math.ceil(round((north - south) / res_y, 10)), math.ceil(round(width / res_x, 10)), srs)

    def xy(self, x: Num, y: Num) -> tuple[Column, Column]:
        """Fractional (col, row); across the antimeridian, longitudes below the west edge go on."""
        lon = c(x)
        if self.srs == "EPSG:4326" and self.east > 180.0:
            lon = F.when(lon < self.west, lon + 360.0).otherwise(lon)
        return (lon - self.west) / self.res_x, (c(y) - self.south) / self.res_y

    def cell(self, x: Num, y: Num) -> tuple[Column, Column]:
        """(row, col), null outside."""
        fx, fy = self.xy(x, y)
        inside = (fx >= 0) & (fx < self.cols) & (fy >= 0) & (fy < self.rows)
        return F.when(inside, F.floor(fy).cast("int")), F.when(inside, F.floor(fx).cast("int"))

    def centre(self, row: Num, col: Num) -> tuple[Column, Column]:
        return self.west + (c(col) + 0.5) * self.res_x, self.south + (c(row) + 0.5) * self.res_y

    def shifted(self, rows: int, cols: int) -> GridSpec:
        """Geometric translation: the axes move, cells keep their numbers."""
        return replace(self, west=self.west + cols * self.res_x, south=self.south + rows * self.res_y)

    def realigned(self, tolerance: float = 1e-4) -> GridSpec:
        """Edges moved outwards to multiples of the resolution unless they are that close."""
        snap = lambda v, r, f: round(v / r) * r if abs(v / r - round(v / r)) <= tolerance else f(v / r) * r
        return GridSpec.of_extent(snap(self.west, self.res_x, math.floor), snap(self.east, self.res_x, math.ceil), snap(self.south, self.res_y, math.floor), snap(self.north, self.res_y, math.ceil), self.res_x, self.res_y, self.srs)

    def extended(self, other: GridSpec) -> GridSpec:
        """Smallest box of this resolution around both."""
        return GridSpec.of_extent(min(self.west, other.west), max(self.east, other.east), min(self.south, other.south), max(self.north, other.north), self.res_x, self.res_y, self.srs)

    def compatible(self, other: GridSpec) -> bool:
        """Same reference system and the same resolution within 1e-10."""
        return self.srs == other.srs and abs(self.res_x - other.res_x) < 1e-10 and abs(self.res_y - other.res_y) < 1e-10

    def at_position(self, position: str) -> GridSpec:
        """Grid whose cells are centred where points named by corner or centre are."""
        dx, dy = {"center": (-0.5, -0.5), "LL": (0, 0), "LR": (-1, 0), "UL": (0, -1), "UR": (-1, -1)}[position]
        return replace(self, west=self.west + dx * self.res_x, south=self.south + dy * self.res_y)


def needs_antimeridian(left: float, right: float) -> bool:
    """Whether the box is smaller the other way round."""
    return left - right + 360.0 < right - left


def round_resolution(metres: float) -> float:
    """10 m above 100, 1 m above 10, else 0.01 m; halves to even."""
    step = 10.0 if metres >= 100 else 1.0 if metres >= 10 else 0.01
    return round(metres / step) * step


def beam_direction(tx: Num, rx: Num, delta: Num) -> tuple[Column, Column]:
    """(incidence, azimuth) in degrees where a transmit and a receive cone meet; delta is how far
    the arrays are from the right angle."""
    t, r, d = (F.radians(c(v)) for v in (tx, rx, delta))
    x, y = F.sin(t), F.sin(t) * F.tan(d) - F.sin(r) / F.cos(d)
    flat = F.sqrt(x * x + y * y)
    return F.degrees(F.atan2(flat, F.sqrt(F.greatest(F.lit(0.0), 1.0 - x * x - y * y)))), F.degrees(F.atan2(y, x))


def cell_count(low: Num, high: Num, step: float) -> Column:
    """Rows or columns of an extent: the ceiling of its length, rounded to ten digits, in steps."""
    return F.ceil(F.round((c(high) - c(low)) / step, 10))


def crosses_antimeridian(left: Num, right: Num) -> Column:
    """Whether the box is smaller the other way round."""
    return c(left) - c(right) + 360.0 < c(right) - c(left)


def rounded_resolution(metres: Num) -> Column:
    """10 m from 100 on, 1 m from 10 on, else 0.01 m; halves to even."""
    m = c(metres)
    return F.when(m >= 100, F.rint(m / 10) * 10).when(m >= 10, F.rint(m)).otherwise(F.rint(m / 0.01) * 0.01)


def quadratic_roots(a: Num, b: Num, cc: Num) -> tuple[Column, Column]:
    """Real roots of a x^2 + b x + c, the smaller first; null where there is none.  With a (almost)
    zero the one root comes first."""
    a, b, cc = c(a), c(b), c(cc)
    d = b * b - 4 * a * cc
    one, two = (-b - F.sqrt(d)) / (2 * a), (-b + F.sqrt(d)) / (2 * a)
    flat = F.abs(a) < 1e-12
    return F.when(flat, -cc / F.nullif(b, F.lit(0.0))).when(d >= 0, F.least(one, two)), F.when(~flat & (d >= 0), F.greatest(one, two))
