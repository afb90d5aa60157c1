"""Queries that run numerical kernels; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import angular as an
from ..operators import inpaint as ip
from ..operators import solvers as so
from ..operators import tide as td
from .bind import PINGS, detections, grid, pings, r, track
from .registry import query
from .tables import cut


def _curve(spark, sf, keys):
    return an.incidence_curve(detections(spark, sf), "db", "angle", keys)


@query("x11_a24_spline_curves")
def x11(spark, sf):
    return so.spline_curves(_curve(spark, sf, an.CURVE), an.CURVE).select(*an.CURVE, "bin", *r("mean_db", "smooth_db"), "n")


@query("x23_gsab_fit")
def x23(spark, sf):
    return so.gsab_curves(_curve(spark, sf, ["mode"]), ["mode"]).select("mode", *r(*"abcdef", "rms"))


@query("x18_ray_tracing")
def x18(spark, sf):
    d = detections(spark, sf).select(F.col("ok").alias("id"), (F.col("angle") * 0.01).alias("seconds"), (F.col("angle") + 10).alias("incidence"))
    return so.trace_rays(d, [0.0, 50.0, 200.0, 1000.0], [1510.0, 1500.0, 1490.0, 1500.0], 5.0)


@query("x07_gap_filling")
def x07(spark, sf):
    return so.fill_gaps(grid(spark, sf).filter("value_count % 5 != 0"), "mean", 3, 16).select("row", "col", *r("value"), "flag")


@query("x12_harmonic_inpainting")
def x12(spark, sf):
    return so.fill_gaps(grid(spark, sf).filter("value_count % 5 != 0"), "mean", 8, 32, "harmonic").select("row", "col", *r("value"), "flag")


def _inpainted(spark, sf, how):
    g = grid(spark, sf)
    size = g.agg(F.max("row"), F.max("col")).first()
    out = ip.inpaint(g.filter("value_count % 5 != 0"), "mean", (size[0] or 0) + 1, (size[1] or 0) + 1, cut, how, 3, 8)
    return out.select("row", "col", *r("value", "change"))


@query("x12_amle_inpainting")
def x12b(spark, sf):
    """Holes by absolutely minimising Lipschitz extension; tiles exchange borders every eight sweeps."""
    return _inpainted(spark, sf, "amle")


@query("x12_tv_inpainting")
def x12c(spark, sf):
    """Holes by total variation."""
    return _inpainted(spark, sf, "tv")


@query("x16_outliers")
def x16(spark, sf):
    d = detections(spark, sf).select("row", F.xxhash64("ok", "ln", "p", "px").alias("id"), F.col("px").alias("x"), F.col("sy").alias("y"), "z")
    return so.outliers(d, ["row"])


@query("x30_best_planes")
def x30(spark, sf):
    d = detections(spark, sf).select("row", F.col("px").alias("x"), F.col("sy").alias("y"), "z")
    return so.planes(d, "row").select("row", *r(*"abcd"))


@query("w19_low_pass")
def w19(spark, sf):
    return so.low_pass(pings(spark, sf), ["kind"], "t", "value").select("kind", "t", *r("filtered"))


# Main tidal constituents as (name, amplitude, degrees an hour, phase).
_TIDES = [("M2", 1.2, 28.9841042, 30.0), ("S2", 0.4, 30.0, 60.0), ("N2", 0.25, 28.4397295, 10.0), ("K1", 0.1, 15.0410686, 120.0), ("O1", 0.08, 13.9430356, 200.0)]


@query("x27_tide_prediction", f"""WITH {PINGS} SELECT event_id, round({' + '.join(f"{a} * cos(radians({s} * (t - 1704067200000000) / 3.6e9 - {p}))" for _, a, s, p in _TIDES)}, 4) AS tide FROM pings""")
def x27(spark, sf):
    c = spark.createDataFrame(_TIDES, "name string, amplitude double, speed double, phase double")
    t = pings(spark, sf).select("event_id", ((F.col("t") - 1_704_067_200_000_000) / 3.6e9).alias("hours"))
    return so.tide(t, c).select("event_id", *r("tide"))


@query("x28_antenna_tide")
def x28(spark, sf):
    """Tide from antenna heights, a series a kind of event, in predictive mode; a step an hour."""
    c = spark.createDataFrame(_TIDES, "name string, amplitude double, speed double, phase double")
    p = track(spark, sf).select("kind", "t", (F.col("value") / 100).alias("height"), (F.col("lat") / 100).alias("surface"), ((F.col("t") - 1_704_067_200_000_000) / 3.6e9).alias("hours"))
    out = td.antenna_tide(so.tide(p, c), "kind", "t", "height", "surface", "tide", 0.25, 3600.0, 1 / 86_400, gap=43_200.0, interval=21_600.0)
    return out.select("file", "t", *r("tide"))


@query("x22_depth_correction", f"""WITH {PINGS}, d AS (SELECT event_id, file, t, value AS z FROM pings WHERE kind <> 'purchase'), c AS (SELECT file, t, event_id % 7 AS tide FROM pings WHERE kind = 'purchase'),
a AS (SELECT d.*, c.t AS t0, c.tide AS v0 FROM d ASOF LEFT JOIN c ON d.file = c.file AND d.t >= c.t), b AS (SELECT a.*, c.t AS t1, c.tide AS v1 FROM a ASOF LEFT JOIN c ON a.file = c.file AND a.t <= c.t)
SELECT event_id, round(z - CASE WHEN t0 IS NULL OR t1 IS NULL THEN 0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + 0.5, 5) AS depth FROM b""")
def x22(spark, sf):
    """Tide taken off, draught added."""
    from ..operators.temporal import interpolating

    p = pings(spark, sf)
    tide = p.filter("kind = 'purchase'").select("file", "t", (F.col("event_id") % 7).alias("tide"))
    d = interpolating(p.filter("kind != 'purchase'"), tide, ["file"], "t", "tide", "zero")
    return d.select("event_id", F.round(F.col("value") - F.col("tide") + 0.5, 5).alias("depth"))
