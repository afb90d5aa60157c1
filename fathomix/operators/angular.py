"""Angle-binned response curves, their merging, and corrections by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import Num, c
from ..functions.acoustics import ENERGY, closed_bin, mean_db, to_db, to_linear

CURVE = ["mode", "antenna", "sector"]


def incidence_curve(beams: DataFrame, level: Num, angle: Num, keys: list[str] = CURVE, median: bool = False, scale: float = ENERGY) -> DataFrame:
    """Mean (or median) level by 1-degree bin from -0.5 to 89.5, on linear values."""
    mean = to_db(F.percentile(to_linear(level, scale), F.lit(0.5)), scale) if median else mean_db(level, scale)
    b = beams.withColumn("bin", closed_bin(angle, -0.5, 89.5, 1.0)).filter(F.col("bin").isNotNull() & c(level).isNotNull())
    return b.groupBy(*keys, "bin").agg(mean.alias("mean_db"), F.count("*").alias("n"))


def transmission_curve(beams: DataFrame, level: Num, residual: Num, angle: Num, keys: list[str] = CURVE) -> DataFrame:
    """Mean level and mean residual by 1-degree bin from -80.5 to 80.5."""
    b = beams.withColumn("bin", closed_bin(angle, -80.5, 80.5, 1.0)).filter("bin is not null")
    return b.groupBy(*keys, "bin").agg(mean_db(level).alias("mean_db"), F.avg(c(residual)).alias("residual_db"), F.count(c(residual)).alias("n"))


def merge_curves(curves: DataFrame, keys: list[str], value: str = "mean_db") -> DataFrame:
    """Curves of several files as one, weighted by their counts."""
    return curves.groupBy(*keys).agg((F.sum(F.col(value) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias(value), F.sum("n").alias("n"))


def merge_values(curves: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Several values of the curves of several files as one, each weighted by the counts of the
    curves that have it."""
    mean = lambda v: (F.sum(F.col(v) * F.col("n")) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("n"))), F.lit(0))).alias(v)
    return curves.groupBy(*keys).agg(*map(mean, values), F.sum("n").alias("n"))


def reference_level(curves: DataFrame, value: str = "mean_db") -> DataFrame:
    """Count-weighted mean of all levels, as levels."""
    return curves.agg((F.sum(F.col(value) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("level"))


def as_lookup(curves: DataFrame, keys: list[str], x: str = "bin", y: str = "mean_db") -> DataFrame:
    """One row per curve with its points as a sorted array; missing values removed."""
    ok = curves.filter(F.col(y).isNotNull())
    return ok.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("lut"))


def interpolate(lut: Column, x: Num) -> Column:
    """Linear interpolation in a sorted array of (x, y), clamped at both ends; null for a null x or
    an empty array.  The two neighbours are looked up once a row."""
    at = c(x)
    below, above = F.filter(lut, lambda p: p["x"] <= at), F.filter(lut, lambda p: p["x"] >= at)
    ends = F.struct(F.try_element_at(below, F.lit(-1)).alias("a"), F.try_element_at(above, F.lit(1)).alias("b"))

    def between(p: Column) -> Column:
        a, b = p["a"], p["b"]
        inner = a["y"] + (b["y"] - a["y"]) * (at - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
        return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(F.coalesce(inner, a["y"]))

    return F.transform(F.array(ends), between)[0]


def normalise(beams: DataFrame, curves: DataFrame, level: Num, angle: Num, keys: list[str], reference: float = -20.0, compensate: bool = True) -> DataFrame:
    """Static renormalisation: level + (reference - curve(angle)); null for an unknown mode.

    A curve is at most 90 points, so the joined side has one row per mode, antenna and sector."""
    j = beams.join(as_lookup(curves, keys), keys, "left")
    lut = reference - interpolate(F.col("lut"), angle)
    return j.withColumn("corrected", c(level) + lut if compensate else F.when(F.col("lut").isNotNull(), c(level))).drop("lut")


def residuals(beams: DataFrame, curves: DataFrame, level: Num, angle: Num, keys: list[str]) -> DataFrame:
    """Level minus the curve at the beam's angle."""
    j = beams.join(as_lookup(curves, keys), keys, "left")
    return j.withColumn("residual", c(level) - interpolate(F.col("lut"), angle)).drop("lut")


def metrics(rows: DataFrame, x: Num, value: Num, quantile: float, threshold: float, hue: list[str] = ()) -> DataFrame:
    """Mean, sample deviation, quantile and count by x (and hue); groups with less than threshold
    percent of their x are blanked."""
    g = rows.groupBy(c(x).alias("x"), *hue).agg(F.avg(c(value)).alias("mean"), F.stddev_samp(c(value)).alias("std"), F.percentile(c(value), F.lit(quantile)).alias("quantile"), F.count(c(value)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("x"))
    return g.withColumns({k: F.when(share >= threshold, F.col(k)) for k in ("mean", "std", "quantile")})


def modes(pings: DataFrame, key: list[str], time: str) -> DataFrame:
    """Distinct mode keys with ids in first-seen order.  Modes are few; only they are ranked."""
    first = pings.groupBy(*key).agg(F.min(time).alias("first_seen"), F.count("*").alias("n"))
    return first.withColumn("mode_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_seen", *key)) - 1)


def transitions(levels: DataFrame, half_window: float) -> DataFrame:
    """Level offsets at mode changes between consecutive pings at most half_window seconds apart:
    (from_mode, to_mode, offset, n) forward, and the same pairs backward with the sign changed.

    ``levels`` has file, t (seconds), mode, level."""
    w = Window.partitionBy("file").orderBy("t")
    d = levels.select("*", F.lag("mode").over(w).alias("m0"), F.lag("t").over(w).alias("t0"), F.lag("level").over(w).alias("l0"))
    d = d.filter((F.col("m0") != F.col("mode")) & (F.col("t") - F.col("t0") <= half_window))
    fwd = d.groupBy(F.col("m0").alias("from_mode"), F.col("mode").alias("to_mode")).agg(F.avg(F.col("level") - F.col("l0")).alias("offset"), F.count("*").alias("n"))
    back = fwd.select(F.col("to_mode").alias("from_mode"), F.col("from_mode").alias("to_mode"), (-F.col("offset")).alias("offset"), "n")
    return fwd.unionByName(back).groupBy("from_mode", "to_mode").agg((F.sum(F.col("offset") * F.col("n")) / F.sum("n")).alias("offset"), F.sum("n").alias("n"))
