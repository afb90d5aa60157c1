"""Tracks and paths: shifting, resampling, chain codes; mode graphs and lookups by mode."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import azimuth, offset_position
from .temporal import interpolating


def shift(nav: DataFrame, vectors: DataFrame, keys: list[str], t: str) -> DataFrame:
    """nav (lon, lat) moved by shift vectors (east, north) in metres, interpolated in time; as it
    was outside their span."""
    out = nav
    for k in ("east", "north"):
        out = interpolating(out, vectors, keys, t, k, "zero")
    lon, lat = offset_position("north", "east", "lon", "lat", 0.0)
    return out.withColumns({"lon": lon, "lat": lat}).drop("east", "north")


def resample_path(xy: np.ndarray, n: int) -> np.ndarray:
    """n evenly spaced points along a path; each vertex then replaces the point nearest to it."""
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
    at = np.linspace(0, d[-1], n)
    out = np.stack([np.interp(at, d, xy[:, k]) for k in (0, 1)], 1)
    for v, s in zip(xy, d):
        out[np.abs(at - s).argmin()] = v
    return out


def resample_paths(points: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Paths (key, order, x, y) as n points each; a path is one task's work."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        xy = resample_path(p[["x", "y"]].to_numpy(float), n) if len(p) > 1 else p[["x", "y"]].to_numpy(float)
        return pd.DataFrame({key: p[key].iloc[0], "i": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})

    return points.select(key, order, "x", "y").groupBy(key).applyInPandas(one, points.select(key, F.lit(0).alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).schema)


def chain_code(points: DataFrame, key: str, order: str, width: float) -> DataFrame:
    """Mean azimuth of the half window ahead less that of the half window behind, along the
    cumulative distance, both ends of the window included."""
    w = Window.partitionBy(key).orderBy(order)
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    p = points.select(key, order, "x", "y", azimuth(dx, dy).alias("_a"), F.sqrt(dx * dx + dy * dy).alias("_d"))
    p = p.withColumn("along", F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    p = p.withColumn("_mm", F.round(F.col("along") * 1000).cast("long"))  # whole numbers, so the frame is exact
    half = round(width * 500)
    side = lambda lo, hi: F.avg("_a").over(Window.partitionBy(key).orderBy("_mm").rangeBetween(lo, hi))
    return p.select(key, order, "along", (side(0, half) - side(-half, 0)).alias("code"))


def first_match(left: DataFrame, right: DataFrame, on: Column, key: list[str], rank: list[Column], value: list[str], most: int = 10_000) -> DataFrame:
    """left's keys with the first right row in rank order among those that ``on`` allows; left rows
    without one are kept.  ``on`` may be any condition, so right is broadcast; it is counted first,
    and a table of more than ``most`` rows is refused."""
    if right.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to choose from: join on a key instead")
    j = left.join(F.broadcast(right), on, "left")
    return j.groupBy(*key).agg(F.min_by(F.struct(*value), F.struct(*rank)).alias("_m")).select(*key, *(F.col(f"_m.{k}").alias(k) for k in value))


def propagate_offsets(edges: DataFrame, start: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """(mode, offset, weight) of every mode that transitions (from_mode, to_mode, offset, n) reach
    from those of ``start`` (mode), whose own weight is null: without bound.

    The graph is walked in rounds, from all modes of a round to those not reached before: along a step
    offsets add and weights combine as w n / (w + n), steps that meet in one mode are averaged by weight
    and their weights add, so cycles end where they began.  A round is a join, a sum and an anti-join;
    ``keep`` writes its modes.  Nulls in either mode or the offset, and counts below 1, are no transition."""
    e = edges.filter("from_mode is not null and to_mode is not null and offset is not null and n > 0")
    seen = front = keep(start.select("mode").filter("mode is not null").distinct().select("mode", F.lit(0.0).alias("offset"), F.lit(None).cast("double").alias("weight")))
    for _ in range(most):
        step = e.join(front.select(F.col("mode").alias("from_mode"), F.col("offset").alias("_o"), F.col("weight").alias("_w")), "from_mode")
        step = step.join(seen.select(F.col("mode").alias("to_mode")), "to_mode", "left_anti")
        w, n = F.col("_w"), F.col("n").cast("double")
        step = step.select(F.col("to_mode").alias("mode"), (F.col("_o") + F.col("offset")).alias("o"), F.coalesce(w * n / (w + n), n).alias("w"))
        front = keep(step.groupBy("mode").agg((F.sum(F.col("o") * F.col("w")) / F.sum("w")).alias("offset"), F.sum("w").alias("weight")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError(f"modes are more than {most} steps apart")


def propagate(edges: list[tuple[str, str, float, float]], start: str) -> dict[str, tuple[float, float]]:
    """(offset, weight) of each mode against start over transitions (from, to, offset, count).

    Along a path offsets add and weights combine as n1 n2 / (n1 + n2); parallel paths are averaged
    by weight and their weights add.  Modes are a few dozen at most.
    """
    out = {start: (0.0, float("inf"))}
    while True:
        new: dict[str, list[tuple[float, float]]] = {}
        for a, b, o, n in edges:
            if a in out and b not in out:
                w = out[a][1]
                new.setdefault(b, []).append((out[a][0] + o, n if w == float("inf") else w * n / (w + n)))
        if not new:
            return out
        for b, paths in new.items():
            total = sum(w for _, w in paths)
            out[b] = (sum(o * w for o, w in paths) / total, total)
