"""Regridding, point lookups on grids, contours and tile pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._cols import Num, c
from ..functions.geo import SEMI_MAJOR, GridSpec, to_mercator
from .grid import CELL
from .stencil import convolve, deviating, dilate, spread


def cells_of(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Every cell of a grid."""
    n = spark.range(spec.rows * spec.cols)
    return n.select(F.floor(F.col("id") / spec.cols).cast("int").alias("row"), (F.col("id") % spec.cols).cast("int").alias("col"))


def onto(grid: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """grid on the target's cells: each takes the source cell nearest to its centre, the higher
    one if two are as near.  An equi-join on the source cell."""
    t = cells_of(grid.sparkSession, target)
    x, y = target.centre("row", "col")
    row, col = source.cell(x, y)
    t = t.select(F.col("row").alias("_r"), F.col("col").alias("_c"), row.alias("row"), col.alias("col")).filter("row is not null")
    layers = [k for k in grid.columns if k not in CELL]
    return t.join(grid, CELL).select(F.col("_r").alias("row"), F.col("_c").alias("col"), *layers)


def bilinear(points: DataFrame, grid: DataFrame, layer: str, x: Num, y: Num, key: list[str]) -> DataFrame:
    """Layer at fractional cell positions (cell centres at whole numbers plus a half), from the four
    cells around each; null unless all four have a value."""
    fx, fy = c(x) - 0.5, c(y) - 0.5
    i, j = F.floor(fx), F.floor(fy)
    corner = lambda di, dj: F.struct((j + dj).cast("int").alias("row"), (i + di).cast("int").alias("col"), ((fx - i if di else 1 - (fx - i)) * (fy - j if dj else 1 - (fy - j))).alias("w"))
    p = points.select(*key, F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("k")).select(*key, "k.*")
    v = p.join(grid.filter(F.col(layer).isNotNull()).select(*CELL, F.col(layer).alias("_v")), CELL)
    return v.groupBy(*key).agg(F.sum(F.col("w") * F.col("_v")).alias(layer), F.count("*").alias("_n")).filter("_n = 4").drop("_n")


def inverse_distance_fill(grid: DataFrame, layer: str, radius: int) -> DataFrame:
    """Missing cells near others, by inverse distance; cells with a value keep it.  Stands for
    scattered linear interpolation, which needs a triangulation."""
    n = range(-radius, radius + 1)
    kernel = [[0.0 if (i, j) == (0, 0) else 1.0 / math.hypot(i, j) for j in n] for i in n]
    return convolve(grid, layer, kernel, preserve_missing=False, holes=True)


def residual_rejection(grid: DataFrame, layer: str, factor: float) -> DataFrame:
    """Cells further from the mean of their eight neighbours than ``factor`` of their deviation."""
    return deviating(grid.select(*CELL, layer), layer, factor, [[1.0] * 3] * 3, centre=False, least=3)


def contour_crossings(grid: DataFrame, layer: str, interval: float) -> DataFrame:
    """Where contours cross the edges between neighbouring cells: (level, x, y), in cells."""
    steps = [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 1.0, 0.0]]  # from the left and from above: right and upper neighbours
    s = spread(grid, layer, steps).select(*CELL, F.col("v").alias("b"), "w").join(grid.filter(F.col(layer).isNotNull()).select(*CELL, F.col(layer).alias("a")), CELL)
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    first, last = F.floor(lo / interval) + 1, F.floor(hi / interval)
    s = s.filter(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * interval)
    at = (F.col("level") - F.col("a")) / (F.col("b") - F.col("a"))
    return s.select("level", (F.col("col") + F.when(F.col("w") == 2.0, -at).otherwise(0.0)).alias("x"), (F.col("row") + F.when(F.col("w") == 1.0, at).otherwise(0.0)).alias("y"))


def tile(lon: Num, lat: Num, zoom: int) -> tuple[Column, Column]:
    """Web tile (x, y) of a position."""
    x, y = to_mercator(lon, lat)
    half, n = math.pi * SEMI_MAJOR, 1 << zoom
    return F.floor((x + half) / (2 * half) * n).cast("int"), F.floor((half - y) / (2 * half) * n).cast("int")


def pyramid(points: DataFrame, lon: Num, lat: Num, value: Num, zooms: list[int]) -> DataFrame:
    """Mean and count per tile and zoom level."""
    tiles = F.array(*(F.struct(F.lit(z).alias("zoom"), tile(lon, lat, z)[0].alias("tx"), tile(lon, lat, z)[1].alias("ty")) for z in zooms))
    p = points.select(c(value).alias("_v"), F.explode(tiles).alias("t"))
    return p.groupBy("t.zoom", "t.tx", "t.ty").agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))


def label_holes(grid: DataFrame, layer: str, label: str, count: str, cut) -> DataFrame:
    """The commonest label around each hole: (hole, label)."""
    from .stencil import components

    holes = components(grid.filter(F.col(layer).isNull()).select(*CELL), cut).withColumnRenamed("label", "hole")
    around = spread(holes.withColumn("hole", F.col("hole")), "hole", [[1.0] * 3] * 3, centre=False).select(*CELL, F.col("v").alias("hole")).distinct()
    seen = around.join(grid.filter(F.col(layer).isNotNull() & F.col(label).isNotNull()).select(*CELL, label, count), CELL)
    n = seen.groupBy("hole", label).agg(F.count("*").alias("_n"))
    return n.groupBy("hole").agg(F.max_by(label, F.struct("_n", label)).alias(label))


def border_band(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells outside the given ones within radius."""
    return dilate(cells, radius).join(cells.select(*CELL), CELL, "left_anti")
