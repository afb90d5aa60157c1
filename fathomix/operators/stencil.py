"""Neighbourhood operators on sparse grids.

Windows are looked up in tiles (``gather``): cells are shuffled once, to tiles of ``TILE`` x ``TILE`` cells
and, near an edge, to the neighbour tiles too.  A tile's cells look their neighbours up by place, so no
row is made for a cell and step of the kernel, and what a Python worker holds is one tile, however
large or sparse the grid is.  ``spread`` sends a cell to every cell whose window it is in, with its
weight, for what isn't an aggregate of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .grid import CELL, merge_fill
from .solvers import with_tiles
from .temporal import fill_linear

BLOCK = 64  # cells; has no influence on results
TILE = 256  # cells; has no influence on results
CLOSING_TILE = 512  # the same

# Named smoothing kernels.
KERNELS = {
    "box3": [[1, 1, 1], [1, 1, 1], [1, 1, 1]],
    "gauss3": [[1, 2, 1], [2, 4, 2], [1, 2, 1]],
    "gauss5": [[1, 4, 7, 4, 1], [4, 16, 26, 16, 4], [7, 26, 41, 26, 7], [4, 16, 26, 16, 4], [1, 4, 7, 4, 1]],
    "cross3": [[0, 1, 0], [1, 1, 1], [0, 1, 0]],
    "centre3": [[1, 1, 1], [1, 8, 1], [1, 1, 1]],
    "box5": [[1] * 5] * 5,
}


def spread(grid: DataFrame, layer: str, kernel: list[list[float]], centre: bool = True) -> DataFrame:
    """Rows (row, col, v, w, self): each value at every cell it weighs on."""
    k, m = len(kernel) // 2, len(kernel[0]) // 2
    steps = [(i - k, j - m, float(w)) for i, r in enumerate(kernel) for j, w in enumerate(r) if w and (centre or (i, j) != (k, m))]
    moves = F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(w).alias("w")) for i, j, w in steps))
    cells = grid.filter(F.col(layer).isNotNull()).select(*CELL, F.col(layer).alias("v"))
    cells = cells.repartition(*(F.floor(F.col(x) / BLOCK) for x in CELL))
    out = cells.select(*CELL, "v", F.explode(moves).alias("m"))
    return out.select((F.col("row") + F.col("m.i")).alias("row"), (F.col("col") + F.col("m.j")).alias("col"), "v", F.col("m.w").alias("w"), ((F.col("m.i") == 0) & (F.col("m.j") == 0)).alias("self"))


def _steps(kernel: list[list[float]], centre: bool = True) -> tuple[list[tuple[int, int]], list[float]]:
    """Steps of a kernel to the cells that weigh on one, and their weights."""
    k, m = len(kernel) // 2, len(kernel[0]) // 2
    all_ = [((i - k, j - m), float(w)) for i, r in enumerate(kernel) for j, w in enumerate(r) if w and (centre or (i, j) != (k, m))]
    return [s for s, _ in all_], [w for _, w in all_]


def gather(grid: DataFrame, layers: list[str], steps: list[tuple[int, int]], calc: Callable, names: list[str], keep: list[str] = (), own: bool = True, holes: bool = False) -> DataFrame:
    """(row, col, *keep, *names): what ``calc`` makes of the values that each cell finds at its steps.

    ``calc(found, n)`` gives for n cells an array (values, there or None) a name; ``found`` goes through the steps
    as (number of the step, whether its first row, [(value or 0, whether there is one) a layer]).  Cells
    are those of the grid, with its columns ``keep``, or all that have one at a step (``own`` False), or of these
    the ``holes``, which aren't in the grid themselves.
    """
    reach = max(max(abs(i), abs(j)) for i, j in steps)
    values = [f"_v{n}" for n in range(len(layers))]
    cells = grid.select(*CELL, *keep, *(F.col(k).cast("double").alias(v) for k, v in zip(layers, values)))
    kept = [cells.schema[k] for k in [*CELL, *keep]]
    wide = TILE + 2 * reach

    def one(key: tuple, t: pa.Table) -> pa.Table:
        low = [k.as_py() * TILE - reach for k in key]
        r, c = (t[k].to_numpy().astype(np.int64) - at for k, at in zip(CELL, low))
        order = np.argsort(r * wide + c, kind="stable")
        r, c = r[order], c[order]
        keys = r * wide + c
        vals = [(t[k].to_numpy()[order], t[k].is_valid().to_numpy()[order]) for k in values]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(fresh)
        times = int(np.diff(np.append(starts, len(keys))).max())
        place = np.full(wide * wide, -1, np.int64)
        place[keys[starts]] = starts
        inside = lambda y, x: (y >= reach) & (y < reach + TILE) & (x >= reach) & (x < reach + TILE)
        if own:
            mine = np.flatnonzero(inside(r, c) & (fresh | bool(keep)))
            at = keys[mine]
            out = [t[f.name].take(pa.array(order[mine])) for f in kept]
        else:
            hit = np.zeros(wide * wide, bool)
            for i, j in steps:
                ok = inside(r - i, c - j)
                hit[keys[ok] - i * wide - j] = True
            if holes:
                hit[keys] = False
            at = np.flatnonzero(hit)
            out = [pa.array(v + b).cast(t[k].type) for v, b, k in zip(np.divmod(at, wide), low, CELL)]

        def found() -> Iterator[tuple]:
            for n, (i, j) in enumerate(steps):
                first = place[at + i * wide + j]
                hit = first >= 0
                for again in range(times):
                    if again:
                        first = np.minimum(first + 1, len(keys) - 1)
                        hit = hit & ~fresh[first]
                    there = [hit & v[1][first] for v in vals]
                    yield n, not again, [(np.where(h, v[0][first], 0.0), h) for v, h in zip(vals, there)]

        new = calc(found(), len(at)) if names else []
        out += [pa.array(v, pa.float64(), mask=None if there is None else ~there) for v, there in new]
        return pa.Table.from_arrays(out, names=[*(f.name for f in kept), *names])

    tiles = with_tiles(cells, TILE, reach).drop("_own").repartition("_tr", "_tc")
    return tiles.groupBy("_tr", "_tc").applyInArrow(one, StructType([*kept, *(StructField(n, DoubleType()) for n in names)]))


def _moments(own: Iterator[tuple], n: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population deviation and count of what is found; two passes."""
    seen = [v[layer] for _, _, v in own]
    count = sum((h for _, h in seen), np.zeros(n))
    mean = sum((v for v, _ in seen), np.zeros(n)) / np.maximum(count, 1)
    apart = sum((np.where(h, v - mean, 0.0) ** 2 for v, h in seen), np.zeros(n))
    return mean, np.sqrt(apart / np.maximum(count, 1)), count


def convolve(grid: DataFrame, layer: str, kernel: list[list[float]], normalise: bool = True, preserve_missing: bool = True, keep: list[str] = (), holes: bool = False) -> DataFrame:
    """Weighted mean over present neighbours; missing cells stay missing, or are interpolated, or only these
    are given (``holes``, without preserve_missing).  With preserve_missing columns ``keep`` stay, the mean replaces none of them but is called ``_m``."""
    steps, weights = _steps(kernel)

    def calc(found: Iterator[tuple], n: int) -> list:
        total, weight, count = np.zeros(n), np.zeros(n), np.zeros(n)
        for k, _, [(v, there)] in found:
            total += v * weights[k]
            weight += there * weights[k]
            count += there
        return [(total, None), (weight, None), (count, None)]

    out = gather(grid.filter(F.col(layer).isNotNull()), [layer], steps, calc, ["_t", "_w", "_n"], keep, preserve_missing, holes).filter("_n > 0")
    value = F.col("_t") / F.col("_w") if normalise else F.col("_t")
    return out.select(*CELL, *keep, value.alias("_m" if keep else layer))


def smooth(grid: DataFrame, kernel: str, layer: str = "mean") -> DataFrame:
    """A layer smoothed by a named kernel over present cells; min and max are widened where the
    smoothed value leaves them.  Missing cells stay missing."""
    new = convolve(grid, layer, [[float(w) for w in row] for row in KERNELS[kernel]]).withColumnRenamed(layer, "_new")
    out = grid.join(new, CELL, "left")
    return out.withColumns({layer: F.col("_new"), "min": F.least("min", "_new"), "max": F.greatest("max", "_new")}).drop("_new")


def box_mean(grid: DataFrame, layer: str, size: int, mask: Column | None = None) -> DataFrame:
    """Mean of present cells in an odd window, where the mask holds; other cells unchanged."""
    marked = grid.select(*CELL, layer, (F.lit(True) if mask is None else mask).alias("_ok"))
    means = convolve(marked, layer, [[1.0] * size] * size, keep=[layer, "_ok"])
    out = means.select(*CELL, F.when(F.col("_ok"), F.col("_m")).otherwise(F.col(layer)).alias(layer))
    return out.unionByName(marked.filter(F.col(layer).isNull()).select(*CELL, F.col(layer).cast("double").alias(layer)))


def neighbour_deviation(grid: DataFrame, layer: str = "mean", stdev: str = "stdev") -> DataFrame:
    """Of the eight neighbours: mean deviation and population deviation of elevations."""
    steps, _ = _steps([[1.0] * 3] * 3, centre=False)

    def calc(found: Iterator[tuple], n: int) -> list:
        seen = list(found)
        mean, _, some = _moments(seen, n, 1)
        _, apart, count = _moments(seen, n)
        return [(mean, some > 0), (apart, count > 0)]

    return gather(grid, [layer, stdev], steps, calc, ["near_stdev", "near_spread"])


def dilate(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells within the square radius of any."""
    size = 2 * radius + 1
    return gather(cells.select(*CELL), [], _steps([[1.0] * size] * size)[0], None, [], own=False)


def erode(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells whose whole square neighbourhood is there."""
    size = 2 * radius + 1

    def calc(found: Iterator[tuple], n: int) -> list:
        return [(sum((v[0][1] for _, first, v in found if first), np.zeros(n)), None)]

    one = cells.select(*CELL, F.lit(1.0).alias("_one"))
    return gather(one, ["_one"], _steps([[1.0] * size] * size)[0], calc, ["n"]).filter(F.col("n") == size * size).select(*CELL)


def border(cells: DataFrame, radius: int = 1) -> DataFrame:
    """The band between dilation and erosion."""
    return dilate(cells, radius).join(erode(cells, radius), CELL, "left_anti")


def nearest_fill(grid: DataFrame, layer: str, radius: int, targets: DataFrame) -> DataFrame:
    """Missing targets take the nearest value within the window; ties: smaller row, then column."""
    span = range(-radius, radius + 1)
    steps = sorted(((i, j) for i in span for j in span if i or j), key=lambda s: s[0] ** 2 + s[1] ** 2)
    far = [i * i + j * j for i, j in steps]

    def calc(found: Iterator[tuple], n: int) -> list:
        best, at = np.zeros(n), np.full(n, np.inf)  # the least value at each distance, the nearest first
        for k, _, [(v, there)] in found:
            new = there & ((at > far[k]) | ((at == far[k]) & (v < best)))
            best[new], at[new] = v[new], far[k]
        return [(best, np.isfinite(at))]

    k = grid.filter(F.col(layer).isNotNull()).select(*CELL, F.lit(True).alias("_have"))
    want = targets.select(*CELL).join(k, CELL, "left").filter("_have is null").drop("_have")
    src = gather(grid.filter(F.col(layer).isNotNull()), [layer], steps, calc, ["_near"], own=False)
    return want.join(src, CELL).select(*CELL, F.col("_near").cast(grid.schema[layer].dataType).alias(layer))


def _nine(grid: DataFrame, layer: str, of: Callable, names: list[str]) -> DataFrame:
    """Numbers made of the 3 x 3 values around a cell (1 to 9, row by row), where all are there."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def calc(found: Iterator[tuple], n: int) -> list:
        z, count = {}, np.zeros(n)
        for k, first, [(v, there)] in found:
            z[k + 1] = v if first else np.where(there, np.maximum(z[k + 1], v), z[k + 1])
            count += there
        return [(v, count == 9) for v in of(z)]

    out = gather(grid.filter(F.col(layer).isNotNull()), [layer], steps, calc, names)
    return out.filter(F.col(names[0]).isNotNull())


def slope_aspect(grid: DataFrame, layer: str, res_x: float, res_y: float) -> DataFrame:
    """Horn slope and aspect in degrees, where all eight neighbours are there; rows go north."""

    def horn(z: dict) -> list:
        dx = ((z[3] + 2.0 * z[6] + z[9]) - (z[1] + 2.0 * z[4] + z[7])) / (8.0 * res_x)
        return [dx, ((z[7] + 2.0 * z[8] + z[9]) - (z[1] + 2.0 * z[2] + z[3])) / (8.0 * res_y)]

    out = _nine(grid, layer, horn, ["dx", "dy"])
    return out.select(*CELL, F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("dx"), -F.col("dy"))), F.lit(360.0)).alias("aspect"))


def hillshade(grid: DataFrame, layer: str, res_x: float, res_y: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light on the surface, 0 to 1."""
    s = slope_aspect(grid, layer, res_x, res_y)
    alt = F.radians(F.lit(altitude))
    light = F.sin(alt) * F.cos(F.radians("slope")) + F.cos(alt) * F.sin(F.radians("slope")) * F.cos(F.radians(F.lit(azimuth) - F.col("aspect")))
    return s.select(*CELL, F.greatest(F.lit(0.0), light).alias("light"))


def curvature(grid: DataFrame, layer: str) -> DataFrame:
    """Gaussian curvature by central differences, where the eight neighbours are there."""

    def differences(z: dict) -> list:
        return [(z[6] - z[4]) / 2.0, (z[8] - z[2]) / 2.0, z[6] - 2.0 * z[5] + z[4], z[8] - 2.0 * z[5] + z[2], (z[9] - z[7] - z[3] + z[1]) / 4.0]

    out = _nine(grid, layer, differences, ["gx", "gy", "gxx", "gyy", "gxy"])
    g = 1.0 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    return out.select(*CELL, ((F.col("gxx") * F.col("gyy") - F.col("gxy") * F.col("gxy")) / (g * g)).alias("curvature"))


def peaks_by_share(grid: DataFrame, layer: str, size: int, percent: float) -> DataFrame:
    """Cells whose distance from the local mean is at least percent of their own size, dilated."""
    m = convolve(grid, layer, [[1.0] * size] * size, keep=[layer])
    hit = m.filter(F.abs(F.col("_m") - F.col(layer)) >= percent / 100.0 * F.abs(F.col(layer)))
    return dilate(hit, 2)


def components(cells: DataFrame, materialise=None) -> DataFrame:
    """Four-connected components as (row, col, label), by minimum labels and pointer jumping.

    Rounds follow the longest path's logarithm in practice; each is cut off by ``materialise``
    (default: checkpoint(), which needs the session's checkpoint folder).
    """
    cut = materialise or (lambda d: d.checkpoint())
    big = 1 << 32
    key = F.col("row").cast("long") * big + F.col("col").cast("long")
    cur = cut(cells.select(*CELL, key.alias("label")).distinct())
    while True:
        near = spread(cur, "label", KERNELS["cross3"]).groupBy(*CELL).agg(F.min("v").alias("up"))
        step = cur.join(near, CELL).select(*CELL, "label", F.least("label", "up").alias("up"))
        # a label follows the smallest label any of its cells saw
        to = step.groupBy("label").agg(F.min("up").alias("to"))
        new = cut(step.select(*CELL, "label").join(to, "label").select(*CELL, F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.drop("moved")
        cur = new.drop("moved")


def small_holes(grid: DataFrame, layer: str, below: int, materialise=None) -> DataFrame:
    """Components of missing cells with fewer than ``below`` cells."""
    label = components(grid.filter(F.col(layer).isNull()), materialise)
    area = label.groupBy("label").agg(F.count("*").alias("area"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    return area.filter(F.col("area") < below)


def merge_smoothed(stacked: DataFrame, layer: str, radius: int = 1) -> DataFrame:
    """Grids merged by priority, with the border of the first one smoothed: cells within ``radius``
    of its edge, on either side, take the mean of the window around them."""
    merged = merge_fill(stacked, [layer])
    band = border(stacked.filter((F.col("priority") == 0) & F.col(layer).isNotNull()).select(*CELL), radius).withColumn("_band", F.lit(True))
    means = convolve(merged, layer, [[1.0] * (2 * radius + 1)] * (2 * radius + 1)).withColumnRenamed(layer, "_m")
    j = merged.join(band, CELL, "left").join(means, CELL, "left")
    return j.select(*CELL, F.when(F.col("_band") & F.col(layer).isNotNull(), F.col("_m")).otherwise(F.col(layer)).alias(layer))


def peaks_by_deviation(grid: DataFrame, layer: str, factor: float, size: int = 3) -> DataFrame:
    """Cells further from the mean of their window than ``factor`` times its deviation; a window of
    one cell has none."""
    return deviating(grid, layer, factor, [[1.0] * size] * size)


def deviating(grid: DataFrame, layer: str, factor: float, window: list[list[float]], centre: bool = True, least: int = 1) -> DataFrame:
    """Rows of the cells further from the mean of the window's present cells than ``factor`` times their
    deviation, where there are ``least`` of them."""

    def calc(found: Iterator[tuple], n: int) -> list:
        mean, apart, count = _moments(found, n)
        return [(mean, count >= least), (apart, None)]

    j = gather(grid.filter(F.col(layer).isNotNull()), [layer], _steps(window, centre)[0], calc, ["_m", "_s"], [k for k in grid.columns if k not in CELL])
    return j.filter(F.abs(F.col(layer) - F.col("_m")) > factor * F.col("_s")).select(*grid.columns)


def _touched(cells: np.ndarray, radius: int) -> np.ndarray:
    """Cells within the square radius of any, as far as the array goes."""
    for axis in (0, 1):
        near, cells = cells.copy().swapaxes(0, axis), cells.swapaxes(0, axis)
        for k in range(1, radius + 1):
            near[k:] |= cells[:-k]
            near[:-k] |= cells[k:]
        cells = near.swapaxes(0, axis)
    return cells


def closed(grid: DataFrame, layer: str, radius: int) -> DataFrame:
    """(row, col, layer) of the cells with a value, and of those that a morphological closing adds to them, null.
    Dilation and erosion are one tile's work, so cells are sent once and not as often as they dilate."""
    reach = 2 * radius
    wide = CLOSING_TILE + 2 * reach
    cells = grid.filter(F.col(layer).isNotNull()).select(*CELL, F.col(layer).cast("double").alias(layer))
    types = [f.type for f in to_arrow_schema(cells.schema)]

    def one(key: tuple, t: pa.Table) -> pa.Table:
        low = [k.as_py() * CLOSING_TILE - reach for k in key]
        r, c = (t[k].to_numpy().astype(np.int64) - at for k, at in zip(CELL, low))
        there = np.zeros((wide, wide), bool)
        there[r, c] = True
        new = ~_touched(~_touched(there, radius), radius) & ~there
        holes = [v + reach for v in np.nonzero(new[reach:-reach, reach:-reach])]
        own = (r >= reach) & (r < wide - reach) & (c >= reach) & (c < wide - reach)
        at = [pa.array(np.concatenate([v[own], h]) + b).cast(kind) for v, h, b, kind in zip((r, c), holes, low, types)]
        value = np.concatenate([t[layer].to_numpy()[own], np.zeros(len(holes[0]))])
        return pa.Table.from_arrays([*at, pa.array(value, mask=np.arange(len(value)) >= own.sum())], names=[*CELL, layer])

    tiles = with_tiles(cells, CLOSING_TILE, reach).drop("_own").repartition("_tr", "_tc")
    return tiles.groupBy("_tr", "_tc").applyInArrow(one, cells.schema)


def bilinear_fill(grid: DataFrame, layer: str, radius: int = 2, limit: int | None = None) -> DataFrame:
    """Holes that a morphological closing closes, filled by the mean of linear interpolation along
    their row and along their column (or the one there is); at most ``limit`` cells from a value."""
    u = closed(grid, layer, radius).withColumns({"_a": F.col(layer), "_b": F.col(layer)})
    for value, key, x in (("_a", "row", "col"), ("_b", "col", "row")):
        u = fill_linear(u, [key], x, value, limit)
    mean = F.coalesce((F.col("_a") + F.col("_b")) / 2, "_a", "_b")
    return u.filter(F.col(layer).isNull()).select(*CELL, mean.alias(layer)).filter(F.col(layer).isNotNull())
