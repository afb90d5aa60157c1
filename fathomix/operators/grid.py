"""Gridding, merging, coarsening and cell-wise rules.

A grid is a sparse table keyed by (row, col); a missing cell is an absent row, a missing layer a
null.  Every aggregate here has a map-side part, so points never meet in one task per cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import Num, c
from ..functions.acoustics import weighted_mean

CELL = ["row", "col"]


def grid_statistics(points: DataFrame, value: Num, order: list[Num], x: Num | None = None, y: Num | None = None, keys: list[str] = CELL) -> DataFrame:
    """Count, mean, min, max, last, sum, population deviation, count of missing values, and the
    mean position of each cell.  ``order`` must order points totally for ``last`` to be defined."""
    v = c(value)
    seen = v.isNotNull()
    aggs = [
        F.count(v).alias("value_count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.max_by(v, F.when(seen, F.struct(*(c(o) for o in order)))).alias("last"), F.sum(v).alias("sum"),
        F.stddev_pop(v).alias("stdev"), F.count_if(~seen).alias("filtered_count"),
    ]
    if x is not None:
        aggs += [F.avg(F.when(seen, c(x))).alias("mean_x"), F.avg(F.when(seen, c(y))).alias("mean_y")]
    return points.groupBy(*keys).agg(*aggs)


def weighted_statistics(points: DataFrame, value: Num, weight: Num, keys: list[str] = CELL) -> DataFrame:
    """Weighted mean and weight sum; rows without a positive weight don't count."""
    v, w = c(value), F.when(c(weight) > 0, c(weight))
    return points.groupBy(*keys).agg(weighted_mean(v, w).alias("mean"), F.sum(F.when(v.isNotNull(), w)).alias("weight_sum"), F.count(F.when(v.isNotNull(), w)).alias("value_count"))


def keep_last(points: DataFrame, value: Num, order: list[Num], keys: list[str] = CELL, factor: float = 1.0) -> DataFrame:
    """The last value of each cell in a total order, missing ones passed over."""
    v = c(value)
    return points.groupBy(*keys).agg((factor * F.max_by(v, F.when(v.isNotNull(), F.struct(*(c(o) for o in order))))).alias("last")).filter("last is not null")


def cell_deviation(points: DataFrame, value: Num, keys: list[str] = CELL) -> DataFrame:
    """Population deviation of each cell, in one pass (a pooled sum of squares); 0 for one value."""
    return points.groupBy(*keys).agg(F.stddev_pop(c(value)).alias("stdev"))


def cell_extremes(points: DataFrame, value: Num, keys: list[str] = CELL) -> DataFrame:
    """Least and greatest value of each cell; nulls don't count."""
    return points.groupBy(*keys).agg(F.min(c(value)).alias("min"), F.max(c(value)).alias("max"))


def last_label(points: DataFrame, label: Num, order: list[Num], keys: list[str] = CELL, name: str = "cdi") -> DataFrame:
    """The label of each cell's last point in a total order."""
    return points.groupBy(*keys).agg(F.max_by(c(label), F.struct(*(c(o) for o in order))).alias(name))


def axis_resolution(points: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """Least and median step between neighbouring distinct positions, by keys; null for one."""
    w = Window.partitionBy(*keys).orderBy(axis)
    steps = points.select(axis, *keys).distinct().withColumn("_d", F.nullif(F.col(axis) - F.lag(axis).over(w), F.lit(0.0)))
    return steps.groupBy(*keys).agg(F.min(F.abs("_d")).alias("least"), F.percentile("_d", F.lit(0.5)).alias("median"))


def nearest_cell(grid: DataFrame, row: float, col: float) -> DataFrame:
    """The cell nearest to a place in grid coordinates; of equals the first by row, then column.
    An aggregate with map-side minima; an empty grid gives one row of nulls."""
    d = F.pow(F.col("row") - row, F.lit(2.0)) + F.pow(F.col("col") - col, F.lit(2.0))
    best = grid.agg(F.min_by(F.struct(*grid.columns), F.struct(d, "row", "col")).alias("_k"))
    return best.select("_k.*")


def crop(grid: DataFrame, inside: Column) -> DataFrame:
    """The cells inside a mask, numbered from the corner of the smallest box that holds them.

    The box is one aggregated row; it is joined to every cell."""
    kept = grid.filter(inside)
    box = kept.agg(F.min("row").alias("_r0"), F.min("col").alias("_c0"))
    return kept.crossJoin(F.broadcast(box)).withColumns({"row": F.col("row") - F.col("_r0"), "col": F.col("col") - F.col("_c0")}).drop("_r0", "_c0")


def grid_points(points: DataFrame, spec, value: str, order: list[Num], how: str = "last") -> DataFrame:
    """Points (x, y) on the grid of a GridSpec: ``last`` value of each cell in a total order, or its
    ``mean``; points outside it and missing values don't count."""
    row, col = spec.cell("x", "y")
    p = points.withColumns({"row": row, "col": col}).filter(F.col("row").isNotNull() & F.col(value).isNotNull())
    v = F.max_by(value, F.struct(*(c(o) for o in order))) if how == "last" else F.avg(value)
    return p.groupBy(*CELL).agg(v.alias(value), F.count("*").alias("value_count"))


def extent(points: DataFrame, x: Num, y: Num, keys: list[str] = ()) -> DataFrame:
    """Bounding box, of all points or by keys."""
    return points.groupBy(*keys).agg(F.min(c(x)).alias("west"), F.max(c(x)).alias("east"), F.min(c(y)).alias("south"), F.max(c(y)).alias("north"))


# -- several grids ----------------------------------------------------------------------------


def stack(grids: list[DataFrame]) -> DataFrame:
    """Grids one under the other with their priority, 0 first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.withColumn("priority", F.lit(i)) for i, g in enumerate(grids)])


def merge_mean(stacked: DataFrame, layers: list[str], max_count: int = 100) -> DataFrame:
    """Plain mean of each layer over grids; null from ``max_count`` grids on."""
    mean = lambda k: F.when(F.count(k) < max_count, F.avg(k)).alias(k)
    return stacked.groupBy(*CELL).agg(*(mean(k) for k in layers))


def merge_layers(stacked: DataFrame) -> DataFrame:
    """Layers (stdev, min, max, value_count, flag) by the rule of each: root mean square, extremes,
    sum, any."""
    return stacked.groupBy(*CELL).agg(F.sqrt(F.avg(F.col("stdev") * F.col("stdev"))).alias("stdev"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("value_count").alias("value_count"), F.max("flag").alias("flag"))


def dominant(stacked: DataFrame, label: str = "cdi", count: str = "value_count", keys: list[str] = CELL, tie: str = "priority") -> DataFrame:
    """Label with the most values; later grids win ties."""
    return stacked.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.max_by(label, F.struct(count, tie)).alias(label))


def merge_fill(stacked: DataFrame, layers: list[str]) -> DataFrame:
    """First value present in priority order, layer by layer."""
    return stacked.groupBy(*CELL).agg(*(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("priority"))).alias(k) for k in layers))


def merge_by_slope(first: DataFrame, second: DataFrame, slope: DataFrame, layer: str, low: float, high: float, how: str = "blend", reference_blend: bool = False) -> DataFrame:
    """first below the slope band, second above, and inside it a blend, min, max or sum."""
    j = first.select(*CELL, F.col(layer).alias("a")).join(second.select(*CELL, F.col(layer).alias("b")), CELL, "full").join(slope.select(*CELL, "slope"), CELL, "left")
    f = (F.col("slope") - low) / (high - low)
    blend = f * F.col("a") + (1.0 - f) * F.col("b") if reference_blend else (1.0 - f) * F.col("a") + f * F.col("b")
    inside = {"blend": blend, "min": F.least("a", "b"), "max": F.greatest("a", "b"), "sum": F.col("a") + F.col("b")}[how]
    both = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("slope").isNotNull()
    v = F.when(~both, F.coalesce("a", "b")).when(F.col("slope") <= low, F.col("a")).when(F.col("slope") >= high, F.col("b")).otherwise(inside)
    return j.select(*CELL, v.alias(layer))


def difference(reference: DataFrame, other: DataFrame, layer: str) -> DataFrame:
    """reference minus other where both have a value."""
    j = reference.select(*CELL, F.col(layer).alias("a")).join(other.select(*CELL, F.col(layer).alias("b")), CELL)
    return j.select(*CELL, (F.col("a") - F.col("b")).alias(layer)).filter(F.col(layer).isNotNull())


# -- coarsening -------------------------------------------------------------------------------


def coarse(factor: int) -> list[Column]:
    return [F.floor(F.col(k) / factor).cast("int").alias(k) for k in CELL]


def reduce_grid(grid: DataFrame, factor: int) -> DataFrame:
    """Cells by factor x factor: count-weighted mean (weight 1 without a count), pooled deviation,
    sums, extremes, flag 0 if any is 0, label of the fullest cell (last wins ties)."""
    w = F.when(F.col("value_count") > 0, F.col("value_count").cast("double")).otherwise(1.0)
    return grid.groupBy(*coarse(factor)).agg(
        weighted_mean("mean", w).alias("mean"), F.sqrt(weighted_mean(F.col("stdev") * F.col("stdev"), w)).alias("stdev"),
        F.sum("value_count").alias("value_count"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("flag").alias("flag"),
        F.max_by("cdi", F.when(F.col("cdi").isNotNull(), F.struct("value_count", "row", "col"))).alias("cdi"),
    )


def block_mean(grid: DataFrame, layer: str, step: int, rows: int, cols: int) -> DataFrame:
    """Mean of each whole step x step block; what a division leaves over is trimmed."""
    whole = grid.filter((F.col("row") < rows // step * step) & (F.col("col") < cols // step * step))
    return whole.groupBy(*coarse(step)).agg(F.avg(layer).alias(layer))


# -- cell-wise rules --------------------------------------------------------------------------


def clamp_null(x: Num, lo: float, hi: float) -> Column:
    """Null outside [lo, hi], bounds in either order."""
    return F.when(c(x).between(min(lo, hi), max(lo, hi)), c(x))


def predicate(spec: dict) -> Column:
    """A condition from a tree: {"op": "and" | "or", "of": [...]} or {"layer", "op", "value"}.

    ``less`` and ``more`` include the bound."""
    if spec["op"] in ("and", "or"):
        parts = [predicate(s) for s in spec["of"]]
        return reduce((lambda a, b: a & b) if spec["op"] == "and" else (lambda a, b: a | b), parts)
    x, v = F.col(spec["layer"]), spec.get("value")
    ops = {
        "equal": lambda: x == v, "not equal": lambda: x != v, "less": lambda: x <= v, "more": lambda: x >= v,
        "between": lambda: x.between(*v), "missing": x.isNull, "not missing": x.isNotNull,
    }
    return F.coalesce(ops[spec["op"]](), F.lit(False))


def reset_where(grid: DataFrame, cond: Column, layers: list[str]) -> DataFrame:
    """Layers set to null where cond holds."""
    return grid.withColumns({k: F.when(~cond, F.col(k)) for k in layers})


def linear(grid: DataFrame, a: float, b: float) -> DataFrame:
    """a * x + b on elevations; extremes change places when a isn't positive; deviation scales."""
    lo, hi = ("min", "max") if a > 0 else ("max", "min")
    return grid.withColumns({"mean": F.col("mean") * a + b, "min": F.col(lo) * a + b, "max": F.col(hi) * a + b, "stdev": F.col("stdev") * abs(a)})


def default_layers(grid: DataFrame) -> DataFrame:
    """Missing layers from the elevation: extremes equal it, count 1, flag 0."""
    has = F.col("mean").isNotNull()
    rules = {"min": F.col("mean"), "max": F.col("mean"), "value_count": F.when(has, F.lit(1).cast("long")), "flag": F.when(has, F.lit(0))}
    return grid.withColumns({k: F.coalesce(F.col(k), v) if k in grid.columns else v for k, v in rules.items()})


def sanity(grid: DataFrame) -> DataFrame:
    """Layers follow the elevation: none without it; a flag only where there is a cell."""
    has = F.col("mean").isNotNull()
    out = grid.withColumns({k: F.when(has, F.col(k)) for k in ("min", "max", "stdev", "value_count", "cdi") if k in grid.columns})
    return out.withColumn("flag", F.when(has, F.coalesce(F.col("flag"), F.lit(0))))


def shrink(grid: DataFrame, layer: str = "mean") -> DataFrame:
    """Bounding box of the cells that have a value."""
    return grid.filter(F.col(layer).isNotNull()).agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


def fill_from(grid: DataFrame, new: DataFrame) -> DataFrame:
    """New elevations where there were none: flag 1, extremes equal, count 1."""
    j = grid.join(new.select(*CELL, F.col("mean").alias("_n")), CELL, "full")
    use = F.col("mean").isNull() & F.col("_n").isNotNull()
    pick = lambda k, v: F.when(use, v).otherwise(F.col(k)).alias(k)
    return j.select(*CELL, pick("mean", F.col("_n")), pick("min", F.col("_n")), pick("max", F.col("_n")), pick("value_count", F.lit(1).cast("long")), pick("flag", F.lit(1)))


# -- provenance -------------------------------------------------------------------------------


def compact_ids(used: DataFrame, names: DataFrame) -> DataFrame:
    """Dictionary (old_id, new_id, name) without unused entries and doubles.

    ``names`` is a dictionary, so ranking it in one task is bounded by its size."""
    from pyspark.sql import Window

    live = names.join(used.select("old_id").distinct(), "old_id", "left_semi")
    return live.withColumn("new_id", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1)


def provenance_gaps(grid: DataFrame) -> DataFrame:
    """Cells with an elevation and no label, and the reverse."""
    return grid.agg(F.count_if(F.col("mean").isNotNull() & F.col("cdi").isNull()).alias("undefined"), F.count_if(F.col("mean").isNull() & F.col("cdi").isNotNull()).alias("unused"))


def layer_statistics(cells: DataFrame, layer: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """Extremes, mean, median, sample deviation and the interval that holds ``level``."""
    q = (1 - level) / 2
    v = F.col(layer).cast("double")
    return cells.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(q)).alias("low"), F.percentile(v, F.lit(1 - q)).alias("high"), F.count(v).alias("n"),
    )


def sigma_levels(cells: DataFrame, layer: str, keys: list[str]) -> DataFrame:
    """Share of values within one and two deviations of the mean, bounds included."""
    base = cells.groupBy(*keys).agg(F.avg(layer).alias("_m"), F.stddev_samp(layer).alias("_s"))
    j = cells.join(F.broadcast(base) if not keys else base, keys) if keys else cells.crossJoin(F.broadcast(base))
    inside = lambda k: F.avg(F.col(layer).between(F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s")).cast("double"))
    return j.filter(F.col(layer).isNotNull()).groupBy(*keys).agg(inside(1).alias("one_sigma"), inside(2).alias("two_sigma"))


def histogram(cells: DataFrame, layer: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts by bin, the last bin closed."""
    from ..functions.acoustics import closed_bin

    return cells.select(closed_bin(layer, lo, hi, (hi - lo) / n).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
