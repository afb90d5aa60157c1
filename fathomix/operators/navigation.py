"""Navigation: several files, positions at other times, gaps, alignment of two recordings.

Defined cases: rows with a null time sort first and meet nothing; equal times of one key are
interpolated to the first of them; a key that only one side has gives nulls; an empty side gives
nulls (or no inserted rows); columns whose names begin with an underscore are in the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .records import together
from .temporal import first_per, interpolating, unwrap


def from_files(parts: list[DataFrame], keys: list[str], t: str = "t") -> DataFrame:
    """Positions of several files as one navigation, in time; of equal times of a key the one with
    the smallest row stays."""
    u = together(parts)
    order = [t, *(k for k in u.columns if k not in (t, *keys))]
    return first_per(u, [*keys, t], order).orderBy(*keys, t)


def from_arrays(spark, name: str, **columns: list) -> DataFrame:
    """Arrays of one length as a navigation table of that name; they come from the driver."""
    kinds = {"t": "long"}
    schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in columns)
    return spark.createDataFrame(list(zip(*columns.values())), schema).withColumn("name", F.lit(name))


def at_times(times: DataFrame, nav: DataFrame, keys: list[str], t: str, values: list[str], heading: str | None = None, outside: str = "null") -> DataFrame:
    """times with the navigation's values interpolated at them; a heading goes the short way round
    and ends in [0, 360).  ``outside`` its span: "null", "clamp", or "error"."""
    out, edge = times, "null" if outside == "error" else outside
    for v in values:
        out = interpolating(out, nav, keys, t, v, edge)
    if heading:
        own = unwrap(nav.select(*keys, t, heading), keys, t, heading).select(*keys, t, F.col("unwrapped").alias(heading))
        out = interpolating(out, own, keys, t, heading, edge).withColumn(heading, F.pmod(heading, F.lit(360.0)))
    if outside == "error":
        first = F.col((values or [heading])[0])
        out = out.withColumn((values or [heading])[0], F.when(first.isNull(), F.raise_error(F.lit("a time outside the navigation"))).otherwise(first))
    return out


def _around(rows: DataFrame, marks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """rows with the times of marks at or before (_before) and at or after (_after) their own."""
    u = rows.withColumns({"_mark": F.lit(None).cast("long"), "_side": F.lit(1)})
    u = u.unionByName(marks.select(*keys, t, F.col(t).cast("long").alias("_mark"), F.lit(0).alias("_side")), allowMissingColumns=True)
    up = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col(t).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({"_before": F.last("_mark", ignorenulls=True).over(up), "_after": F.last("_mark", ignorenulls=True).over(down)})
    return u.filter("_side = 1").drop("_mark", "_side")


def fill_gaps(first: DataFrame, second: DataFrame, keys: list[str], t: str, longest: int) -> DataFrame:
    """first with the rows of second that lie inside its gaps longer than ``longest``, in time."""
    inside = _around(second, first, keys, t).filter((F.col("_after") - F.col("_before") > longest) & (F.col(t) > F.col("_before")) & (F.col(t) < F.col("_after")))
    return first.unionByName(inside.select(*first.columns))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, name: str = "match_t") -> DataFrame:
    """left with the nearest time of right within the tolerance, of equals the earlier; else null."""
    a = _around(left, right, keys, t)
    before = F.when(F.col(t) - F.col("_before") <= tolerance, F.col("_before"))
    after = F.when(F.col("_after") - F.col(t) <= tolerance, F.col("_after"))
    near = F.when(after.isNull() | (F.col(t) - before <= after - F.col(t)), before).otherwise(after)
    return a.withColumn(name, F.coalesce(near, after)).drop("_before", "_after")


def nearest_column(points: DataFrame, columns: DataFrame, around: Column, reach: int, key: list[str]) -> DataFrame:
    """Each point's nearest reference column (x_idx, lon, lat) in squared degrees, among those within
    ``reach`` of the index ``around``; of equals the smaller index; -1 if there is none.

    The window is a fixed number of indices, so this is an equi-join on the index."""
    near = points.withColumn("_i", F.explode(F.sequence(around - reach, around + reach)))
    c = columns.select(F.col("x_idx").alias("_i"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    d = F.pow(F.col("lon") - F.col("_lon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("_lat"), F.lit(2.0))
    best = near.join(c, "_i").groupBy(*key).agg(F.min_by("_i", F.struct(d, "_i")).alias("_best"))
    return points.select(*key).join(best, key, "left").select(*key, F.coalesce("_best", F.lit(-1)).cast("long").alias("x_idx"))


def closest_per_time(matches: DataFrame, path: list[str], t: str, distance: str, order: list[str], least: int) -> DataFrame:
    """Of points matched to a navigation the closest per path and time; paths with fewer than
    ``least`` such points are dropped."""
    one = first_per(matches, [*path, t], [distance, *order])
    return one.withColumn("_n", F.count("*").over(Window.partitionBy(*path))).filter(F.col("_n") >= least).drop("_n")


def lines_csv(nav: DataFrame, columns: dict[str, str], sep: str = ";") -> DataFrame:
    """Navigation as text lines: each column by its printf format, missing values empty."""
    return nav.select(F.concat_ws(sep, *(F.when(F.col(k).isNull(), "").otherwise(F.format_string(f, F.col(k))) for k, f in columns.items())).alias("value"))


def track_length(nav: DataFrame, keys: list[str], t: str, lon: str, lat: str) -> DataFrame:
    """Section arguments of each track: points, great-circle length, mean step."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = nav.withColumn("_d", haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"), F.avg("_d").alias("step"))
