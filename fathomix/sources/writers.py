"""Writers of the text formats; each gives the lines as a DataFrame and can write them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column orders of point text.
ORDERS = {"xyz": ("x", "y", "z"), "yxz": ("y", "x", "z"), "xzy": ("x", "z", "y"), "yzx": ("y", "z", "x"), "zxy": ("z", "x", "y"), "zyx": ("z", "y", "x")}


def xyz_lines(cells: DataFrame, order: str = "xyz", sep: str = " ", missing: str | None = None) -> DataFrame:
    """Text lines of cells (x, y, z): coordinates with 8 digits, depths with 2; cells without a
    depth are left out, or written as ``missing``."""
    c = cells if missing is not None else cells.filter("z is not null")
    form = {"x": F.format_string("%.8f", F.col("x").cast("double")), "y": F.format_string("%.8f", F.col("y").cast("double")), "z": F.coalesce(F.format_string("%.2f", F.when(F.col("z").isNotNull(), F.col("z").cast("double")).otherwise(0.0)), F.lit(""))}
    form["z"] = F.when(F.col("z").isNotNull(), form["z"]).otherwise(F.lit(missing or ""))
    return c.select(F.concat_ws(sep, *(form[k] for k in ORDERS[order])).alias("value"))


def emo_lines(cells: DataFrame) -> DataFrame:
    """Semicolon text grid; elevations become depths, so extremes change places."""
    num = lambda k, f, sign=1: F.when(F.col(k).isNotNull(), F.format_string(f, sign * F.col(k).cast("double"))).otherwise("")
    n = F.when(F.col("value_count").isNotNull(), F.col("value_count").cast("long").cast("string")).otherwise("")
    return cells.filter("mean is not null").select(F.concat_ws(";", num("x", "%.8f"), num("y", "%.8f"), num("max", "%.2f", -1), num("min", "%.2f", -1), num("mean", "%.2f", -1), num("stdev", "%.2f"), n, F.coalesce(F.col("flag").cast("string"), F.lit("")), F.lit(""), F.lit(""), F.coalesce("cdi", F.lit(""))).alias("value"))


def gxf_dummy(low: float, high: float) -> float:
    """Value for missing cells: 0 unless the range holds it, then a row of nines above it."""
    return 10.0 ** (math.floor(math.log10(high)) + 1) - 1 if low < 0 < high else 0.0


def gxf_rows(cells: DataFrame, layer: str, cols: int, dummy: float, digits: int = 2) -> DataFrame:
    """One text block per grid row, lines of at most 80 characters; one row of a grid is what a
    task holds."""

    def number(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")

    m = cells.filter(F.col(layer).isNotNull()).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col(layer).cast("double").alias("v")))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda i: number(F.coalesce(F.element_at("m", i.cast("int")), F.lit(float(dummy)))))
    wrap = lambda acc, w: F.when(F.length(F.element_at(F.split(acc, "\n"), -1)) + F.length(w) + 1 > 80, F.concat(acc, F.lit("\n"), w)).otherwise(F.concat(acc, F.when(acc == "", "").otherwise(" "), w))
    return m.select("row", F.aggregate(words, F.lit(""), wrap).alias("value"))


def geojson(points: DataFrame, properties: list[str]) -> DataFrame:
    """A feature per point (x, y)."""
    f = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    return points.select(F.to_json(f).alias("value"))


def tide_lines(tide: DataFrame) -> DataFrame:
    """ISO time and height, semicolons between; tide has t in microseconds."""
    iso = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return tide.select(F.concat_ws(";", iso, F.format_string("%.3f", F.col("tide").cast("double"))).alias("value"))


def layers(cells: DataFrame, path: str, by: list[str] = ()) -> None:
    """Cells as Parquet; by: partition columns, such as a label."""
    cells.write.mode("overwrite").partitionBy(*by).parquet(path)


def lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def history(spark, path: str, line: str) -> None:
    """Append a line to a lineage table."""
    spark.createDataFrame([(line,)], "line string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
