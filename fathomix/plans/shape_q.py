"""Queries on shapefiles: navigation and markers written by all tasks and read by record ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import shapes
from .bind import TRACK, track
from .io_q import _folder
from .registry import query


def _vertex(x, y, z):
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))


@query("s24_k15_point_shapes", f"""WITH {TRACK} SELECT event_id AS id, epoch_us(date_trunc('second', make_timestamp(t))) AS t, lon, lat, floor(value) AS z, heading, -floor(value) AS vertical_offset, kind FROM track""")
def k15(spark, sf):
    """Markers with a height, their attributes in the table; navigation read back from them."""
    path = _folder(spark, "points")
    at = F.timestamp_micros("t")
    marks = track(spark, sf).withColumn("depth", F.floor("value").cast("double")).select(
        F.array(F.array(_vertex("lon", "lat", "depth"))).alias("parts"), F.col("event_id").cast("bigint").alias("ID"), F.date_format(at, "dd/MM/yyyy").alias("DATE"), F.date_format(at, "HH:mm:ss").alias("HEURE"),
        F.col("heading").alias("CAP"), F.col("depth").alias("IMMERSION"), F.col("kind").alias("KIND"),
    )
    shapes.write(marks, shapes.POINT_Z, path).write.format("noop").mode("overwrite").save()
    nav = shapes.navigation(shapes.read(spark, path), ("z", "ID", "KIND"))  # in one pass: a join of the files with themselves would be broadcast by the index's size
    return nav.select(F.col("ID").alias("id"), "t", "lon", "lat", "z", "heading", "vertical_offset", F.col("KIND").alias("kind"))


@query("s24_k14_line_shapes", f"""WITH {TRACK}, m AS (SELECT *, t // 86400000000 AS day, row_number() OVER (PARTITION BY file, t // 86400000000 ORDER BY t, event_id) - 1 AS k FROM track),
l AS (SELECT file, day, k // 512 AS chunk, count(*) AS n FROM m GROUP BY ALL)
SELECT m.file, m.day, chunk, CAST((k % 512) // 4 AS INTEGER) AS part, CAST((k % 512) % 4 AS INTEGER) AS vertex, lon, lat, m.day * 86400000000 AS t, n FROM m JOIN l ON m.file = l.file AND m.day = l.day AND m.k // 512 = l.chunk""")
def k14(spark, sf):
    """Lines by file and day, of at most 512 vertices in parts of four, and their vertices read back."""
    path = _folder(spark, "lines")
    day = F.floor(F.col("t") / 86_400_000_000)
    k = F.row_number().over(Window.partitionBy("file", "day").orderBy("t", "event_id")) - 1
    m = track(spark, sf).withColumn("day", day).withColumn("k", k).withColumn("z", F.lit(0.0))
    rows = F.array_sort(F.collect_list(F.struct("k", _vertex("lon", "lat", "z").alias("v"))))
    line = m.groupBy("file", "day", F.floor(F.col("k") / 512).alias("chunk")).agg(F.transform(rows, lambda r: r["v"]).alias("v"), F.count("*").alias("n"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 4).cast("int")), lambda i: F.slice("v", i * 4 + 1, 4))
    date = F.date_format(F.timestamp_micros(F.col("day") * 86_400_000_000), "dd/MM/yyyy")
    features = line.select(parts.alias("parts"), F.col("file").cast("bigint").alias("NAME"), F.col("day").cast("bigint").alias("DAY"), F.col("chunk").cast("bigint").alias("CHUNK"), date.alias("DATE"), F.lit("00:00:00").alias("TIME"), F.col("n").alias("N"))
    shapes.write(features, shapes.LINE, path).write.format("noop").mode("overwrite").save()
    found = shapes.read(spark, path, [("NAME", "long"), ("DAY", "long"), ("CHUNK", "long"), ("DATE", "string"), ("TIME", "string"), ("N", "long")])
    nav = shapes.navigation(found, ("NAME", "DAY", "CHUNK", "N")).drop("file")
    return nav.select(F.col("NAME").alias("file"), F.col("DAY").alias("day"), F.col("CHUNK").alias("chunk"), "part", "vertex", "lon", "lat", "t", F.col("N").alias("n"))
