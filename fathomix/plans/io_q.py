"""Queries on text formats: what is written, and what reading it again gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import records as rc
from ..sources import readers, writers
from .bind import DET, GRID, PINGS, detections, grid, pings, table
from .registry import query
from .tables import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/fathomix/{name}-{uuid.uuid4().hex}"


@query("k03_xyz_lines", f"""WITH {GRID} SELECT format('{{:.8f}} {{:.8f}} {{:.2f}}', "row" * 1.0, col * 0.5, floor(min) / 4) AS value FROM grid""")
def k03(spark, sf):
    return writers.xyz_lines(grid(spark, sf).select((F.col("col") * 0.5).alias("x"), (F.col("row") * 1.0).alias("y"), (F.floor("min") / 4).alias("z")), "yxz")


@query("s14_s17_xyz_round_trip", f"""WITH {GRID} SELECT col * 0.5 AS lon, CAST("row" AS DOUBLE) AS lat, floor(min) / 4 AS elevation FROM grid""")
def s17(spark, sf):
    path = _folder(spark, "xyz")
    writers.lines(writers.xyz_lines(grid(spark, sf).select((F.col("col") * 0.5).alias("x"), F.col("row").alias("y"), (F.floor("min") / 4).alias("z"))), path)
    return readers.xyz(spark, path).select("lon", "lat", "elevation")


@query("k04_s16_emo_round_trip", f"""WITH {GRID} SELECT CAST(col AS DOUBLE) AS lon, CAST("row" AS DOUBLE) AS lat, floor(min) / 4 AS min, floor(max) / 4 AS max, CAST(value_count AS DOUBLE) AS value_count, cdi FROM grid""")
def k04(spark, sf):
    path = _folder(spark, "emo")
    writers.lines(writers.emo_lines(grid(spark, sf).withColumns({"x": F.col("col"), "y": F.col("row"), "min": F.floor("min") / 4, "max": F.floor("max") / 4})), path)
    return readers.emo(spark, path).select("lon", "lat", "min", "max", "value_count", "cdi")


@query("k05_gxf_rows")
def k05(spark, sf):
    return writers.gxf_rows(grid(spark, sf), "min", 41, writers.gxf_dummy(-1100.0, -1.0))


@query("k20_tide_lines", f"""WITH {PINGS} SELECT strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(t // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z;' || format('{{:.3f}}', CAST(event_id % 100 AS DOUBLE)) AS value FROM pings""")
def k20(spark, sf):
    return writers.tide_lines(pings(spark, sf).select("t", (F.col("event_id") % 100).alias("tide")))


@query("k23_k24_geojson", """SELECT '{"type":"Feature","properties":{"s_suppkey":' || s_suppkey || '},"geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']}}' AS value FROM supplier""")
def k23(spark, sf):
    return writers.geojson(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("x"), F.col("s_nationkey").cast("long").alias("y"), "s_suppkey"), ["s_suppkey"])


@query("k01_a28_partitioned_layers", f"""WITH {GRID} SELECT cdi, count(*) AS cells FROM grid GROUP BY ALL""")
def k01(spark, sf):
    path = _folder(spark, "layers")
    writers.layers(grid(spark, sf), path, ["cdi"])
    return spark.read.parquet(path).groupBy("cdi").agg(F.count("*").alias("cells"))


@query("s05_valid_soundings", f"WITH {DET} SELECT mode, count(*) AS n FROM det WHERE antenna % 3 = 0 GROUP BY ALL")
def s05(spark, sf):
    d = detections(spark, sf).withColumn("status", F.col("antenna") % 3)
    return readers.valid(d).groupBy("mode").agg(F.count("*").alias("n"))


@query("s11_profile_points", """SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS speed FROM embeddings, range(0, 64) r(i)""")
def s11(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.col("vec_id").alias("profile_time_ns"), F.col("embedding").alias("speed"), F.transform("embedding", lambda v, i: i.cast("double")).alias("depth"))
    return readers.svp_points(e).select(F.col("profile_time_ns").alias("vec_id"), F.col("i").cast("long").alias("i"), F.col("speed").cast("double").alias("speed"))


@query("s12_preferred_sensor", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey) AS k FROM customer) WHERE k = 1""")
def s12(spark, sf):
    c = table(spark, sf, "customer").withColumn("is_preferred", F.col("c_mktsegment") == "BUILDING")
    return readers.preferred(c, ["c_nationkey"], ["c_custkey"]).select("c_nationkey", "c_custkey")


@query("s43_bounds_per_file", f"WITH {DET} SELECT mode AS file, min(px) AS west, max(px) AS east, min(sy) AS south, max(sy) AS north, count(*) AS n FROM det GROUP BY ALL")
def s43(spark, sf):
    return rc.bounds(detections(spark, sf).withColumnRenamed("mode", "file"), {"px": "west east", "sy": "south north"}, ["file"])


@query("p28_p29_status_flags", f"WITH {DET} SELECT ok, ln, p, antenna % 4 | CASE WHEN angle > 40 THEN 2 ELSE 0 END AS status, CASE WHEN angle > 40 THEN 1 ELSE 0 END AS detail FROM det")
def p28(spark, sf):
    d = rc.translate_status(detections(spark, sf).withColumn("status", F.col("antenna") % 4), {1: 1, 2: 2, 3: 3})
    return rc.reject(d, F.col("angle") > 40).select("ok", "ln", "p", "status", "detail")
