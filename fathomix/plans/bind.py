"""The measurement tables that operators take, bound to the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


ORDER = ["t", "ok", "ln", "p"]


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Point observations with their cell."""
    i = table(spark, sf, "lineitem")
    return i.select(
        F.floor(F.col("l_suppkey") / 10).cast("int").alias("row"), F.floor(F.col("l_partkey") / 50).cast("int").alias("col"),
        (-F.col("l_extendedprice") / 100).alias("z"), (-10 - 100 * F.col("l_discount")).alias("db"), F.col("l_quantity").alias("angle"),
        F.col("l_tax").alias("w"), F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("sector"), F.col("l_linenumber").alias("antenna"),
        F.col("l_shipdate").alias("t"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_extendedprice").alias("p"),
        F.col("l_partkey").alias("px"), F.col("l_suppkey").alias("sy"),
    )


DET = """det AS (SELECT CAST(floor(l_suppkey / 10) AS INTEGER) AS "row", CAST(floor(l_partkey / 50) AS INTEGER) AS col, -l_extendedprice / 100 AS z,
  -10 - 100 * l_discount AS db, l_quantity AS angle, l_tax AS w, l_returnflag AS mode, l_linestatus AS sector, l_linenumber AS antenna,
  l_shipdate AS t, l_orderkey AS ok, l_linenumber AS ln, l_extendedprice AS p, l_partkey AS px, l_suppkey AS sy FROM lineitem)"""


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """Three grids of one extent, one a mode, under one another; A before N before R."""
    d = detections(spark, sf)
    g = d.groupBy("mode", "row", "col").agg(F.avg("z").alias("mean"), F.min("z").alias("min"), F.max("z").alias("max"), F.stddev_pop("z").alias("stdev"), F.count("*").alias("value_count"), F.min((F.col("ln") == 1).cast("int")).alias("flag"))
    return g.withColumn("cdi", F.concat(F.lit("c"), (F.col("value_count") % 3).cast("string"))).withColumn("priority", F.when(F.col("mode") == "A", 0).when(F.col("mode") == "N", 1).otherwise(2))


GRIDS = DET + """, grids AS (SELECT *, 'c' || CAST(value_count % 3 AS VARCHAR) AS cdi, CASE mode WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS priority FROM (
  SELECT mode, "row", col, avg(z) AS mean, min(z) AS min, max(z) AS max, stddev_pop(z) AS stdev, count(*) AS value_count,
  min(CASE WHEN ln = 1 THEN 1 ELSE 0 END) AS flag FROM det GROUP BY ALL))"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """One grid of all observations."""
    d = detections(spark, sf)
    g = d.groupBy("row", "col").agg(F.avg("z").alias("mean"), F.min("z").alias("min"), F.max("z").alias("max"), F.stddev_pop("z").alias("stdev"), F.count("*").alias("value_count"), F.min((F.col("ln") == 1).cast("int")).alias("flag"))
    return g.withColumn("cdi", F.concat(F.lit("c"), (F.col("value_count") % 3).cast("string")))


GRID = GRIDS + """, grid AS (SELECT *, 'c' || CAST(value_count % 3 AS VARCHAR) AS cdi FROM (SELECT "row", col, avg(z) AS mean, min(z) AS min, max(z) AS max, stddev_pop(z) AS stdev,
  count(*) AS value_count, min(CASE WHEN ln = 1 THEN 1 ELSE 0 END) AS flag FROM det GROUP BY ALL))"""


def pings(spark: SparkSession, sf: str) -> DataFrame:
    """A time series: t in microseconds, file, kind, value."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("file"), F.col("event_type").alias("kind"), "value")


PINGS = "pings AS (SELECT event_id, epoch_us(ts) AS t, user_id AS file, event_type AS kind, value FROM events)"


def track(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation: a position for each ping."""
    p = pings(spark, sf)
    return p.select("*", (F.col("event_id") % 360 - 180 + F.col("value") / 1000).alias("lon"), (F.col("event_id") % 120 - 60 + F.col("value") / 500).alias("lat"), (F.col("event_id") * 47 % 360).cast("double").alias("heading"))


TRACK = PINGS + ", track AS (SELECT *, event_id % 360 - 180 + value / 1000 AS lon, event_id % 120 - 60 + value / 500 AS lat, CAST(event_id * 47 % 360 AS DOUBLE) AS heading FROM pings)"


def r(*names: str, digits: int = 4) -> list:
    """Columns rounded for comparison."""
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def rs(*names: str, digits: int = 4) -> str:
    """The same in SQL."""
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)
