"""Streaming queries over the events, run to completion into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import streams
from .bind import PINGS, table
from .registry import query
from .tables import shared_folder



def _stream(spark, sf):
    """Events as a stream, with a last row far ahead that closes all windows."""
    base = f"{shared_folder(spark)}/fathomix/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("file"), F.col("event_type").alias("mode"), "value", (F.col("event_id") % 5).cast("int").alias("row"), (F.col("event_id") % 7).cast("int").alias("col"), (F.col("event_id") % 3).cast("int").alias("bin"))
    e.write.parquet(f"{base}/in")
    end = e.select((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("file"), F.lit("end").alias("mode"), F.lit(0.0).alias("value"), F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.lit(-1).alias("bin"))
    end.write.mode("append").parquet(f"{base}/in")
    return streams.read(spark, f"{base}/in", e.schema), base


def _done(spark, stream, base):
    streams.run(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("t01_t04_tumbling_grid", f"""WITH {PINGS} SELECT t // 86400000000 AS day, CAST(event_id % 5 AS INTEGER) AS "row", CAST(event_id % 7 AS INTEGER) AS col, count(value) AS n, round(avg(value), 4) AS mean FROM pings GROUP BY ALL""")
def t01(spark, sf):
    s, base = _stream(spark, sf)
    out = _done(spark, streams.gridding(s, "ts", "value", "1 day", "40 days"), base)
    return out.filter("row >= 0").select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "row", "col", "n", F.round("mean", 4).alias("mean"))


@query("t02_sliding_curve", f"""WITH {PINGS}, x AS (SELECT *, unnest([0, 1]) AS k FROM pings) SELECT t // 43200000000 - k AS half_day, kind AS mode, CAST(event_id % 3 AS INTEGER) AS bin, round(10 * log10(avg(power(10, value / 100))), 4) AS mean_db, count(*) AS n FROM x GROUP BY ALL""")
def t02(spark, sf):
    s, base = _stream(spark, sf)
    out = _done(spark, streams.sliding_curve(s.withColumn("level", F.col("value") / 10), "ts", "level", "1 day", "12 hours", "40 days"), base)
    return out.filter("bin >= 0").select(F.floor(F.unix_micros("start") / 43_200_000_000).alias("half_day"), "mode", "bin", F.round("mean_db", 4).alias("mean_db"), "n")


@query("t03_session_lines", f"""WITH {PINGS}, d AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY file ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS b FROM pings), s AS (SELECT *, sum(b) OVER (PARTITION BY file ORDER BY t) AS k FROM d)
SELECT file, min(t) AS start, max(t) + 21600000000 AS stop, count(*) AS n FROM s GROUP BY file, k""")
def t03(spark, sf):
    s, base = _stream(spark, sf)
    out = _done(spark, streams.sessions(s, "ts", "6 hours", "40 days"), base)
    return out.filter("file >= 0").select("file", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query("t05_state_keep_last", f"""WITH {PINGS} SELECT CAST(event_id % 5 AS INTEGER) AS "row", CAST(event_id % 7 AS INTEGER) AS col, last(value ORDER BY t) AS last, round(avg(value), 4) AS mean, count(*) AS n FROM pings GROUP BY ALL""")
def t05(spark, sf):
    s, base = _stream(spark, sf)
    streams.run(streams.keep_last(s, "ts", "value"), f"{base}/out", f"{base}/state", "update")
    out = spark.read.parquet(f"{base}/out").filter("row >= 0")
    top = out.groupBy("row", "col").agg(F.max_by(F.struct("last", "mean", "n"), "batch").alias("s"))
    return top.select("row", "col", "s.last", F.round("s.mean", 4).alias("mean"), "s.n")
