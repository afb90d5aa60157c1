"""Structured Streaming counterparts of the batch operators.

Each takes a streaming (or batch) DataFrame with an event time and returns a DataFrame; start it
with ``run`` or any writeStream.  Watermarks bound the state; rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.acoustics import mean_db


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gridding(points: DataFrame, time: str, value: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Cell statistics by tumbling window."""
    g = points.withWatermark(time, late).groupBy(F.window(time, width), "row", "col")
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), "row", "col", "n", "mean", "min", "max")


def sliding_curve(beams: DataFrame, time: str, level: str, width: str = "60 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Angular curve by sliding window, which trails the centred batch window by half its width."""
    g = beams.withWatermark(time, late).groupBy(F.window(time, width, slide), "mode", "bin")
    return g.agg(mean_db(level).alias("mean_db"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "mode", "bin", "mean_db", "n")


def sessions(points: DataFrame, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of each file, cut where nothing comes for ``gap``."""
    g = points.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "file")
    return g.agg(F.count("*").alias("n")).select("file", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def keep_last(points: DataFrame, time: str, value: str) -> DataFrame:
    """Last value and running mean of each cell, kept as state between batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, total, n = state.get if state.exists else (0, 0.0, 0.0, 0)
        for p in batches:
            p = p.dropna(subset=[value]).sort_values([time, value])
            if len(p):
                t = int(pd.Timestamp(p[time].iloc[-1]).value // 1000)
                if t >= at:
                    at, last = t, float(p[value].iloc[-1])
                total, n = total + float(p[value].sum()), n + len(p)
        state.update((at, last, total, n))
        if n:
            yield pd.DataFrame({"row": [key[0]], "col": [key[1]], "last": [last], "mean": [total / n], "n": [n]})

    out, held = "row int, col int, last double, mean double, n long", "at long, last double, total double, n long"
    return points.select("row", "col", time, value).groupBy("row", "col").applyInPandasWithState(update, out, held, "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Rows and state sizes of each batch, passed to a function."""

    def __init__(self, tell) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell({"batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop: results as Parquet, exactly once."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        save = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch:06d}")
        stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
