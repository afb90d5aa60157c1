"""What several training-data operators share: shared storage, range edges, word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_folder(spark)}/fathomix/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends here and
    lost executors cost nothing that was done before."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_once(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for operators of many rounds: the shuffles that made the table go when it is
    written, instead of when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing will read again: what was made from it must be
    a written table."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/fathomix/" not in folder:
            raise ValueError(f"{folder} isn't an intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a folder URI; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lower the session's bound of an Arrow batch to ``most`` bytes, unless it is lower already.

    Operators that send whole texts to Python call this: a batch is held by the executor and by
    the worker, by each of them more than once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    value = int(now.rstrip("kmg")) << unit
    if value <= 0 or value > most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    """Tasks after a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def range_edges(df: DataFrame, keys: list[str], buckets: int) -> list[tuple[tuple, tuple]]:
    """Smallest and largest key of about ``buckets`` disjoint, even ranges of a total order.

    Reads only the key columns.  The driver gets one row per range, never one per document.
    Nulls sort first.  Equal keys stay in one range.
    """
    key = F.struct(*keys)
    rows = (
        df.select(*keys)
        .repartitionByRange(buckets, *keys)
        .groupBy(F.spark_partition_id().alias("_p"))
        .agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        .orderBy("_p")
        .collect()
    )
    return [(tuple(r["lo"]), tuple(r["hi"])) for r in rows]


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than are needed to say so."""
    return df.limit(max_rows + 1).count() <= max_rows


def hint_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within max_rows, else df as it is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches; memory that Arrow has freed goes back after each, the rest when the task ends.
    Workers live on, so what one stage keeps is missing in the next."""
    pool = pa.default_memory_pool()
    for b in batches:
        yield b
        del b
        pool.release_unused()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_caches: dict[str, tuple[dict, ...]] = {}
_owner = ""


def claim(name: str, *caches: dict) -> None:
    """Let one operator's word caches stay in this worker and empty the others'.

    Workers live on from stage to stage; without this their caches would add up."""
    global _owner
    if _owner == name:
        return
    _owner, _caches[name] = name, caches
    for other, held in _caches.items():
        if other != name:
            for c in held:
                c.clear()
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)  # give freed pages back


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
