"""Readers of the text and table formats, all with declared schemas."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import shapes
from .netcdf3 import read_variables
from .rasters import read_raster

# Schemas of the logical inputs.
DETECTION = """file STRING, ping INT, beam INT, ping_time_ns BIGINT, lon DOUBLE, lat DOUBLE, x_along FLOAT, y_across FLOAT, z FLOAT, backscatter_db FLOAT,
status TINYINT, status_detail TINYINT, tx_beam INT, rx_transducer INT, beam_angle FLOAT, quality_factor FLOAT"""
PING = "file STRING, ping INT, ping_time_ns BIGINT, lon DOUBLE, lat DOUBLE, heading FLOAT, vertical_offset FLOAT, waterline_to_datum FLOAT, tx_depth FLOAT, sound_speed FLOAT"
CELL = """row INT, col INT, elevation FLOAT, elevation_smoothed FLOAT, elevation_min FLOAT, elevation_max FLOAT, stdev FLOAT, value_count INT, filtered_sounding INT,
interpolation_flag TINYINT, cdi_index INT, backscatter FLOAT, min_across_distance FLOAT, max_across_distance FLOAT, max_across_angle FLOAT"""
NAV = "name STRING, time_ns BIGINT, lat DOUBLE, lon DOUBLE, heading FLOAT, altitude FLOAT, vertical_offset FLOAT, speed FLOAT, cog FLOAT, quality INT"
# Dimensions and layers of the older sounding format.
MBG_DIMENSIONS, MBG_VARIABLES = ["mbCycleNbr", "mbBeamNbr"], ["mbAlongDistance", "mbAcrossDistance", "mbDepth", "mbSFlag"]
# Missing markers of stored layers.
MISSING = {"int": -1, "tinyint": 127, "string": ""}


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN, -1, 127 and the empty string become null, by column type."""
    fix = {}
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            fix[name] = F.nanvl(F.col(name), F.lit(None).cast(kind))
        elif kind in MISSING:
            fix[name] = F.nullif(F.col(name), F.lit(MISSING[kind]).cast(kind))
    return df.withColumns(fix) if fix else df


def parquet_reader(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: missing_to_null(spark.read.schema(schema).parquet(path))


def _needs(package: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError(f"{path}: this format needs {package}, which isn't installed; convert it to a Parquet table of the same schema")

    return read


#: Readers by extension; register() adds more.
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".detections": parquet_reader(DETECTION), ".pings": parquet_reader(PING), ".cells": parquet_reader(CELL), ".nav": parquet_reader(NAV),
    ".mbg": lambda spark, path: read_variables(spark, path, MBG_DIMENSIONS, MBG_VARIABLES), ".shp": shapes.read, ".tif": read_raster, ".tiff": read_raster,
    ".nc": _needs("HDF5"), ".xsf": _needs("HDF5"), ".dtm": _needs("HDF5"),
}


def register(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    REGISTRY[extension] = reader


def read(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in REGISTRY:
        raise ValueError(f"no reader for {ext or path}")
    return REGISTRY[ext](spark, path)


def valid(df: DataFrame) -> DataFrame:
    """Detections whose status is 0."""
    return df.filter("status = 0")


def soundings_csv(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ";", decimal: str = ".", skip: int = 0, depth_sign: float = 1.0) -> DataFrame:
    """Delimited soundings by position: columns maps names to field numbers; sep None splits at
    white space.  Lines are read as text, so field counts may differ; bad numbers are null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    if skip:
        head = lines.withColumn("_n", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")))
        lines = head.filter((F.col("_b") > 0) | (F.col("_n") > skip))
    parts = F.split(F.trim("value"), r"\s+") if sep is None else F.split("value", re.escape(sep))

    def number(i: int) -> Column:
        raw = F.trim(F.get(parts, F.lit(i)))
        return (F.replace(raw, F.lit(","), F.lit(".")) if decimal == "," else raw).try_cast("double")

    out = lines.filter(F.trim("value") != "").select(*(number(i).alias(k) for k, i in columns.items()), F.col("_i").alias("seq"))
    return out.withColumn("elevation", F.col("elevation") * depth_sign) if depth_sign != 1.0 and "elevation" in columns else out


# Fields of the two text grid formats.
XYZ_FIELDS = ("lon", "lat", "elevation")
EMO_FIELDS = ("lon", "lat", "min", "max", "mean", "stdev", "value_count", "flag", "smoothed", "smooth_gap", "cdi")


def xyz(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return soundings_csv(spark, path, {k: i for i, k in enumerate(XYZ_FIELDS)}, sep)


def emo(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon text grid; depths are positive down there, elevations up here."""
    p = F.split("value", ";")
    num = lambda i: F.trim(F.get(p, F.lit(i))).try_cast("double")
    out = spark.read.text(path).filter(F.trim("value") != "").select(*(num(i).alias(k) for i, k in enumerate(EMO_FIELDS[:-1])), F.nullif(F.trim(F.get(p, F.lit(10))), F.lit("")).alias("cdi"))
    return out.withColumns({k: -F.col(k) for k in ("mean", "smoothed")} | {"min": -F.col("max"), "max": -F.col("min")})


def nmea(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """talker, sentence and fields of valid lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line").rlike(r"^[$!]\w{5}"))
    lines = lines.filter(text.nmea_valid("line")) if check else lines
    return lines.select("line", text.nmea_fields("line").alias("n")).select("line", "n.*")


def gga(sentences: DataFrame) -> DataFrame:
    """Positions and ellipsoidal heights; a short sentence has height 0, a blank separation counts 0."""
    f = lambda i: F.get(F.col("fields"), F.lit(i))
    h = F.coalesce(text.to_float(f(8)), F.lit(0.0)) + F.coalesce(text.to_float(f(10)), F.lit(0.0))
    return sentences.filter("sentence = 'GGA'").select(f(0).alias("utc"), text.nmea_degrees(f(1), f(2)).alias("lat"), text.nmea_degrees(f(3), f(4)).alias("lon"), F.when(F.size("fields") > 10, h).otherwise(0.0).alias("height"))


def usbl(spark: SparkSession, path: str, mark: str = "PSIMSSB") -> DataFrame:
    """Acoustic positions of a transponder log."""
    p = F.split("value", ",")
    return spark.read.text(path).filter(F.col("value").contains(mark)).select(F.get(p, F.lit(1)).alias("utc"), F.get(p, F.lit(2)).alias("beacon"), *(F.get(p, F.lit(i)).try_cast("double").alias(k) for i, k in ((8, "x"), (9, "y"), (10, "z"))))


def cut_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines "start stop name" with dates as dd/mm/yyyy hh:mm:ss.fff; comments start with > or #."""
    pat = r"^>?\s*(?:[A-Z]+\s+)?(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S.*)$"
    t = lambda k: F.try_to_timestamp(F.regexp_replace(F.regexp_extract("value", pat, k), r"\.\d+$", ""), F.lit("dd/MM/yyyy HH:mm:ss"))
    return spark.read.text(path).filter(F.col("value").rlike(pat)).select(F.trim(F.regexp_extract("value", pat, 3)).alias("name"), t(1).alias("start"), t(2).alias("stop"))


def kml_rings(document: str) -> list[tuple[str, list[tuple[float, float]]]]:
    """(name, outer ring) of every polygon of a KML document.  Masks are small; driver-side."""
    strip = lambda tag: tag.rpartition("}")[2]
    out = []
    for mark in (e for e in ET.fromstring(document).iter() if strip(e.tag) == "Placemark"):
        name = next((e.text or "" for e in mark.iter() if strip(e.tag) == "name"), "")
        for outer in (e for e in mark.iter() if strip(e.tag) == "outerBoundaryIs"):
            for c in (e for e in outer.iter() if strip(e.tag) == "coordinates"):
                out.append((name, [tuple(float(v) for v in p.split(",")[:2]) for p in (c.text or "").split()]))
    return out


def polygons(spark: SparkSession, rings: list) -> DataFrame:
    return spark.createDataFrame(rings, "id string, ring array<struct<x double, y double>>")


def mapped_binary(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Files of fixed-width records: fields are (name, NumPy type)."""
    kind = np.dtype(fields)
    sql = {"f": "double", "i": "long", "u": "long"}
    schema = ", ".join(f"{n} {sql[kind[n].kind]}" for n, _ in fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                a = np.frombuffer(blob, kind, len(blob) // kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(a[n].astype("f8" if kind[n].kind == "f" else "i8")) for n, _ in fields], names=[n for n, _ in fields])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def response_text(lines: list[str], sign: float, add_source: bool) -> list[tuple[int, int, int, float, float]]:
    """Rows (mode, swath, sector, angle, level) of a sounder's text model: per mode a line
    "mode swath sectors"; per sector an optional source level, a count, and as many pairs."""
    words, out, at = [w for x in lines for w in x.split("#")[0].split()], [], 0

    def take() -> float:
        nonlocal at
        at += 1
        return float(words[at - 1])

    while at < len(words):
        mode, swath, sectors = int(take()), int(take()), int(take())
        for s in range(sectors):
            source = take() if add_source else 0.0
            for _ in range(int(take())):
                angle, level = take(), take()
                out.append((mode, swath, s, angle, sign * level + source))
    return out


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ";", required: list[str] = ()) -> DataFrame:
    """A table with a header and a declared schema; unreadable rows are kept in _corrupt."""
    df = spark.read.schema(f"{schema}, _corrupt STRING").csv(path, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return df


def files(spark: SparkSession, folder: str, pattern: str = "*", recurse: bool = True) -> DataFrame:
    """Paths and sizes below a folder."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recurse).lower())
    return r.load(folder).select("path", "modificationTime", "length")


def preferred(groups: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The sensor marked as preferred, else the first."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col("is_preferred"), F.lit(False)).desc(), *order)
    return groups.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def svp_points(profiles: DataFrame) -> DataFrame:
    """Sound-speed profiles, one row per depth."""
    return profiles.select("file", "profile_time_ns", F.posexplode(F.arrays_zip("depth", "speed")).alias("i", "p")).select("file", "profile_time_ns", "i", "p.*")
