"""Uncompressed GeoTIFF rasters: tiles of a grid written one a task, and read back as cells.

Defined cases: missing and absent cells hold the no-data value and are left out when read; NaN is
missing too; a tile without cells has no file; an empty grid writes nothing; compressed, tiled or
many-band files are refused by name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import GridSpec

# Tag numbers, field types and sample formats of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113
SHORT, LONG, ASCII, DOUBLE = 3, 4, 2, 12
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KIND = {1: "u", 2: "i", 3: "f"}
MISSING = -9999.0


def tiff_bytes(values: np.ndarray, west: float, north: float, res_x: float, res_y: float, missing: float = MISSING, geographic: bool = True) -> bytes:
    """One band of 32-bit floats, north row first, as a file."""
    rows, cols = values.shape
    data = np.where(np.isnan(values), missing, values).astype("<f4").tobytes()
    keys = [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1] if not geographic else [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]
    text = f"{missing:g}\0".encode()
    tags = [
        (WIDTH, LONG, [cols]), (LENGTH, LONG, [rows]), (BITS, SHORT, [32]), (COMPRESSION, SHORT, [1]), (PHOTOMETRIC, SHORT, [1]), (OFFSETS, LONG, [0]), (SAMPLES, SHORT, [1]),
        (STRIP_ROWS, LONG, [rows]), (STRIP_BYTES, LONG, [len(data)]), (FORMAT, SHORT, [3]), (SCALE, DOUBLE, [res_x, res_y, 0.0]), (TIE, DOUBLE, [0.0, 0.0, 0.0, west, north, 0.0]),
        (KEYS, SHORT, keys), (NODATA, ASCII, text),
    ]
    head, extra = 8 + 2 + 12 * len(tags) + 4, b""
    packed = {t: v if k == ASCII else struct.pack(f"<{len(v)}{FIELD[k]}", *v) for t, k, v in tags}
    start = head + sum(len(v) + len(v) % 2 for v in packed.values() if len(v) > 4)
    packed[OFFSETS] = struct.pack("<I", start)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for t, k, v in tags:
        raw = packed[t]
        if len(raw) > 4:
            out += struct.pack("<HHII", t, k, len(v), head + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            out += struct.pack("<HHI", t, k, len(v)) + raw.ljust(4, b"\0")
    return out + struct.pack("<I", 0) + extra + data


def parse_tiff(raw: bytes) -> tuple[np.ndarray, float, float, float, float]:
    """(values with NaN for missing, west, north, res_x, res_y) of an uncompressed one-band file."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(f"{order}H", raw, at)[0]):
        p = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(f"{order}HHI", raw, p)
        if kind not in FIELD:
            continue
        form = f"{order}{n}{FIELD[kind]}"
        where = p + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(f"{order}I", raw, p + 8)[0]
        tags[tag] = struct.unpack_from(form, raw, where)
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only uncompressed strips of one band can be read")
    kind = np.dtype(f"{order}{KIND[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
    data = b"".join(raw[a : a + n] for a, n in zip(tags[OFFSETS], tags[STRIP_BYTES]))
    v = np.frombuffer(data, kind).reshape(tags[LENGTH][0], tags[WIDTH][0]).astype(float)
    if NODATA in tags:
        v[v == float(tags[NODATA][0].rstrip(b"\0 "))] = np.nan
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE, (0.0,) * 6)
    return v, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy


def write_tiles(cells: DataFrame, layer: str, spec: GridSpec, folder: str, tile: int = 512) -> DataFrame:
    """Cells (row, col, layer) as tiles of at most tile x tile cells below the URI folder; gives one
    row (file, cells) per tile.  A tile is what a task holds; files are written under a name of the
    task's attempt and renamed."""

    def one(t: pa.Table) -> pa.Table:
        r, c = t["row"].to_numpy(), t["col"].to_numpy()
        i, j = int(r[0]) // tile, int(c[0]) // tile
        rows, cols = min(tile, spec.rows - i * tile), min(tile, spec.cols - j * tile)
        v = np.full((rows, cols), np.nan)
        v[rows - 1 - (r - i * tile), c - j * tile] = t["v"].to_numpy()
        raw = tiff_bytes(v, spec.west + j * tile * spec.res_x, spec.south + (i * tile + rows) * spec.res_y, spec.res_x, spec.res_y, geographic=spec.srs == "EPSG:4326")
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"tile-{i:06d}-{j:06d}.tif"
        temp = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temp) as f:
            f.write(raw)
        fs.move(temp, f"{base}/{name}")
        return pa.table({"file": [name], "cells": [int(np.isfinite(v).sum())]})

    inside = cells.filter(F.col("row").between(0, spec.rows - 1) & F.col("col").between(0, spec.cols - 1) & F.col(layer).isNotNull())
    dealt = inside.select("row", "col", F.col(layer).cast("double").alias("v"), F.floor(F.col("row") / tile).alias("_i"), F.floor(F.col("col") / tile).alias("_j"))
    return dealt.groupBy("_i", "_j").applyInArrow(one, "file string, cells long")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Cells (file, row, col, x, y, value) of the rasters below a path; row 0 is the north row of its
    file, x and y are cell centres.  A file is one task's work."""
    names = ["file", "row", "col", "x", "y", "value"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column(0), b.column(1)):
                v, west, north, sx, sy = parse_tiff(raw.as_py())
                r, c = np.nonzero(np.isfinite(v))
                for at in range(0, len(r), 100_000):
                    i, j = r[at : at + 100_000], c[at : at + 100_000]
                    cols = [[file.as_py()] * len(i), i.astype(np.int32), j.astype(np.int32), west + (j + 0.5) * sx, north - (i + 0.5) * sy, v[i, j]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).select("path", "content")
    return found.mapInArrow(decode, "file string, row int, col int, x double, y double, value double")
