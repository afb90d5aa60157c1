"""Shapefiles: points and lines with attributes, written by all tasks and read by ranges of records.

A reader's split is a range of a file's record index: a task reads that part of the index, the bytes of
those records and their attribute rows, and no others, so one large file is many tasks' work, and
fields that aren't asked for aren't decoded.  A writer's task closes a file after ``most`` records or
vertices; files appear under their names when they are complete.

Defined cases: a null or empty shape is a null record and has no vertices when read; attributes are
null where null; a text longer than a field may be (254 bytes) and a number that doesn't fit in its
field are errors, never cut; names longer than ten characters are refused, as are names that differ
only in case; an empty table writes no file; reading a folder without files gives no rows, and needs
``fields`` to be said; shapes other than points and lines are refused by number.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of shapes, the file code and version, field kinds of the attribute table.
NULL, POINT, LINE, POINT_Z, LINE_Z = 0, 1, 3, 11, 13
CODE, VERSION, NO_MEASURE = 9994, 1000, -1e39
FIELD = {"bigint": (b"N", 20, 0), "int": (b"N", 11, 0), "double": (b"N", 25, 15), "float": (b"N", 25, 15), "string": (b"C", 254, 0)}
VERTEX = "array<array<struct<x:double,y:double,z:double>>>"


def header(shape: int, size: int, box: list[float]) -> bytes:
    """The 100 bytes both files begin with; size in bytes, box as x and y, low then high."""
    return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, shape, *box, 0.0, 0.0, 0.0, 0.0)


def record(parts: list | None, shape: int) -> bytes:
    """The content of one record."""
    xyz = np.array([[p["x"], p["y"], p["z"] or 0.0] for part in parts or [] for p in part], dtype="<f8").reshape(-1, 3)
    if not len(xyz):
        return struct.pack("<i", NULL)
    if shape in (POINT, POINT_Z):
        if len(xyz) > 1:
            raise ValueError("a point has one vertex")
        return struct.pack("<i2d", shape, *xyz[0, :2]) + (struct.pack("<2d", xyz[0, 2], NO_MEASURE) if shape == POINT_Z else b"")
    first = np.cumsum([0, *(len(p) for p in parts if len(p))][:-1]).astype("<i4")
    low, high = xyz.min(0), xyz.max(0)
    out = struct.pack("<i4d2i", shape, low[0], low[1], high[0], high[1], len(first), len(xyz)) + first.tobytes() + xyz[:, :2].tobytes()
    return out + (struct.pack("<2d", low[2], high[2]) + xyz[:, 2].tobytes() if shape == LINE_Z else b"")


def vertices(content: bytes) -> list[tuple[int, int, float, float, float | None]]:
    """(part, vertex, x, y, z) of one record's content."""
    shape = struct.unpack_from("<i", content)[0]
    if shape == NULL:
        return []
    if shape in (POINT, POINT_Z):
        return [(0, 0, *struct.unpack_from("<2d", content, 4), struct.unpack_from("<d", content, 20)[0] if shape == POINT_Z else None)]
    if shape not in (LINE, LINE_Z):
        raise ValueError(f"shapes of kind {shape} aren't read; points and lines are")
    parts, n = struct.unpack_from("<2i", content, 36)
    first = np.frombuffer(content, "<i4", parts, 44)
    at = 44 + 4 * parts
    xy = np.frombuffer(content, "<f8", 2 * n, at).reshape(-1, 2)
    z = np.frombuffer(content, "<f8", n, at + 16 * n + 16).tolist() if shape == LINE_Z else [None] * n
    part = np.searchsorted(first, np.arange(n), side="right") - 1
    return list(zip(part.tolist(), (np.arange(n) - first[part]).tolist(), xy[:, 0].tolist(), xy[:, 1].tolist(), z))


def _cell(v, kind: bytes, width: int, digits: int, name: str) -> bytes:
    if v is None:
        return b" " * width
    if kind == b"C":
        raw = v.encode()
    else:
        raw = (f"{v:.{digits}f}" if digits else str(v)).encode()
        if len(raw) > width and digits:
            raw = repr(float(v)).encode()
    if len(raw) > width:
        raise ValueError(f"a value of {name} needs {len(raw)} bytes; its field has {width}")
    return raw.ljust(width) if kind == b"C" else raw.rjust(width)


def write(features: DataFrame, shape: int, folder: str, most: int = 65_536) -> DataFrame:
    """Features (parts: an array of arrays of x, y, z; other columns are attributes) as shapefiles below
    folder: (file, records) of each.  Files are written when the result is read."""
    kinds = [(n, *FIELD[t]) for n, t in features.dtypes if n != "parts"]
    if any(len(n.encode()) > 10 for n, *_ in kinds) or len({n.upper() for n, *_ in kinds}) < len(kinds):
        raise ValueError("names of fields have at most ten bytes and differ in more than case")
    names = [n for n, *_ in kinds]

    def close(held: list[bytes], rows: list[bytes], number: int) -> pa.RecordBatch:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{number:04d}"
        sizes = np.array([len(c) for c in held])
        at = 100 + np.concatenate([[0], np.cumsum(sizes + 8)])
        xy = [v[2:4] for c in held for v in vertices(c)]
        box = [*np.min(xy, 0), *np.max(xy, 0)] if xy else [0.0] * 4
        shp = header(shape, int(at[-1]), box) + b"".join(struct.pack(">2i", i + 1, len(c) // 2) + c for i, c in enumerate(held))
        shx = header(shape, 100 + 8 * len(held), box) + np.stack([at[:-1] // 2, sizes // 2], 1).astype(">i4").tobytes()
        width = 1 + sum(w for _, _, w, _ in kinds)
        dbf = struct.pack("<4BIHH20x", 3, 70, 1, 1, len(rows), 33 + 32 * len(kinds), width)
        dbf += b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in kinds) + b"\r" + b"".join(rows) + b"\x1a"
        for kind, raw in (("dbf", dbf), ("shx", shx), ("cpg", b"UTF-8"), ("shp", shp)):  # the file that readers look for comes last
            temp = f"{base}/.{stem}.{kind}.{task.taskAttemptId()}"
            with fs.open_output_stream(temp) as f:
                f.write(raw)
            fs.move(temp, f"{base}/{stem}.{kind}")
        return pa.RecordBatch.from_pylist([{"file": f"{stem}.shp", "records": len(held)}], schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, number = [], [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                held.append(record(r["parts"], shape))
                rows.append(b" " + b"".join(_cell(r[n], *k, n) for n, *k in kinds))
                size += 1 + len(held[-1]) // 64
                if size >= most:
                    yield close(held, rows, number)
                    held, rows, size, number = [], [], 0, number + 1
        if held:
            yield close(held, rows, number)

    return features.select(F.col("parts").cast(VERTEX).alias("parts"), *names).mapInArrow(store, "file string, records long")


def table_fields(raw: bytes) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """(where rows begin, bytes a row, (name, kind, offset in a row, width) of each field) of an attribute
    table's head.  Numbers without decimals of up to 20 bytes are long, others double, all else text."""
    start, width = struct.unpack_from("<HH", raw, 8)
    out, at = [], 1
    for i in range(32, start - 32, 32):
        if raw[i] == 0x0D:
            break
        name, kind, size, digits = raw[i : i + 11].split(b"\0")[0].decode(), raw[i + 11 : i + 12], raw[i + 16], raw[i + 17]
        out.append((name, ("long" if digits == 0 and size <= 20 else "double") if kind in (b"N", b"F") else "string", at, size))
        at += size
    return start, width, out


def _value(raw: bytes, kind: str):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if not text or kind == "string":
        return text or None
    try:
        return int(text) if kind == "long" else float(text)
    except ValueError:
        return None  # stars stand for a number that didn't fit


def fields_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, kind) of the attributes of the first file below a path; its head alone is read."""
    first = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path").agg(F.min("path")).first()[0]
    if first is None:
        return []
    fs, at = pafs.FileSystem.from_uri(first)
    with fs.open_input_file(f"{at[:-4]}.dbf") as f:
        raw = f.read(32)
        raw += f.read(struct.unpack_from("<H", raw, 8)[0] - 32)
    return [(n, k) for n, k, *_ in table_fields(raw)[2]]


def read(spark: SparkSession, path: str, fields: list[tuple[str, str]] | None = None, records: int = 16_384) -> DataFrame:
    """(file, record, part, vertex, x, y, z, and the attributes in ``fields``) of every vertex below a path,
    records of a file numbered from 0; ``fields`` are (name, kind), all of the first file's if unsaid.
    A split has at most ``records`` records; an attribute a file lacks is null there."""
    wanted = fields_of(spark, path) if fields is None else fields
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    base = {"file": pa.string(), "record": pa.int64(), "part": pa.int32(), "vertex": pa.int32(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64()}
    schema = pa.schema([*base.items(), *((n, types[k]) for n, k in wanted)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                fs, at = pafs.FileSystem.from_uri(s["path"])
                with fs.open_input_file(f"{at[:-4]}.shx") as f:
                    f.seek(100 + 8 * s["first"])
                    index = np.frombuffer(f.read(8 * records), ">i4").reshape(-1, 2).astype(np.int64) * 2
                with fs.open_input_file(f"{at[:-4]}.dbf") as f:
                    head = f.read(32)
                    head += f.read(struct.unpack_from("<H", head, 8)[0] - 32)
                    start, width, known = table_fields(head)
                    f.seek(start + width * s["first"])
                    rows = f.read(width * len(index))
                place = {n: (o, w) for n, _, o, w in known}
                held: list[list] = [[] for _ in schema]
                with fs.open_input_file(at) as f:
                    for i, (offset, size) in enumerate(index.tolist()):
                        f.seek(offset + 8)
                        own = vertices(f.read(size))
                        row = rows[i * width : (i + 1) * width]
                        values = [_value(row[place[n][0] : sum(place[n])], k) if n in place else None for n, k in wanted]
                        for v in own:
                            for c, x in zip(held, (s["path"], s["first"] + i, *v, *values)):
                                c.append(x)
                        if len(held[0]) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types)], schema=schema)
                            held = [[] for _ in schema]
                if held[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, schema.types)], schema=schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.shx").load(re.sub(r"\.shp$", ".shx", path)).select("path", "length")
    last = F.floor((F.col("length") - 108) / (8 * records)).cast("long")
    first = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * records))
    splits = found.filter("length > 100").select(F.regexp_replace("path", "shx$", "shp").alias("path"), first.alias("first"))
    spread = splits.repartition(spark.sparkContext.defaultParallelism * 4, "path", "first")  # paths and numbers only
    ddl = ", ".join(f"`{n}` {k}" for n, k in [("file", "string"), ("record", "long"), ("part", "int"), ("vertex", "int"), ("x", "double"), ("y", "double"), ("z", "double"), *wanted])
    return spread.mapInArrow(scan, ddl)


def navigation(points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Navigation (file, record, part, vertex, t, lon, lat, heading, vertical_offset) of read shapes, with
    the columns in ``keep`` beside it: a line's vertices are points with its attributes.  t is microseconds from DATE (dd/mm/yyyy) and TIME,
    HOUR or HEURE (hh:mm:ss), null without them or where they can't be read; heading is HEADING or
    CAP; IMMERSION goes down."""
    has = set(points.columns)

    def of(names: tuple[str, ...]) -> Column:
        return next((F.col(n) for n in names if n in has), F.lit(None).cast("string"))

    at = F.try_to_timestamp(F.concat_ws(" ", of(("DATE",)), of(("TIME", "HOUR", "HEURE"))), F.lit("dd/MM/yyyy HH:mm:ss"))
    down = -F.col("IMMERSION").cast("double") if "IMMERSION" in has else F.lit(None).cast("double")
    return points.select("file", "record", "part", "vertex", F.unix_micros(at).alias("t"), F.col("x").alias("lon"), F.col("y").alias("lat"), of(("HEADING", "CAP")).cast("double").alias("heading"), down.alias("vertical_offset"), *keep)
