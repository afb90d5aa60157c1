"""Classic netCDF (versions 1, 2 and 5 are told apart; 1 and 2 are read): variables as tables.

Defined cases: fill values and NaN become null; scale and offset attributes are applied; a record
dimension may be empty (no rows); variables of other dimensions than the first one named are
refused, as is any other file format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# List tags and external types of the format.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


class _Header:
    """Names, sizes, attributes and places of a file's variables."""

    def __init__(self, raw: bytes):
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise ValueError("not a classic netCDF file of version 1 or 2")
        self.raw, self.at, self.wide = raw, 4, raw[3] == 2
        self.records = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list()):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            attributes, kind, size = self._attributes(), self._int(), self._int()
            begin = self._int(8) if self.wide else self._int()
            self.variables[name] = (dims, attributes, TYPES[kind], size, begin)

    def _int(self, width: int = 4) -> int:
        v = int.from_bytes(self.raw[self.at : self.at + width], "big")
        self.at += width
        return v

    def _list(self) -> int:
        self._int()
        return self._int()

    def _padded(self, n: int) -> bytes:
        v = self.raw[self.at : self.at + n]
        self.at += n + -n % 4
        return v

    def _name(self) -> str:
        return self._padded(self._int()).decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), TYPES[self._int()], self._int()
            data = self._padded(n * np.dtype(kind).itemsize)
            out[name] = data.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(data, kind, n)
        return out

    def shape(self, name: str) -> list[tuple[str, int]]:
        """(dimension, length); the record dimension is stated as 0 and has the file's records."""
        return [(self.dims[d][0], self.dims[d][1] or self.records) for d in self.variables[name][0]]

    def values(self, name: str) -> np.ndarray:
        dims, attributes, kind, size, begin = self.variables[name]
        shape = [n for _, n in self.shape(name)]
        if dims and self.dims[dims[0]][1] == 0:  # one slice a record, those of all variables in turn
            step = sum(v[3] for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0)
            one = int(np.prod(shape[1:], dtype=int)) * np.dtype(kind).itemsize
            data = b"".join(self.raw[begin + i * step : begin + i * step + one] for i in range(self.records))
        else:
            data = self.raw[begin : begin + int(np.prod(shape, dtype=int)) * np.dtype(kind).itemsize]
        v = np.frombuffer(data, kind).astype(float)
        fill = attributes.get("_FillValue", attributes.get("missing_value"))
        if fill is not None:
            v[v == float(fill[0])] = np.nan
        return v * float(attributes.get("scale_factor", [1.0])[0]) + float(attributes.get("add_offset", [0.0])[0])


def read_variables(spark: SparkSession, path: str, dimensions: list[str], variables: list[str], pattern: str = "*") -> DataFrame:
    """Rows (file, an index for each dimension, the variables) of the files below a path.  A file is
    one task's work; its rows are sent on in batches."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, raw in zip(b.column(0), b.column(1)):
                head = _Header(raw.as_py())
                shape = head.shape(variables[0])
                if [d for d, _ in shape] != dimensions or any(head.shape(v) != shape for v in variables):
                    raise ValueError(f"variables of other dimensions: {shape}")
                cols = [head.values(v) for v in variables]
                for at in range(0, len(cols[0]), 100_000):
                    part = np.arange(at, min(at + 100_000, len(cols[0])))
                    index = np.unravel_index(part, [n for _, n in shape])
                    arrays = [pa.array([file.as_py()] * len(part)), *(pa.array(i.astype(np.int64)) for i in index), *(pa.array(c[part], from_pandas=True) for c in cols)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["file", *dimensions, *variables])

    schema = ", ".join(["file string", *(f"`{d}` long" for d in dimensions), *(f"`{v}` double" for v in variables)])
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return found.mapInArrow(decode, schema)


def file_bytes(dimensions: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]]) -> bytes:
    """A version 1 file of fixed dimensions; variables are (dimensions, values, attributes)."""
    names = list(dimensions)

    def name(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">II", tag if parts else 0, len(parts)) + b"".join(parts)

    def attribute(key: str, v) -> bytes:
        if isinstance(v, str):
            raw, code, n = v.encode(), 2, len(v.encode())
        else:
            raw, code, n = np.array([v], ">f8").tobytes(), 6, 1
        return name(key) + struct.pack(">II", code, n) + raw + b"\0" * (-len(raw) % 4)

    blocks = {k: v.astype(v.dtype.newbyteorder(">")).tobytes() for k, (_, v, _) in variables.items()}
    blocks = {k: b + b"\0" * (-len(b) % 4) for k, b in blocks.items()}

    def header(begin: int) -> bytes:
        parts = []
        for k, (dims, v, extra) in variables.items():
            meta = listed(ATTRIBUTES, [attribute(a, x) for a, x in extra.items()])
            parts.append(name(k) + struct.pack(f">I{len(dims)}I", len(dims), *(names.index(d) for d in dims)) + meta + struct.pack(">III", CODES[v.dtype.str[1:]], len(blocks[k]), begin))
            begin += len(blocks[k])
        dims_ = listed(DIMENSIONS, [name(d) + struct.pack(">I", n) for d, n in dimensions.items()])
        return b"CDF\x01" + struct.pack(">I", 0) + dims_ + listed(ATTRIBUTES, []) + listed(VARIABLES, parts)

    return header(len(header(0))) + b"".join(blocks.values())
