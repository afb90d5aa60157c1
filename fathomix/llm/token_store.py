"""Token-ID / binary output: raw id payloads with a minimal perfect hash index.

A store is a folder with, for each shard of consecutive document keys, ``shard-N.bin`` (ids and
nothing else, in key order, ready for memory mapping) and ``shard-N.idx`` (a minimal perfect
hash from keys to slots; each slot holds a key fingerprint, the offset and the length), and one
``manifest.json`` with a line of figures per shard.  A lookup finds the shard by bisecting the
manifest, one slot by at most a few bit tests, and tells unknown keys by the fingerprint.

Defined cases: a null text is an empty document (it still gets its end id); a null doc_id sorts
first and is a key of its own; rows that repeat a doc_id are stored one after the other in the
order of their texts and are keyed by (doc_id, occurrence); an empty table gives a store of no
shards; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fs, bound_batches, partitions
from .tokens import encoder

_U = np.uint64
_SEED = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def key_hash(ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hash of (doc_id or null, occurrence)."""
    with np.errstate(over="ignore"):
        base = np.where(null, _U(0), ids.astype(np.int64).view(np.uint64)) + null.astype(np.uint64) * _SEED
        return mix64(mix64(base + _SEED) + occurrence.astype(np.uint64) * _SEED + _U(1))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: one bit array a level, a key's slot is
    the rank of the first bit that it alone has set."""

    GAMMA, LEVELS = 2.0, 48

    def __init__(self, words: list[np.ndarray], ranks: list[np.ndarray], rest: np.ndarray, n: int):
        self.words, self.ranks, self.rest, self.n = words, ranks, rest, n

    @staticmethod
    def _at(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(h + _U(level + 1) * _SEED) % _U(bits)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        n, left, words, ranks, base = len(h), h, [], [], 0
        for level in range(cls.LEVELS):
            if not len(left):
                break
            bits = max(64, -(-int(cls.GAMMA * len(left)) // 64) * 64)
            at = cls._at(left, level, bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            w = np.packbits(alone, bitorder="little").view("<u8")
            c = np.bitwise_count(w).astype(np.uint64)
            words.append(w)
            ranks.append(_U(base) + np.concatenate([[_U(0)], np.cumsum(c)[:-1].astype(np.uint64)]))
            base += int(c.sum())
            left = left[~alone[at]]
        return cls(words, ranks, np.sort(left), n)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level holds it (then it is no key)."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (w, r) in enumerate(zip(self.words, self.ranks)):
            if not len(todo):
                break
            at = self._at(h[todo], level, len(w) * 64)
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (w[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(w[word] & ((_U(1) << bit) - _U(1)))
            out[todo[hit]] = (r[word] + below)[hit].astype(np.int64)
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            p = np.searchsorted(self.rest, h[todo])
            ok = (p < len(self.rest)) & (self.rest[np.minimum(p, len(self.rest) - 1)] == h[todo])
            out[todo[ok]] = self.n - len(self.rest) + p[ok]
        return out


def _pack(arrays: dict[str, np.ndarray], head: dict) -> bytes:
    """Named arrays behind a JSON header."""
    spec = json.dumps(head | {"arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    return b"FXIX" + len(spec).to_bytes(4, "little") + spec + b"".join(v.tobytes() for v in arrays.values())


def _unpack(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if data[:4] != b"FXIX":
        raise ValueError("not a shard index")
    n = int.from_bytes(data[4:8], "little")
    head, at, out = json.loads(data[8 : 8 + n]), 8 + n, {}
    for name, kind, size in head["arrays"]:
        out[name] = np.frombuffer(data, kind, size, at)
        at += out[name].nbytes
    return head, out


class ShardIndex:
    """Keys of one shard with their places."""

    def __init__(self, data: bytes):
        head, a = _unpack(data)
        levels = head["levels"]
        self.hash = PerfectHash([a[f"w{i}"] for i in range(levels)], [a[f"r{i}"] for i in range(levels)], a["rest"], len(a["ids"]))
        self.ids, self.null, self.occurrence = a["ids"], a["null"].astype(bool), a["occurrence"]
        self.print, self.offset, self.length = a["print"], a["offset"], a["length"]

    @staticmethod
    def dump(ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray, length: np.ndarray) -> bytes:
        h = key_hash(ids, null, occurrence)
        p = PerfectHash.build(h)
        slot = p.slots(h)
        offset = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        place = lambda v, kind: (out := np.zeros(len(h), kind), out.__setitem__(slot, v))[0]
        arrays = {f"w{i}": w for i, w in enumerate(p.words)} | {f"r{i}": r for i, r in enumerate(p.ranks)}
        arrays |= {
            "rest": p.rest, "ids": ids.astype("<i8"), "null": null.astype("u1"), "occurrence": occurrence.astype("<u4"),
            "print": place((h >> _U(32)).astype("<u4"), "<u4"), "offset": place(offset, "<u8"), "length": place(length, "<u8"),
        }
        return _pack(arrays, {"levels": len(p.words)})

    def find(self, ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key, offsets in ids from the shard's start."""
        h = key_hash(ids, null, occurrence)
        slot = self.hash.slots(h)
        at = np.maximum(slot, 0)
        if not len(self.print):
            return np.zeros(len(h), bool), at, at
        found = (slot >= 0) & (self.print[at] == (h >> _U(32)).astype(np.uint32))
        return found, self.offset[at].astype(np.int64), self.length[at].astype(np.int64)


def occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal keys stand right before each key of a sorted list."""
    if not len(ids):
        return np.zeros(0, np.uint32)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return (np.arange(len(ids)) - first).astype(np.uint32)


def write_store(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, shards: int | None = None) -> dict:
    """Encode docs (doc_id, text) into a store at the URI out; gives its manifest.

    One range shuffle by doc_id; the shuffle partition is the shard.  A task writes under a name
    of its own attempt and renames at the end, so retried and speculative tasks are harmless.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shards = shards or partitions(spark)
    schema = "shard int, docs long, ids long, first long, last long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs(out)
        task = TaskContext.get()
        name, code = f"{root}/shard-{task.partitionId():06d}", encoder(tokenizer)
        wide = code.tokenizer.get_vocab_size() > 65_536
        end, kind = np.array([end_id], "<u4").tobytes(), "<u4" if wide else "<u2"
        ids, null, length, sink, temp = [], [], [], None, f"{name}.bin.{task.taskAttemptId()}"
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(temp, buffer_size=1 << 20)
            key = b.column(0)
            ids.append(key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            null.append(key.is_null().to_numpy(zero_copy_only=False))
            n = []
            for text in b.column(1):
                data = code.encode(text.as_py()) + end
                n.append(len(data) // 4)
                sink.write(data if wide else np.frombuffer(data, "<u4").astype(kind).tobytes())
            length.append(np.array(n, np.int64))
        if sink is None:
            return
        sink.close()
        i, z, n = map(np.concatenate, (ids, null, length))
        with fs.open_output_stream(f"{name}.idx.{task.taskAttemptId()}") as f:
            f.write(ShardIndex.dump(i, z, occurrences(i, z), n))
        for kind_ in ("bin", "idx"):
            fs.move(f"{name}.{kind_}.{task.taskAttemptId()}", f"{name}.{kind_}")
        row = {"shard": task.partitionId(), "docs": len(i), "ids": int(n.sum()), "first": None if z[0] else int(i[0]), "last": None if z[-1] else int(i[-1])}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), *((k, pa.int64()) for k in ("docs", "ids", "first", "last"))]))

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", F.col("text").asc_nulls_first())
        .mapInArrow(write, schema)
        .collect()
    )
    from tokenizers import Tokenizer

    start, parts = 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        parts.append(r.asDict() | {"start": start})
        start += r["ids"]
    manifest = {"format": 1, "id_bytes": 4 if Tokenizer.from_file(tokenizer).get_vocab_size() > 65_536 else 2, "end_id": end_id, "shards": parts}
    fs, root = arrow_fs(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class TokenStore:
    """Keyed access to a store: the shard by bisecting the manifest, then constant time in its index."""

    def __init__(self, uri: str):
        self.fs, self.root = arrow_fs(uri)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.kind = {2: "<u2", 4: "<u4"}[self.manifest["id_bytes"]]
        self._index: dict[int, ShardIndex] = {}

    def index(self, shard: int) -> ShardIndex:
        if shard not in self._index:
            with self.fs.open_input_stream(f"{self.root}/shard-{shard:06d}.idx") as f:
                self._index[shard] = ShardIndex(f.read())
        return self._index[shard]

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None if the store doesn't hold it."""
        order = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first
        shards = self.manifest["shards"]  # in order of their keys, which never share one
        k = bisect_right(shards, order(doc_id), key=lambda s: order(s["first"])) - 1
        if k < 0:
            return None
        shard = shards[k]["shard"]
        one = lambda v, t: np.array([v], t)
        found, at, n = self.index(shard).find(one(doc_id or 0, np.int64), one(doc_id is None, bool), one(occurrence, np.uint32))
        if not found[0]:
            return None
        size = self.manifest["id_bytes"]
        with self.fs.open_input_file(f"{self.root}/shard-{shard:06d}.bin") as f:
            return np.frombuffer(f.read_at(int(n[0]) * size, int(at[0]) * size), self.kind)


def read_store(spark: SparkSession, uri: str, block: int = 4 << 20) -> DataFrame:
    """Every document of a store: doc_id, occurrence, start, n_tokens, ids_crc32.

    One task per shard.  Each key goes through the index; its payload is then read by offset, in
    windows of about ``block`` ids.
    """
    store = TokenStore(uri)
    shards = {s["shard"]: s["start"] for s in store.manifest["shards"]}
    schema = "doc_id long, occurrence int, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    names, starts = list(shards), spark.sparkContext.broadcast(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TokenStore(uri)
        size = own.manifest["id_bytes"]
        for b in batches:
            for k in b.column(0).to_pylist():
                shard = names[k]
                x = own.index(shard)
                found, at, n = x.find(x.ids, x.null, x.occurrence)
                if not found.all():
                    raise ValueError(f"shard {shard}: a stored key isn't in its index")
                with own.fs.open_input_file(f"{own.root}/shard-{shard:06d}.bin") as f:
                    i = 0
                    while i < len(n):
                        j = i + 1
                        while j < len(n) and j - i < 20_000 and at[j] + n[j] - at[i] <= block:
                            j += 1
                        ids = np.frombuffer(f.read_at(int(at[j - 1] + n[j - 1] - at[i]) * size, int(at[i]) * size), own.kind).astype("<u4")
                        cut = at[i:j] - at[i]
                        crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(cut.tolist(), n[i:j].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(x.ids[i:j], pa.int64(), mask=x.null[i:j]),
                                pa.array(x.occurrence[i:j].astype(np.int32)),
                                pa.array(at[i:j] + starts.value[shard]),
                                pa.array(n[i:j]),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"],
                        )
                        i = j

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)
