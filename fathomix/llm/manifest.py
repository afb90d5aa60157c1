"""Merkle manifest of a dataset: one tree a source, one tree over the sources, a proof for every row.

Rows become leaves (SHA-256 of their length-prefixed fields, in JVM expressions).  A range sort
gives each leaf its place in its source; ``fanout ** depth`` neighbouring leaves make an aligned
block, stored as one row with a contiguous matrix of 64-byte hex digests.  Within a block all
levels come from reshaping that matrix by the fanout and hashing its rows, and the siblings of
every leaf from index arithmetic.  Block tops are the leaves of the next, far smaller round, so
there are log(rows) / log(fanout ** depth) rounds; siblings above a block are found once per
block and sent down, never once per row.

Only digests and keys are shuffled, never texts; no source passes one task, whatever its size.  The
driver gets counts and the root.

Defined cases: a null field is ``-``, an empty one ``0:``; null sources and null doc_ids sort first;
rows repeating a doc_id within a source are ordered by their leaf; equal rows are leaves of their own;
a null doc_id is never tampered with; an empty table has no root and no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hint_if_small, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
BLOCK = "g string, b long, n long, ids binary, no_id binary, leaves binary, others binary"
_BLOCK_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


# -- digest matrices ----------------------------------------------------------------------------


def matrix(raw: bytes) -> np.ndarray:
    """Hex digests laid end to end as rows of 64 bytes; no copy."""
    return np.frombuffer(raw, np.uint8).reshape(-1, HEX)


def hash_rows(rows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Digest matrix of the SHA-256 of each row, or of its first ``sizes`` bytes."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), int(np.prod(rows.shape[1:])))
    if sizes is None:
        found = [hashlib.sha256(r).hexdigest() for r in flat]
    else:
        found = [hashlib.sha256(r[:k]).hexdigest() for r, k in zip(flat, sizes.tolist())]
    return matrix("".join(found).encode())


def climb(leaves: np.ndarray, fanout: int, levels: int | None) -> list[np.ndarray]:
    """Digest matrices from the leaves upwards: so many levels, or until one node remains."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        x = out[-1]
        whole = len(x) // fanout
        up = [hash_rows(x[: whole * fanout].reshape(whole, fanout * HEX))]
        if len(x) % fanout:
            up.append(hash_rows(x[whole * fanout :].reshape(1, -1)))
        out.append(np.concatenate(up))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every leaf of a block: digests (leaf, level, sibling, byte) of all its siblings in order,
    which of them exist, and the leaf's own place (leaf, level) in each run."""
    m, at = len(levels[0]), np.arange(len(levels[0]))
    besides = np.array([[o for o in range(fanout) if o != k] for k in range(fanout)])
    found = np.empty((m, len(levels) - 1, fanout - 1, HEX), np.uint8)
    there = np.empty(found.shape[:3], bool)
    place = np.empty(found.shape[:2], np.uint8)
    for k, nodes in enumerate(levels[:-1]):
        place[:, k] = at % fanout
        who = (at - at % fanout)[:, None] + besides[place[:, k]]
        there[:, k] = who < len(nodes)
        found[:, k] = nodes[np.where(there[:, k], who, 0)]
        at = at // fanout
    return found, there, place


def fold(levels: list[np.ndarray], fanout: int, leaves: np.ndarray) -> np.ndarray:
    """Block tops that follow when each leaf in turn is replaced by the given one and its siblings
    stay: one for every leaf."""
    at, now = np.arange(len(leaves)), leaves
    for nodes in levels[:-1]:
        first, own = at - at % fanout, at % fanout
        run = nodes[np.minimum(first[:, None] + np.arange(fanout), len(nodes) - 1)]
        run[np.arange(len(at)), own] = now
        now = hash_rows(run, np.minimum(fanout, len(nodes) - first) * HEX)
        at = at // fanout
    return now


def steps(path: bytes) -> list[tuple[int, bytes]]:
    """(own place, siblings laid end to end) of each level of a path."""
    out, at = [], 0
    while at < len(path):
        own, k = path[at], path[at + 1]
        out.append((own, path[at + 2 : at + 2 + k * HEX]))
        at += 2 + k * HEX
    return out


def fold_path(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a node's digest and its path give."""
    for own, others in path:
        node = hashlib.sha256(others[: own * HEX] + node + others[own * HEX :]).hexdigest().encode()
    return node


# -- leaves and places --------------------------------------------------------------------------


def leaf(values: list[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its byte count, a colon and its value."""
    held = [c.cast("string") for c in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in held)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, id, leaf, other): other is the leaf after tampering, null where that changes nothing."""
    rows = docs.select(*(F.col(c) for c in FIELDS))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    fields = [F.col(c) for c in FIELDS]
    return rows.select(
        F.col("source").cast("string").alias("g"), F.col("doc_id").cast("long").alias("id"), leaf(fields).alias("leaf"),
        F.when(tampered, leaf([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])).alias("other"),
    )


def placed(rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """rows with i, their place in group g from 0 in that order (nulls first), and n, the group's size.

    One range shuffle; a serial number breaks ties, so that equal rows don't share a task.  Places
    are the task's own count plus that of the tasks before it, of which there is a row per task
    and group."""
    spark = rows.sparkSession
    rows.withColumn("_s", F.monotonically_increasing_id()).write.parquet(f"{folder}/unplaced")
    rows = spark.read.parquet(f"{folder}/unplaced")
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "_s")]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("_s")
    dealt = dealt.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt.write.parquet(f"{folder}/placed")
    dealt = spark.read.parquet(f"{folder}/placed")
    counts = dealt.groupBy("_p", "g").agg(F.min("_k").alias("first"), F.count("*").alias("c"))
    counts.createOrReplaceTempView(view := "counts_" + folder.rsplit("-", 1)[-1].replace("/", "_"))
    starts = spark.sql(f"""SELECT _p AS p2, g AS g2, sum(c) OVER (PARTITION BY g ORDER BY _p) - c - first AS base, sum(c) OVER (PARTITION BY g) AS n FROM {view}""")
    starts.write.parquet(f"{folder}/starts")
    spark.catalog.dropTempView(view)
    starts = hint_if_small(spark.read.parquet(f"{folder}/starts"), 200_000)
    joined = dealt.join(starts, (F.col("_p") == F.col("p2")) & F.col("g").eqNullSafe(F.col("g2")))
    return joined.withColumn("i", F.col("_k") + F.col("base")).drop("_p", "_k", "p2", "g2", "base")


def blocks(nodes: DataFrame, folder: str, name: str, size: int) -> DataFrame:
    """Nodes (g, i, n, id, leaf, other) as one row per aligned block of ``size``, in place order."""
    spark = nodes.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("id").combine_chunks()
            own = "".join(t.column("leaf").to_pylist())
            other = "".join(x or "-" * HEX for x in t.column("other").to_pylist())
            row = [t.column("g")[0].as_py(), t.column("b")[0].as_py(), t.column("n")[0].as_py(), ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), own.encode(), other.encode()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK_TYPES)], names=_BLOCK_NAMES)

        last = None
        for x in batches:
            if not len(x):
                continue
            g, b = x.column(0).fill_null("").to_numpy(zero_copy_only=False), x.column(1).to_numpy()
            null = x.column(0).is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (null[1:] != null[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(x)]):
                key = (null[lo], g[lo], b[lo])
                if held and key != last:
                    yield flush()
                last = key
                held.append(x.slice(lo, hi - lo))
        if held:
            yield flush()

    rows = nodes.select("g", F.floor(F.col("i") / size).cast("long").alias("b"), "n", "id", "leaf", "other", "i")
    rows = rows.repartition(partitions(spark), "g", "b").sortWithinPartitions("g", "b", "i").drop("i")
    rows.mapInArrow(pack, BLOCK).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


# -- trees --------------------------------------------------------------------------------------


class Forest:
    """A tree for each group of nodes: block tables, one a round, and the groups' roots."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int, depth: int):
        self.spark, self.folder, self.fanout, self.depth = spark, folder, fanout, depth
        self.rounds: list[DataFrame] = []

    @classmethod
    def grow(cls, nodes: DataFrame, folder: str, fanout: int = 3, depth: int = 8) -> Forest:
        """Nodes (g, i, n, id, leaf, other) to their groups' roots (g, leaf)."""
        self = cls(nodes.sparkSession, folder, fanout, depth)
        size, roots = fanout**depth, []
        while True:
            k = len(self.rounds)
            self.rounds.append(blocks(nodes, folder, f"blocks-{k}", size))

            def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for x in batches:
                    found = [climb(matrix(raw.as_py()), fanout, depth if n.as_py() > size else None)[-1].tobytes().decode() for n, raw in zip(x.column(2), x.column(3))]
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(found, pa.string())], names=["g", "i", "n", "leaf"])

            up = self.rounds[k].select("g", "b", "n", "leaves").mapInArrow(tops, "g string, i long, n long, leaf string")
            up.write.parquet(f"{folder}/tops-{k}")
            up = self.spark.read.parquet(f"{folder}/tops-{k}")
            roots.append(up.filter(F.col("n") <= size).select("g", "leaf"))
            more = up.filter(F.col("n") > size)
            if more.isEmpty():
                break
            none = F.lit(None)
            nodes = more.select("g", "i", F.ceil(F.col("n") / size).cast("long").alias("n"), none.cast("long").alias("id"), "leaf", none.cast("string").alias("other"))
        self.roots = reduce(DataFrame.unionByName, roots)
        return self

    def above(self, k: int) -> DataFrame:
        """Blocks of round k with path: the steps from their tops to their groups' roots."""
        size, fanout, depth = self.fanout**self.depth, self.fanout, self.depth
        rows = self.rounds[k]
        if k + 1 == len(self.rounds):
            return rows.withColumn("path", F.lit(b""))

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for g, b, n, raw, path in zip(*(c.to_pylist() for c in x.columns)):
                    levels = climb(matrix(raw), fanout, depth if n > size else None)
                    out = _paths(*siblings(levels, fanout), path)
                    at = np.arange(b * size, b * size + len(out))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(out), pa.string()), pa.array(at), pa.array(out, pa.binary())], names=["g2", "b2", "path"])

        up = self.above(k + 1).select("g", "b", "n", "leaves", "path").mapInArrow(paths, "g2 string, b2 long, path binary")
        up.write.parquet(f"{self.folder}/paths-{k}")
        up = hint_if_small(self.spark.read.parquet(f"{self.folder}/paths-{k}"), 20_000)
        return rows.join(up, rows["g"].eqNullSafe(up["g2"]) & (rows["b"] == up["b2"]), "left").drop("g2", "b2").withColumn("path", F.coalesce("path", F.lit(b"")))


def _paths(found: np.ndarray, there: np.ndarray, place: np.ndarray, rest: bytes) -> list[bytes]:
    out = []
    for f, t, p in zip(found, there, place):
        out.append(b"".join(bytes((p[k], int(t[k].sum()))) + f[k][t[k]].tobytes() for k in range(len(p))) + rest)
    return out


PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


class Manifest:
    """Trees of a dataset in a folder: ``sources`` (a tree each), ``top`` (over them), ``root``."""

    def __init__(self, sources: Forest, top: Forest, named: DataFrame, root: str | None):
        self.sources, self.top, self.named, self.root = sources, top, named, root

    @classmethod
    def build(cls, docs: DataFrame, folder: str, fanout: int = 3, depth: int = 8) -> Manifest | None:
        """Digest docs into the folder; None for an empty table."""
        rows = placed(leaves(docs), f"{folder}/leaves", ["id", "leaf"])
        if rows.isEmpty():
            return None
        sources = Forest.grow(rows, f"{folder}/sources", fanout, depth)
        subroots = sources.roots.select(F.lit("").alias("g"), F.col("g").alias("source"), "leaf")
        named = placed(subroots, f"{folder}/subroots", ["source"])
        none = F.lit(None)
        top = Forest.grow(named.select("g", "i", "n", none.cast("long").alias("id"), "leaf", none.cast("string").alias("other")), f"{folder}/top", fanout, depth)
        return cls(sources, top, named, top.roots.first()["leaf"])

    def source_paths(self) -> DataFrame:
        """(source, subroot, path): the steps from each source's root to the root of all."""
        top, size, fanout, depth = self.top, self.top.fanout**self.top.depth, self.top.fanout, self.top.depth

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for b, n, raw, path in zip(*(c.to_pylist() for c in x.columns)):
                    out = _paths(*siblings(climb(matrix(raw), fanout, depth if n > size else None), fanout), path)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(b * size, b * size + len(out))), pa.array(out, pa.binary())], names=["i", "path"])

        found = top.above(0).select("b", "n", "leaves", "path").mapInArrow(paths, "i long, path binary")
        return self.named.join(found, "i").select(F.col("source").alias("s"), F.col("leaf").alias("subroot"), F.col("path").alias("last"))

    def proofs(self) -> DataFrame:
        """A row for each row of the dataset: its leaf, its source's root, the digest of its siblings
        and the root that its tampered leaf, else its own, gives with them."""
        size, fanout, depth = self.sources.fanout**self.sources.depth, self.sources.fanout, self.sources.depth

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for ids, no_id, n, raw, other, path, subroot in zip(*(c.to_pylist() for c in x.columns)):
                    own, levels = matrix(raw), climb(matrix(raw), fanout, depth if n > size else None)
                    found, there, _ = siblings(levels, fanout)
                    up = steps(path)
                    rest, known = b"".join(s for _, s in up), {}
                    m = len(own)
                    found, there = found.reshape(m, there.shape[1] * there.shape[2], HEX), there.reshape(m, there.shape[1] * there.shape[2])
                    whole = there.all(1)
                    proof = [hashlib.sha256((f.tobytes() if w else f[t].tobytes()) + rest).hexdigest() for f, t, w in zip(found, there, whole)]
                    changed = matrix(other)
                    now = fold(levels, fanout, np.where(changed[:, :1] == ord("-"), own, changed))
                    roots = []
                    for top in (r.tobytes() for r in now):
                        if top not in known:
                            known[top] = fold_path(top, up).decode()
                        roots.append(known[top])
                    text = raw.decode()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(no_id, bool)), pa.array([text[k : k + HEX] for k in range(0, len(text), HEX)]), pa.array([subroot] * m), pa.array(proof), pa.array(roots)],
                        names=[c.split()[0] for c in PROOFS.split(", ")],
                    )

        rows, seeds = self.sources.above(0), hint_if_small(self.source_paths(), 20_000)
        rows = rows.join(seeds, rows["g"].eqNullSafe(seeds["s"])).select("ids", "no_id", "n", "leaves", "others", F.concat("path", "last").alias("path"), "subroot")
        return rows.mapInArrow(prove, PROOFS)


def verify(docs: DataFrame, folder: str, fanout: int = 3, depth: int = 8) -> DataFrame:
    """Manifest of docs in the folder, and for each row its proof and whether it holds after tampering."""
    found = Manifest.build(docs, folder, fanout, depth)
    if found is None:
        rows, root = docs.sparkSession.createDataFrame([], PROOFS), ""
    else:
        rows, root = found.proofs(), found.root
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def oracle() -> str:
    """The same in DuckDB: levels by a recursive grouping, proofs and folds by a recursive join."""
    fields = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1])
    text = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
    shift = "list_reduce([c] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda r, x: {shift.replace('[c]', '[xor(r, x)]')}), 4294967295)"
    return f"""
WITH RECURSIVE base AS (
  SELECT source, doc_id, sha256({fields} || {text.format("text")}) AS leaf,
    sha256({fields} || CASE WHEN coalesce({crc} % 2 = 0, false) THEN {text.format("replace(text, chr(10), '')")} ELSE {text.format("text")} END) AS used
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS rid FROM base),
low AS (
  SELECT source, 0 AS lev, i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM numbered
  UNION ALL
  SELECT source, lev + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), max((n + 2) // 3) FROM low WHERE n > 1 GROUP BY source, lev, i // 3),
tops AS (SELECT source, lev AS height, node FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lev, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT lev + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), max((n + 2) // 3) FROM high WHERE n > 1 GROUP BY lev, i // 3),
place AS (SELECT source, height, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tops),
nodes AS (
  SELECT source, lev, i, node FROM low WHERE n > 1
  UNION ALL SELECT p.source, p.height + h.lev, h.i, h.node FROM place p, high h WHERE h.n > 1),
runs AS (SELECT source, lev, i // 3 AS r, list(node ORDER BY i) AS run FROM nodes GROUP BY source, lev, i // 3),
walk AS (
  SELECT b.rid, b.source, 0 AS lev, b.i, b.used AS cur, '' AS proof, t.height, t.i AS top FROM numbered b JOIN place t ON b.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT w.rid, w.source, w.lev + 1, j // 3,
    sha256(array_to_string(run[:j % 3] || [w.cur] || run[j % 3 + 2:], '')), w.proof || array_to_string(run[:j % 3] || run[j % 3 + 2:], ''), w.height, w.top
  FROM (SELECT *, CASE WHEN lev = height THEN top ELSE i END AS j FROM walk) w JOIN runs u ON w.source IS NOT DISTINCT FROM u.source AND w.lev = u.lev AND w.j // 3 = u.r),
done AS (SELECT rid, max_by(cur, lev) AS folded, max_by(proof, lev) AS proof FROM walk GROUP BY rid)
SELECT b.doc_id, b.leaf, t.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(d.proof) AS proof_sha256,
  d.folded AS folded_root, d.folded = (SELECT node FROM high WHERE n = 1) AS verified
FROM numbered b JOIN done d USING (rid) JOIN tops t ON b.source IS NOT DISTINCT FROM t.source"""
