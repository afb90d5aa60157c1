"""Sharding by fixed virtual slots.

A record's key is hashed into one of some thousand slots, for good.  Which shard a slot belongs to
is written in a map with versions: version 1 deals the slots evenly by number; each later one is an
edit of the one before, which moves as few slots as it needs.  ``SlotMap.rebalance`` evens out the
bytes that were counted per slot, ``SlotMap.resize`` adds or removes shards.  Records move only
with their slot.

A slot that outweighs its share (a hot key, or one of many null keys) is held in parts: its records
are dealt over as many parts as its bytes ask for, by their serial number, the parts are weighed in a
second look at such slots, and are moved like slots.  So no key is one task's or one shard's load.  Only the bytes and rows of slots reach the
driver, of which there is a fixed number; parts are at most ``slots + 32 * shards``.

``write_shards`` moves each record once and writes Parquet files, a folder a shard.

Defined cases: a null text has no bytes; a null key is a key of its own; equal rows are records of
their own; a record bigger than a shard's share stays whole, and its shard gets nothing else as
long as others can hold that; an empty table gives a map without bytes and no rows; further columns
are kept within ``record``, so no name clashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, partitions

SLOTS = 8192
MAP = "version int, slot int, part int, parts int, shard int, bytes long, rows long"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; never changes."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def size_of(text: Column) -> Column:
    """A record's size: the text's bytes and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class SlotMap:
    """One version of the map: for each unit (a slot, or a part of one) its shard and load."""

    def __init__(self, version: int, shards: int, slot: np.ndarray, part: np.ndarray, parts: np.ndarray, shard: np.ndarray, load: np.ndarray, rows: np.ndarray):
        self.version, self.shards = version, shards
        self.slot, self.part, self.parts, self.shard, self.load, self.rows = slot, part, parts, shard, load, rows

    @classmethod
    def even(cls, shards: int, load: np.ndarray, rows: np.ndarray, share: int | None = None) -> SlotMap:
        """Version 1: slots in order, as many a shard as another; slots above ``share`` bytes in parts."""
        slots = len(load)
        share = max(1, int(load.sum()) // (32 * shards) if share is None else share)
        parts = np.maximum(1, np.minimum(-(-load // share), np.maximum(rows, 1)))
        parts[load <= share] = 1
        slot = np.repeat(np.arange(slots), parts)
        part = np.arange(len(slot)) - np.repeat(np.cumsum(parts) - parts, parts)
        held = [(x[slot] // parts[slot]) + (part < x[slot] % parts[slot]) for x in (load, rows)]
        return cls(1, shards, slot, part, parts[slot], np.arange(len(slot)) * shards // len(slot), *held)

    def loads(self) -> np.ndarray:
        """Bytes of each shard."""
        return np.bincount(self.shard, self.load, self.shards).astype(np.int64)

    def _edited(self, shards: int, shard: np.ndarray) -> SlotMap:
        return SlotMap(self.version + 1, shards, self.slot, self.part, self.parts, shard, self.load, self.rows)

    def rebalance(self, tolerance: float = 1e-4) -> SlotMap:
        """The next version: units go from the fullest shard to emptier ones, or are exchanged for
        smaller ones there, as long as that brings two shards nearer to one another and they
        differ by more than ``tolerance`` of a shard's mean."""
        shard, loads = self.shard.copy(), self.loads()
        near = tolerance * loads.sum() / max(1, self.shards)
        members = [np.flatnonzero(shard == s) for s in range(self.shards)]

        def better(a: int, b: int) -> tuple[int, int] | None:
            """The unit of a to give to b, and one to get back or -1, that best halve their gap."""
            gap, mine, theirs = int(loads[a] - loads[b]), members[a], members[b]
            if gap <= near or not len(mine):
                return None
            back = np.concatenate([[0], self.load[theirs]])
            order = np.argsort(back, kind="stable")
            back = back[order]
            at = np.searchsorted(back, self.load[mine] - gap / 2)
            best = None
            for k in (-1, 0):
                pick = np.clip(at + k, 0, len(back) - 1)
                d = self.load[mine] - back[pick]
                d = np.where((d > 0) & (d < gap), np.abs(d - gap / 2), np.inf)
                x = int(np.argmin(d))
                if np.isfinite(d[x]) and (best is None or d[x] < best[0]):
                    best = (d[x], int(mine[x]), int(order[pick[x]]))
            return best and (best[1], int(theirs[best[2] - 1]) if best[2] else -1)

        while True:
            by = np.argsort(loads, kind="stable").tolist()
            pairs = [(by[-1], x) for x in by[:-1]] + [(x, by[0]) for x in by[-2:0:-1]]
            for a, b in pairs:
                found = better(a, b)
                if found:
                    break
            else:
                return self._edited(self.shards, shard)
            for unit, src, dst in ((found[0], a, b), (found[1], b, a)):
                if unit >= 0:
                    members[src], members[dst] = members[src][members[src] != unit], np.append(members[dst], unit)
                    loads[src] -= self.load[unit]
                    loads[dst] += self.load[unit]
                    shard[unit] = dst

    def resize(self, shards: int) -> SlotMap:
        """The next version, for another number of shards.  With more of them, each old shard gives its
        last units to the new ones, which nothing leaves and into which alone anything moves; with
        fewer, the units of those that go are dealt to the emptiest of the rest."""
        shard, loads = self.shard.copy(), np.append(self.loads(), np.zeros(max(0, shards - self.shards), np.int64))
        if shards >= self.shards:
            mean = loads.sum() / shards
            for old in range(self.shards):
                for u in np.flatnonzero(self.shard == old)[::-1].tolist():
                    new = self.shards + int(np.argmin(loads[self.shards :])) if shards > self.shards else old
                    if new == old or loads[old] - self.load[u] / 2 < mean:
                        break
                    shard[u] = new
                    loads[old] -= self.load[u]
                    loads[new] += self.load[u]
        else:
            moved = np.flatnonzero(shard >= shards)
            for u in moved[np.argsort(-self.load[moved], kind="stable")].tolist():
                new = int(np.argmin(loads[:shards]))
                shard[u] = new
                loads[new] += self.load[u]
        return self._edited(shards, shard)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table, a row a unit."""
        cols = (np.full(len(self.slot), self.version), self.slot, self.part, self.parts, self.shard, self.load, self.rows)
        return spark.createDataFrame(list(zip(*(c.tolist() for c in cols))), MAP)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the map's folder; a version is never overwritten."""
        self.frame(spark).drop("version").coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @classmethod
    def load_version(cls, spark: SparkSession, folder: str, shards: int, version: int | None = None) -> SlotMap:
        """A version from the map's folder, the newest unless it is named."""
        rows = spark.read.parquet(folder)
        version = rows.agg(F.max("version")).first()[0] if version is None else version
        t = rows.filter(F.col("version") == version).orderBy("slot", "part").toPandas()
        return cls(int(version), shards, *(t[c].to_numpy(np.int64) for c in ("slot", "part", "parts", "shard", "bytes", "rows")))


def slot_loads(docs: DataFrame, key: str, text: str, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of every slot.  Summed before the shuffle, so a row a task and slot moves."""
    rows = docs.select(slot_of(F.col(key), slots).alias("s"), size_of(F.col(text)).alias("b")).groupBy("s").agg(F.sum("b"), F.count("*")).collect()
    load, n = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for s, b, c in rows:  # at most one a slot
        load[s], n[s] = b, c
    return load, n


def weigh(docs: DataFrame, plan: SlotMap, key: str, text: str, slots: int = SLOTS) -> SlotMap:
    """plan with the bytes and rows that the parts of its slots really have."""
    if (plan.parts == 1).all():
        return plan
    unit = {(s, p): k for k, (s, p) in enumerate(zip(plan.slot.tolist(), plan.part.tolist()))}
    sizes = assign(docs, plan, key, slots).filter("parts > 1").groupBy("virtual_slot", "part").agg(F.sum(size_of(F.col(f"record.{text}"))), F.count("*"))
    load, rows = np.where(plan.parts > 1, 0, plan.load), np.where(plan.parts > 1, 0, plan.rows)
    for s, p, b, n in sizes.collect():  # at most 64 * shards
        load[unit[s, p]], rows[unit[s, p]] = b, n
    return SlotMap(plan.version, plan.shards, plan.slot, plan.part, plan.parts, plan.shard, load, rows)


def assign(docs: DataFrame, plan: SlotMap, key: str, slots: int = SLOTS) -> DataFrame:
    """(record, virtual_slot, part, parts, shard) of each row of docs; no shuffle, the map is broadcast."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("record"), slot_of(F.col(key), slots).alias("virtual_slot"), F.monotonically_increasing_id().alias("_n"))
    first = np.searchsorted(plan.slot, np.arange(slots))
    wide = spark.createDataFrame([(s, plan.shard[a:b].tolist()) for s, a, b in zip(range(slots), first.tolist(), [*first[1:].tolist(), len(plan.slot)])], "_slot int, _shards array<int>")
    part = F.when(F.size("_shards") > 1, F.pmod(F.xxhash64("_n"), F.size("_shards"))).otherwise(0).cast("int")
    joined = rows.join(F.broadcast(wide), F.col("virtual_slot") == F.col("_slot")).withColumn("part", part)  # slots is a fixed number
    return joined.select("record", "virtual_slot", "part", F.size("_shards").alias("parts"), F.get("_shards", F.col("part")).alias("shard"))


def write_shards(docs: DataFrame, plan: SlotMap, folder: str, key: str, text: str, slots: int = SLOTS) -> None:
    """Write docs as Parquet below folder, one folder a shard: (record, virtual_slot, part, at), at
    being the record's place in its unit by key, then checksum of the text, from 0."""
    order = Window.partitionBy("virtual_slot", "part").orderBy(F.col(f"record.{key}").asc_nulls_first(), F.crc32(F.col(f"record.{text}")))
    rows = assign(docs, plan, key, slots).repartition(partitions(docs.sparkSession), "virtual_slot", "part")
    rows.drop("parts").withColumn("at", F.row_number().over(order) - 1).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all shards with shard and slot, their place in it, gapless from 0.

    A unit's records begin where those of the units before it in its shard end; that takes the
    number of rows of each unit, counted from the files, which is a table no longer than the map."""
    rows = spark.read.parquet(folder)
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part")
    starts = rows.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(before) - F.col("n")).drop("n")
    joined = rows.join(F.broadcast(starts), ["shard", "virtual_slot", "part"])
    return joined.select("record", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("at")).alias("slot"), "virtual_slot", "part")


def shard(docs: DataFrame, folder: str, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Docs in shards of nearly equal bytes below folder, with both versions of their map."""
    spark = docs.sparkSession
    plan = weigh(docs, SlotMap.even(shards, *slot_loads(docs, key, text, slots)), key, text, slots)
    plan.save(spark, f"{folder}/map")
    plan = plan.rebalance()
    plan.save(spark, f"{folder}/map")
    write_shards(docs, plan, f"{folder}/data", key, text, slots)
    return read_shards(spark, f"{folder}/data"), plan


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Each document's shard and place, read back from the shards, with its size and checksum."""
    spark = docs.sparkSession
    if docs.isEmpty():
        schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, virtual_slot int, part int"
        return spark.createDataFrame([], schema)
    rows, _ = shard(docs, new_folder(spark, "shards"), shards)
    text = F.col("record.text")
    return rows.select(
        F.col("record.doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part",
    )
