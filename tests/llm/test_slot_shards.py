"""Shards by virtual slots: their law, places, maps and their edits."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathomix.llm import slot_shards as ss
from fathomix.llm.common import new_folder
from oracle import DATA


def plan_of(load, shards, rows=None):
    load = np.asarray(load, np.int64)
    return ss.SlotMap.even(shards, load, np.asarray(rows if rows is not None else np.maximum(1, load // 100), np.int64))


def test_rebalance_evens_out_bytes_and_moves_few():
    rng = np.random.default_rng(1)
    first = plan_of(rng.pareto(1.3, 4096) * 1000 + 1, 16)
    second = first.rebalance()
    loads = second.loads()
    assert (first.version, second.version) == (1, 2) and loads.sum() == first.load.sum() == first.loads().sum()
    assert loads.max() - loads.min() <= 1e-3 * loads.mean()
    assert (second.shard != first.shard).mean() < 0.5
    assert (second.rebalance().shard == second.shard).all()


def test_hot_slots_are_held_in_parts():
    load = np.full(512, 1000)
    load[7] = 500_000
    second = plan_of(load, 16).rebalance()
    assert (second.slot == 7).sum() > 16 and len(set(second.shard[second.slot == 7])) > 4
    assert second.load[second.slot == 7].sum() == 500_000
    assert np.ptp(second.loads()) <= 1000  # one unit


def test_one_record_above_a_share_stays_whole():
    load = np.full(64, 10)
    load[5] = 100_000
    second = plan_of(load, 4, np.ones(64)).rebalance()
    own = second.shard[second.slot == 5][0]
    assert (second.shard == own).sum() == 1


def test_resize_moves_into_new_shards_only():
    rng = np.random.default_rng(2)
    plan = plan_of(rng.integers(1, 2000, 4096), 16).rebalance()
    more = plan.resize(17)
    moved = more.shard != plan.shard
    assert set(more.shard[moved]) == {16} and more.version == 3
    assert abs(moved.mean() - 1 / 17) < 0.02 and np.ptp(more.loads()) < 0.05 * more.loads().mean()
    fewer = more.resize(12)
    stay = more.shard < 12
    assert (fewer.shard[stay] == more.shard[stay]).all() and fewer.shard.max() == 11
    assert (plan.resize(16).shard == plan.shard).all()


def test_maps_are_kept_by_version(spark):
    folder = new_folder(spark, "map")
    first = plan_of(np.arange(1, 300), 5)
    second = first.rebalance()
    for x in (first, second):
        x.save(spark, folder)
    for version, want in ((1, first), (None, second)):
        got = ss.SlotMap.load_version(spark, folder, 5, version)
        assert got.version == want.version and (got.shard == want.shard).all() and (got.load == want.load).all() and (got.parts == want.parts).all()


def check(rows, docs, shards, spread):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    places, loads = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    if spread is not None:
        sizes = [loads[k] for k in range(shards)]
        assert max(sizes) - min(sizes) <= spread * sum(sizes) / shards


def test_query(spark):
    from fathomix.llm import queries

    sf = f"{DATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.QUERIES["op11_slot_shards"](spark, sf).collect(), docs, 16, 0.01)


def test_hot_and_null_keys_are_spread(spark):
    rows = [(None if k % 3 else 7, f"text {k % 5}", 1) for k in range(3000)] + [(k, "x" * (k % 40), 1) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check(ss.digest(docs, 16).collect(), [r[:2] for r in rows], 16, 0.2)


def test_odd_rows(spark, odd_docs, no_docs):
    check(ss.digest(odd_docs, 3).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 3, None)
    assert ss.digest(no_docs, 3).count() == 0
    found, _ = ss.shard(odd_docs, new_folder(spark, "shards"), 3)
    assert found.select("record.*").columns == odd_docs.columns
    with pytest.raises(Exception, match="exist"):
        ss.shard(odd_docs, (f := new_folder(spark, "shards")), 3) and ss.shard(odd_docs, f, 3)
