"""The Merkle manifest against a plain tree, for any fanout and block size."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fathomix.llm import manifest
from fathomix.llm.common import new_folder
from oracle import DATA, connect, same

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, text):
    parts = [r[0], r[1], r[2], r[3], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest("".join(x[k : k + 3])) for k in range(0, len(x), 3)])
    return levels


def sibs(levels, i):
    out = []
    for x in levels[:-1]:
        lo = i // 3 * 3
        out.append((i - lo, [x[k] for k in range(lo, min(lo + 3, len(x))) if k != i]))
        i //= 3
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees[s] = tree([plain_leaf(r, r[4]) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = sibs(trees[s], i) + sibs(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = plain_leaf(r, text)
            for own, others in path:
                now = digest("".join([*others[:own], now, *others[own:]]))
            out.append((r[0], plain_leaf(r, r[4]), trees[s][-1][0], top[-1][0], digest("".join(x for _, o in path for x in o)), now, now == top[-1][0]))
    return sorted(out, key=str)


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["ä\nö", "line\nline", "日本", "", "x", "a b\n\n"]
    rows = [(rng.choice([None, *range(-n, n)]), rng.choice(["hot"] * n + [None, "", "z", "é", "Z"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, " ".join(rng.choices(words, k=3))]), 1, "g") for _ in range(n)]
    return rows + rows[:3] * 2


@pytest.mark.parametrize("n, depth", [(2, 1), (10, 1), (90, 2), (250, 1), (250, 8)])
def test_like_a_plain_tree(spark, n, depth):
    rows = some_rows(n, n + depth)
    found = manifest.verify(spark.createDataFrame(rows, FIELDS), new_folder(spark, "manifest"), 3, depth)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    found = manifest.verify(spark.createDataFrame([], FIELDS), new_folder(spark, "manifest"))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and found.count() == 0


def test_every_row_a_source_of_its_own(spark):
    rows = [(k, f"s{k}", "en", 1, "t\n", 0, "") for k in range(40)]
    found = manifest.verify(spark.createDataFrame(rows, FIELDS), new_folder(spark, "manifest"), 3, 2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_paths_fold_to_the_root():
    leaves = manifest.hash_rows(np.arange(50, dtype=np.uint8).reshape(50, 1))
    for fanout in (2, 3, 5):
        levels = manifest.climb(leaves, fanout, None)
        found, there, place = manifest.siblings(levels, fanout)
        for raw, path in zip(leaves, manifest._paths(found, there, place, b"")):
            assert manifest.fold_path(raw.tobytes(), manifest.steps(path)) == levels[-1].tobytes()
        assert (manifest.fold(levels, fanout, leaves) == levels[-1]).all()


def test_matches_sql(spark):
    from fathomix.llm import queries

    sf = f"{DATA}/sf0.001"
    same(queries.QUERIES["op13_merkle_manifest"](spark, sf).toPandas(), connect(sf).sql(queries.SQL["op13_merkle_manifest"]).df())
