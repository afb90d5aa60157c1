"""Periodic runs against a comparison of every word with the one a period before it."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fathomix.llm import periodic_runs as pr
from oracle import DATA


def brute_runs(w, least):
    """For every period, the stretches in which words equal those a period before."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    a, best = np.array([ids[x] for x in w], int), {}
    for p in range(1, len(w) // 2 + 1):
        eq = np.concatenate([[0], (a[p:] == a[:-p]).astype(int), [0]])
        turns = np.flatnonzero(np.diff(eq)).reshape(-1, 2)
        for lo, hi in turns.tolist():
            if hi - lo + p >= max(least, 2 * p):
                best.setdefault((lo, hi + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 12)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    sha = hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha, hashlib.sha256(kept).hexdigest())


def sequences(rng, n, letters):
    yield [rng.randrange(letters) for _ in range(n)]
    part = [rng.randrange(letters) for _ in range(1 + n // 7)]
    yield (part * 7)[: n - 2] + [rng.randrange(letters), 0]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    yield b[:n]  # Fibonacci words hold the most runs
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    yield t[:n]
    yield [0] * n
    x = [rng.randrange(letters) for _ in range(n // 3)]
    yield x + [rng.randrange(letters)] + x + x


@pytest.mark.parametrize("least", [2, 5, 12])
def test_all_runs(least):
    rng = random.Random(least)
    for _ in range(120):
        for w in sequences(rng, rng.randrange(1, 90), rng.choice([1, 2, 3, 6])):
            assert pr.factor_runs(w, least) == brute_runs(w, least), w
            assert pr.word_runs([str(x).encode() for x in w], least) == brute_runs(w, least), w


def test_factors_are_longest_earlier_occurrences():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        at = 0
        for start, end, source in pr.SuffixAutomaton(w).factors():
            longest = max((k for k in range(1, len(w) - at + 1) if any(w[j : j + k] == w[at : at + k] for j in range(at))), default=0)
            assert start == at and end - start == max(1, longest)
            if source >= 0:
                assert source < start and w[source : source + end - start] == w[start:end]
            else:
                assert longest == 0
            at = end
        assert at == len(w)


def test_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rng = random.Random(5)
    for k in range(60):
        words = [rng.choice(["a", "é", "b\x0b", "日　本", "c\u0085"]) for _ in range(rng.randrange(0, 120))]
        rows.append((k, " \t".join(words * rng.choice([1, 2, 3]))))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    got = sorted((tuple(r) for r in pr.digest(pr.find(docs, 12, plant=True)).collect()), key=str)
    assert len(got) == len(rows)
    short = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    for want in (brute_row(*r) for r in short):
        assert want in got
    long = next(r for r in pr.find(odd_docs).collect() if r.doc_id == 7)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert pr.digest(pr.find(no_docs)).count() == 0


def test_query(spark):
    from fathomix.llm import queries

    sf = f"{DATA}/sf0.001"
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(want) and all(tuple(r) == want[r.doc_id] for r in got)
