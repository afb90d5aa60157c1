import random

import pytest

from fathomix.llm import components as comps
from fathomix.llm.jaccard_join import JaccardJoin
from fathomix.llm.shingles import packed_set, parity_bitmap, read_set, shingle_set


def brute(rows, size, num, den):
    sets = [set(shingle_set(r.text, size).tolist()) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i].doc_id is None or rows[j].doc_id is None:
                continue
            if rows[i].doc_id == rows[j].doc_id and a and b or a & b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[root(i)] = min(low.get(root(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id is None, r.doc_id or 0, len(sets[i]), -1 if r.doc_id is None else low[root(i)]) for i, r in enumerate(rows))


def found(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.choice([0, 1, 3, 4, 8, 30, 120]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            w += passage
        out.append((i * 3, " ".join(w)))
    return out


@pytest.mark.parametrize("seed, size, num", [(2, 5, 80), (3, 2, 70), (5, 1, 50)])
def test_components_against_brute_force(spark, seed, size, num):
    df = spark.createDataFrame(corpus(seed), "doc_id long, text string")
    want = brute(df.collect(), size, num, 100)
    # regions as leaves, by pivot documents in several rounds, and divided by further shingles
    options = {"leaf": 2, "rounds": 1, "split": 4} if seed % 2 else {}
    assert found(JaccardJoin(size, num, 100, common=50, **options).join(df).collect()) == want


def test_without_broadcasts_or_one_task(spark, monkeypatch):
    df = spark.createDataFrame(corpus(7), "doc_id long, text string")
    monkeypatch.setattr(comps.components, "__defaults__", (0,))
    got = JaccardJoin(4, 85, 100, small_rows=0).join(df).collect()
    assert found(got) == brute(df.collect(), 4, 85, 100)


def hot(n=150):
    """All documents share a passage; a third are near copies of one, others near one another or alone."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, whole = [word() for _ in range(60)], [word() for _ in range(90)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            w = list(whole)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([4, 9, 12, 40]))]
        out.append((i, " ".join(passage + w)))
    return out


def test_one_hot_region(spark):
    df = spark.createDataFrame(hot(), "doc_id long, text string")
    want = brute(df.collect(), 4, 85, 100)
    assert found(JaccardJoin(4, 85, 100, leaf=4, rounds=2, split=8, common=1).join(df).collect()) == want


def test_odd_documents(odd_docs, no_docs):
    assert found(JaccardJoin(4, 85, 100).join(odd_docs).collect()) == brute(odd_docs.collect(), 4, 85, 100)
    assert JaccardJoin(4, 85, 100).join(no_docs).count() == 0


def test_contract_of_small_texts(spark):
    rows = [(1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "b a"), (6, "a b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JaccardJoin(4, 85, 100).join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    for one_task in (0, 1000):
        got = {r.id: r.comp for r in comps.components(df, one_task).collect()}
        assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert comps.components(df.limit(0), 0).count() == comps.components(df.limit(0)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = random.Random(0)
    for _ in range(50):
        a = shingle_set(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 300))), 2)
        b = shingle_set(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 300))), 2)
        x, y = parity_bitmap(a), parity_bitmap(b)
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() for v in (x ^ y).view("u8")) <= len(set(a.tolist()) ^ set(b.tolist()))
        assert read_set(packed_set(a)).tolist() == a.tolist()


def test_copies_too_far_apart_are_no_rows_of_the_join(spark):
    """What bitmaps rule out is no row of a region's join, and blocks of a large region lose no pair."""
    rng = random.Random(11)
    whole = list(range(1, 200))
    sets = [shingle_set(" ".join(str(rng.randrange(10**9) if rng.random() < (0.02 if i < 20 else 0.2) else w) for w in whole), 1) for i in range(60)]
    bits = spark.createDataFrame([(i, len(s), parity_bitmap(s).tolist()) for i, s in enumerate(sets)], "id long, n long, bits array<long>")
    rows = spark.createDataFrame([(5, i, 0, len(s), True, 0.1, i, 0, 60) for i, s in enumerate(sets)], "key long, id long, pos int, n long, home boolean, d double, comp long, most long, k long")
    want = {(a, b) for a in range(60) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    for block in (7, 512):
        got = [tuple(sorted((r.a, r.b), reverse=True)) for r in JaccardJoin(1, 85, 100, block=block)._pairs(rows, bits).collect()]
        assert want <= set(got) and len(want) > 100 and len(got) == len(set(got)) < 600


def test_members_and_sets_are_shuffled_once(spark):
    """Members of regions are counted and filtered in one exchange; a's set is made where its text is read."""
    reps = spark.createDataFrame([(1, 8, [7, 8]), (2, 8, [8, 9]), (3, 8, [5, 8])], "doc_id long, n long, path array<long>")
    got = JaccardJoin(5, 80, 100)._regions(reps)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.key, r.id, r.pos, r.k) for r in got.collect()) == [(8, 1, 1, 3), (8, 2, 0, 3), (8, 3, 1, 3)]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x"), (3, "a b c d")], "doc_id long, text string")
    from fathomix.llm import jaccard_join as jj

    pairs = jj.materialise(spark.createDataFrame([(1, 2), (3, 2), (3, 1)], "a long, b long"), "near-pairs")
    sets, only = [], JaccardJoin(1, 60, 100)
    make = only._sets
    only._sets = lambda ids, d: sets.append(sorted(r[0] for r in ids.collect())) or make(ids, d)
    out = sorted((r.a, r.b, round(r.d, 3), r.linked) for r in only._distances(pairs, docs).collect())
    assert out == [(1, 2, 0.4, True), (3, 1, 0.0, True), (3, 1, 1.0, False), (3, 2, 0.4, True), (3, 2, 1.0, False)]
    assert sets == [[1, 2]]
