import zlib

import corpus_pipeline
import numpy as np
import pytest
from fathomix.llm.shingles import words
from fathomix.llm.jaccard_join import JaccardJoin
from oracle import DATA

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        rows = {tuple(r) for r in after.collect()}
        assert rows <= {tuple(r) for r in before.collect()}
        before = spark.createDataFrame(list(rows), docs.schema)
    assert before.count() > 0.5 * docs.count()
    joined = JaccardJoin(5, 80, 100).join(before).collect()
    assert all(r.component_id == r.doc_id for r in joined)


def test_odd_rows_and_repeats(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, SF).count() == 0
        out = stage(spark, odd_docs, SF)
        assert out.columns == odd_docs.columns
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, SF).collect()
    pairs = [(r.doc_id, r.text or "") for r in kept if r.doc_id is not None]
    assert sorted(pairs) == sorted({(r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id is not None})
    packed = corpus_pipeline.best_fit_packing(spark, odd_docs, SF).collect()
    assert len({r.sequence_id for r in packed}) >= 1 and sum(r.start == 0 for r in packed) == odd_docs.count()
    assert corpus_pipeline.best_fit_packing(spark, no_docs, SF).count() == 0


def test_run_against_plain_code(spark):
    """What stays after each stage, by plain loops over the same rules."""
    from fathomix.llm import langid

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def profile(text):
        v = np.zeros(1024, np.int64)
        for c in langid.trigrams(text or ""):
            v += langid.trigram_vectors(np.array([c]), 1024, 7)[0]
        return v

    own = {r.doc_id: profile(r.text) for r in rows}
    protos = {k: sum(own[r.doc_id] for r in rows if r.lang == k and zlib.crc32(str(r.doc_id).encode()) % 5) for k in sorted({r.lang for r in rows if r.lang})}

    def score(v):
        return max(float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-9)) for p in protos.values())

    known = {r.doc_id for r in rows if own[r.doc_id].any() and score(own[r.doc_id]) >= corpus_pipeline.LEAST_SCORE}
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == known
    sets = {r.doc_id: set(map(tuple, zip(*(w[k:] for k in range(5))))) or {tuple(w)} for r in rows if (w := words(r.text))}
    up = {d: d for d in known}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sorted(known & set(sets)):
        for b in sorted(known & set(sets)):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    kept = corpus_pipeline.near_duplicates(spark, out, SF)
    assert {r.doc_id for r in kept.collect()} == {d for d in known if root(d) == d}
    clean = corpus_pipeline.decontamination(spark, kept, SF).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert {r.doc_id for r in clean} == {d for d in known if root(d) == d and not any(i in (texts[d] or "") for i in items)}


@pytest.mark.parametrize("n", [1])
def test_run(spark, n):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.length <= 2048 for r in rows)
