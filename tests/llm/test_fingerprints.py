import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomix.llm import fingerprints
from fathomix.llm.fingerprints import Sketch
from fathomix.llm.shingles import shingle_set

TEXT = st.lists(st.sampled_from("a b c d e f".split()), max_size=60).map(" ".join)


def jaccard(a, b):
    x, y = (set(shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@settings(max_examples=60, deadline=None)
@given(TEXT, TEXT)
def test_small_sketches_are_exact(a, b):
    x, y = Sketch.of(a), Sketch.of(b)
    assert x.resemblance(y) == jaccard(a, b)
    assert x.distinct() == len(shingle_set(a, 5))
    assert Sketch.decode(x.encode()).encode() == x.encode()


def test_estimates_and_merging():
    a = " ".join(f"w{i}" for i in range(6000))
    b = " ".join(f"w{i}" for i in range(3000, 9000))
    x, y = Sketch.of(a, k=256), Sketch.of(b, k=256)
    assert abs(x.resemblance(y) - jaccard(a, b)) < 0.12
    assert abs(x.containment(y) - 0.5) < 0.15
    assert abs(x.distinct() / 5996 - 1) < 0.25
    whole = x.merge(y)
    assert abs(whole.distinct() / 8996 - 1) < 0.25
    assert not whole.whole
    repeated = "x y z " * 5000
    assert Sketch.of(repeated).distinct() == 3


def brute(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text is not None, r.text or ""))
    out = []
    for i, r in enumerate(rows):
        text, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        out.append((r.doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), jaccard(text, edited), jaccard(text, nxt)))
    return out


def test_odd_documents(odd_docs, no_docs):
    got = fingerprints.compare_with_next(odd_docs).collect()
    want = brute(odd_docs.collect())
    key = lambda t: (t[0] is None, t[0] or 0, t[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    near = {(r.doc_id, r.edited_sha256): (r.near_edited, r.near_next) for r in got}
    for d, _, sha, e, n in want:
        assert abs(near[d, sha][0] - e) < 0.2 and abs(near[d, sha][1] - n) < 0.2
    assert fingerprints.compare_with_next(no_docs).count() == 0
    assert fingerprints.fingerprint(odd_docs).count() == odd_docs.count()


def test_one_document_is_its_own_next(spark):
    r = fingerprints.compare_with_next(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
