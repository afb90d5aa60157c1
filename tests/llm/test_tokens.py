import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fathomix.llm import packing, token_store
from fathomix.llm.tokens import WordEncoder, as_ids


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def test_encoder_is_the_library(tokenizer, library, odd_docs):
    code = WordEncoder(tokenizer, cache=50)
    for r in odd_docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert as_ids(code.encode(r.text)).tolist() == want


def test_plain_words_take_no_regular_expression(tokenizer, library, monkeypatch):
    code, seen = WordEncoder(tokenizer), []
    monkeypatch.setattr(code, "pattern", type("Pattern", (), {"findall": lambda self, s: seen.append(s) or WordEncoder(tokenizer).pattern.findall(s)})())
    words = ["plain", "Upper,", "end.***", "$$$", "ci\u00f3n;", "\u00aa\u00ba\u00b5\u00df.", "it's", "o'clock?", "a1.", "<|endoftext|>.", "a<|endoftext|>", "\u0130x.", "e\u0301.", ".a", "a.b.", "\u017f.", "\u00c5\u00c9!"]
    for w in words:
        assert as_ids(code.encode(w)).tolist() == library.encode(w, add_special_tokens=False).ids, w
    assert sorted(seen) == ["$$$", ".a", "a.b.", "a1.", "it's", "o'clock?"]


def test_perfect_hash_is_minimal_and_perfect():
    h = token_store.mix64(np.arange(20_000, dtype=np.uint64))
    p = token_store.PerfectHash.build(h)
    assert sorted(p.slots(h).tolist()) == list(range(20_000))
    assert len(token_store.PerfectHash.build(h[:0]).words) == 0


def test_store_round_trip(spark, tmp_path, tokenizer, library, odd_docs):
    uri = f"file://{tmp_path}/store"
    token_store.write_store(odd_docs, uri, tokenizer, shards=3)
    got = token_store.read_store(spark, uri).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    store = token_store.TokenStore(uri)
    assert store.get(1).tolist() == [1]
    assert store.get(5, 2).tolist() == [*library.encode("another text under the same id", add_special_tokens=False).ids, 1]
    assert store.get(None).tolist()[-1] == 1
    assert store.get(6) is None and store.get(5, 9) is None


def test_empty_store(spark, tmp_path, tokenizer, no_docs):
    uri = f"file://{tmp_path}/none"
    assert token_store.write_store(no_docs, uri, tokenizer, shards=2)["shards"] == []
    assert token_store.read_store(spark, uri).count() == 0


def _check(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_of_odd_documents(tokenizer, library, odd_docs):
    rows = packing.pack_documents(odd_docs, tokenizer, 64, 0, group_rows=40).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda t: tuple((v is not None, v) for v in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert _check(rows, 64) <= -(-sum(r.length for r in rows) // 64) + 1


def test_packing_of_nothing(tokenizer, no_docs):
    assert packing.pack_documents(no_docs, tokenizer).count() == 0


def test_local_search_empties_bins():
    # each bin is two thirds full; exchanging two for one makes three full bins of four
    bins = [[0, 1], [2, 3], [4, 5], [6]]
    sizes = [6, 2, 6, 2, 6, 2, 6]
    out = packing.local_search(bins, sizes, 10)
    assert sorted(i for b in out for i in b) == list(range(7))
    assert all(sum(sizes[i] for i in b) <= 10 for b in out)
    swap = packing.local_search([[0, 1], [2, 3], [4]], [5, 4, 5, 4, 2], 10)
    assert len(swap) == 2


def test_local_search_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 11, 8).tolist()

        def fits(k, sizes=sizes):
            room = [10] * k

            def place(i):
                if i == len(sizes):
                    return True
                for b in range(k):
                    if room[b] >= sizes[i]:
                        room[b] -= sizes[i]
                        if place(i + 1):
                            return True
                        room[b] += sizes[i]
                return False

            return place(0)

        best = next(k for k in range(1, 9) if fits(k))
        assert len(packing.pack_sizes(sizes, 10)) <= best + 1
