import hashlib

import pytest

from fathomix.llm import html_diff, warc

PAGES = "page_id long, url string, html string, shard string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 200 + "</p>", "<p>é" + "y" * 300
    rows = [(4, "http://a/1", big), (2, "http://a/2", big), (9, "http://b/1", big), (3, "u", "tiny"), (1, "u", "tiny"), (7, None, None), (8, "http://a/3", other), (None, "http://a/4", other), (2, "http://a/2", big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def test_revisits(spark, tmp_path, pages):
    got = warc.deduplicate(pages, f"file://{tmp_path}/w").collect()
    assert len(got) == pages.count()
    want = sorted((r.page_id is None, r.page_id or 0, len((r.html or "").encode()), hashlib.sha256((r.html or "").encode()).hexdigest()) for r in pages.collect())
    assert sorted((g.page_id is None, g.page_id or 0, g.payload_bytes, g.payload_digest) for g in got) == want
    kinds = sorted((g.page_id is None, g.page_id or 0, g.record_type, g.refers_to) for g in got)
    assert kinds == sorted([(False, 4, "revisit", 2), (False, 2, "response", None), (False, 2, "revisit", 2), (False, 9, "revisit", 2), (False, 3, "response", None), (False, 1, "response", None), (False, 7, "response", None), (False, 8, "response", None), (True, 0, "revisit", 8)], key=lambda t: (t[0], t[1], t[2]))
    ids = {g.record_id for g in got if g.record_type == "response"}
    assert all(g.refers_to_record in ids for g in got if g.record_type == "revisit")
    assert len({g.record_id for g in got}) == len(got)


def test_no_pages(tmp_path, pages):
    assert warc.deduplicate(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    assert html_diff.extract(pages.limit(0)).count() == 0


def test_record_round_trip():
    raw = warc.record("response", "5", "http://x/\r\n", "d", b"a\r\n\r\nb", "p", "2024-01-01T00:00:00Z")
    head, payload = warc.parse(raw)
    assert payload == b"a\r\n\r\nb" and head["X-Page-ID"] == "5"


@pytest.mark.parametrize("html, want", [
    ("<article><h1>T</h1><p>a &amp; b\n  c<p>d</article><p>out", ["T", "a & b c", "d"]),
    ("<nav>m</nav><div class='cookie-notice'>c</div><p>x</p><footer>f</footer>", ["x"]),
    ("<article><header><h1>T</h1></header><p>x</p><div id='comments'><p>c</div><footer>f</footer><p>y</article>", ["T", "x", "y"]),
    ("<script>var a='</p>';</script><p>x<br>y</p><style>p{}</style><!-- <p>no --><form>f</form>", ["x y"]),
    ("<div hidden>h</div><p style='display:none'>h</p><p>x", ["x"]),
    ("plain &lt;text&gt;", ["plain <text>"]), ("", []), (None, []), ("<article>", []), ("<p>a<script>never ends", ["a"]),
    ("<header><h1>Site</h1></header><main><p>x</main>", ["x"]),
])
def test_blocks(html, want):
    own = html_diff.blocks(html)
    assert html_diff.prune([t for _, t in own], [z for z, _ in own], None) == want


def test_longest_common_lines():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        shared = html_diff.common_lines(a, b)
        picked, it = [x for x, s in zip(a, shared) if s], iter(b)
        assert all(x in it for x in picked)
        assert len(picked) >= n[-1][-1] - 1  # trimming equal ends never costs, so this holds with equality
        assert len(picked) == n[-1][-1]


def test_neighbours_delete_template_lines(spark):
    page = lambda k: f"<p>Welcome to the site<p>Story number {k} is told here<p>All rights with us"
    rows = [(i, f"http://h.test/news/{i}", page(i)) for i in range(6)] + [(10, "http://other.test/news/1", page(3)), (11, None, "<p>alone")]
    got = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} is told here" for i in range(6))
    assert got[10].count("\n") == 2 and got[11] == "alone"


def test_copies_delete_nothing(spark):
    html = "<p>one<p>two<p>three"
    rows = [(i, "http://h.test/a", html) for i in range(4)]
    got = html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["one\ntwo\nthree"] * 4


def test_copies_are_compared_with_other_pages(spark):
    page = lambda k: f"<p>Menu one<p>Menu two<p>Menu three<p>Menu four<p>Menu five<p>Menu six<p>Story {k}<p>told by {k}<p>for {k}"
    rows = [(i, "http://h.test/a", page(0)) for i in range(5)] + [(9, "http://h.test/b", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_diff.extract(df).collect()}
    assert len(got) == 6 and all(got[i] == "Story 0\ntold by 0\nfor 0" for i in range(5)) and got[9] == "Story 1\ntold by 1\nfor 1"
    whole = {r.page_id: r.text for r in html_diff.extract(df, differencing=False).collect()}
    assert all(whole[k].startswith("Menu one") for k in whole)


def test_malformed_pages_take_linear_time():
    import time

    for html in ("<a " * 1_700_000, "<a '" * 1_250_000, "<div>" * 500_000 + "</b>" * 500_000, "<!" * 2_500_000, "<script></script" * 300_000, "</p><p class='" * 300_000, "<a b=\"c>" * 500_000):
        began = time.perf_counter()
        html_diff.blocks(html)
        assert time.perf_counter() - began < 15, html[:20]
    began = time.perf_counter()
    same = ["x"] * 20_000
    assert sum(html_diff.common_lines(same + ["y"] * 20_000, ["z"] + same + ["y"])) == 20_001
    assert time.perf_counter() - began < 10


def test_differencing_decides_outside_articles(spark):
    page = lambda k: f"<p>Welcome to the site<article><p>Teaser {k}<p>Quoted by all</article><p>Body {k} told here<p>More of {k}<p>All rights with us"
    rows = [(i, f"http://h.test/news/{i}", page(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser {i}\nQuoted by all\nBody {i} told here\nMore of {i}" for i in range(4)}


@pytest.mark.parametrize("page", [
    "<html><head><meta charset=utf-8><body><article><p>One two.<p>Three.</article>",
    "<html><head><title>T</title><script>x<y</script><article><p>One two.<p>Three.</article>",
    "<html><head><title>T<meta charset=utf-8></head><body><article><p>One two.<p>Three.</article>",
    "<html><head></head><body><select><option>a<option>b<article><p>One two.<p>Three.</article>",
    "<article><div class='share-price'>One two.</div><div id='search-engines' class=ad-hoc>Three.</div></article>",
    "<article><p class='notice-period'>One two.</p><div class='promo'>gone</div><p>Three.</p></article>",
])
def test_texts_of_careless_pages(page):
    assert [line for _, line in html_diff.blocks(page)] == ["One two.", "Three."]
