import zlib

import pytest
from pyspark.sql import functions as F

from fathomix.llm import decontaminate, langid, licenses, queries, url_filter
from oracle import DATA, connect, same

SF = f"{DATA}/sf0.001"
ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours. How far does the train from Paris go in 5 hours if it keeps its speed"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(queries.SQL[name]).df())


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    j = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert j.filter("lang_pred = lang").count() >= 0.98 * j.count()


def test_language_of_odd_documents(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0.0 <= r.score <= 1.0
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == by[2] == by[3] == by[8] == "und"
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_and_short_blocks_bundle_alike():
    import numpy as np

    t = "the quick brown fox " * 50
    a = langid._bundle(np.zeros(len(langid.trigrams(t)), np.int64), langid.trigrams(t), 1, 64, 7)
    codes, n = np.unique(langid.trigrams(t), return_counts=True)
    assert (a[0] == n @ langid.trigram_vectors(codes, 64, 7).astype(int)).all()


def hits(spark, texts, items, **o):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, **o).collect()}


def test_reparameterised_question_is_found(spark):
    other = ITEM.replace("Paris", "Lyon").replace("120", "300").replace("9", "7")
    wild = other.replace("from Lyon", "from Rome")  # one name stands for two
    got = hits(spark, [f"Some words before this. {ITEM}. And after", f"Before. {other}", "nothing of the kind here at all", wild], [ITEM])
    assert set(got) >= {(0, 0), (1, 0)} and (2, 0) not in got
    assert got[0, 0].verbatim and not got[1, 0].verbatim
    assert (3, 0) not in got or got[3, 0].coverage < got[1, 0].coverage


def test_verbatim_copies_are_found_whatever_their_slots(spark):
    items = ["John Smith met Mary Jones in Paris", "12 + 30 = 42 and 7 * 6 = 42", "WHO WROTE THE SONG OF THE SEA AND WHEN WAS IT SUNG", "What Is Love", "Rome"]
    docs = [f"We read that {x} once more" for x in items]
    docs += ["We read that John Smith met Mary Baker in Paris", "12 + 31 = 43 and 8 * 6 = 48", "What was love in rose"]
    got = hits(spark, docs, items)
    assert set(got) == {(i, i) for i in range(5)}
    assert all(r.coverage == 1.0 and r.verbatim for r in got.values())
    assert got[2, 2].longest_run == 12


def test_one_changed_value_leaves_the_other_windows(spark):
    tail = "while the old mill by the river was grinding corn for every one of the farmers around, and their children used to play under the big tree until it was dark"
    long = f"She kept 3 apples in the basket {tail} on all of these 3 days of the feast in that summer"
    short = "take all 3 apples from the basket and then wait for them to ripen until 3 days are over and done"
    got = hits(spark, [f"Yes. {long.replace('3 days', '7 days')}", short.replace("3 apples", "4 apples").replace("3 days", "7 days")], [long, short])
    assert set(got) == {(0, 0), (1, 1)}
    assert got[0, 0].longest_run >= 30 and 0.7 < got[0, 0].coverage < 1 and not got[0, 0].verbatim
    assert 0.4 < got[1, 1].coverage < 1 and not got[1, 1].verbatim


def test_names_and_units_as_slots(spark):
    question = "{a} has {n} apples and {b} gives {a} {m} more apples. {b} then walks {k} km to {c}. How far is it from {c} to the house of {a}?"
    item = question.format(a="Alice", b="Bob", c="New York", n=5, m=3, k=120)
    same = question.format(a="Maria", b="Peter", c="Rome", n=7, m=2, k=40)
    glued = question.format(a="Maria", b="Peter", c="San Jose", n=7, m=2, k=40).replace("40 km", "40km")
    one = question.format(a="Maria", b="Maria", c="Rome", n=7, m=2, k=40)  # two people became one
    got = hits(spark, [same, f"Look here. {glued} Thanks", one, item], [item])
    assert {(0, 0), (1, 0), (3, 0)} <= set(got)
    assert got[0, 0].coverage == got[1, 0].coverage == got[3, 0].coverage == 1.0
    assert got[3, 0].verbatim and not got[0, 0].verbatim
    assert (2, 0) not in got or got[2, 0].coverage < 0.8


def test_repeats_do_not_multiply(spark):
    import time

    hits(spark, ["a b c d e f g h"], ["a b c d e f g h"])
    began = time.perf_counter()
    got = hits(spark, ["go " * 20_000, "to and fro " * 7000], ["go " * 500, "to and fro " * 150])
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0].longest_run == 500 and got[1, 1].coverage == 1.0
    assert time.perf_counter() - began < 60


def test_generated_questions_against_a_plain_matcher(spark):
    """Re-parameterised questions: a document that has an item's words with other values, one for
    one, is found; one with a word changed in every window isn't."""
    import random

    rng = random.Random(5)
    verbs = "carries buys sells brings takes finds keeps makes".split()
    things = "baskets of red pears|boxes of old books|bags of fine sand|crates of green tea".split("|")
    items, docs, want = [], [], set()
    for i in range(12):
        v, t, u = rng.choice(verbs), rng.choice(things), rng.choice(verbs)
        q = "In the morning {a} " + v + " {n} " + t + " to the market while {b} " + u + " {m} of them for the long way home with {a}"
        own = rng.sample("Anna Boris Clara David Elena Felix".split(), 4)
        items.append(f"q{i} " + q.format(a=own[0], b=own[1], n=rng.randrange(2, 50), m=rng.randrange(50, 90)))
        docs.append(f"q{i} " + q.format(a=own[2], b=own[3], n=rng.randrange(100, 150), m=rng.randrange(150, 190)))
        want.add((2 * i, i))
        docs.append(" ".join(w if k % 4 else f"x{k}" for k, w in enumerate(docs[-1].split())))
    got = hits(spark, docs, items, coverage=0.9, run=99)
    assert {k for k in got if k[0] % 2 == 0 and k[0] // 2 == k[1]} == want and not any(d % 2 for d, _ in got)


def test_decontamination_edges(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, ITEM), (4, "word word word word word")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, items).collect()} == {(7, 4)}
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, items).count() == odd_docs.count() - 1
    a, b = hits(spark, [ITEM, ITEM], [ITEM, ITEM]), hits(spark, [ITEM], [ITEM], small_rows=0)
    assert len(a) == 4 and len(b) == 1


def test_decontamination_against_plain_search(spark):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet").collect() for n in ("documents", "benchmark"))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = decontaminate.contaminated(*(spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_urls(spark):
    urls = ["http://EXAMPLE.com/en/71?x", "https://a.example.com/en/8", "http://notexample.net/de/8", "http://example.net/de/8#f", "ftp://x.org/es/", None, "no scheme/en/", "http://", "http://org/es/1", "https://casino-win.test/free"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string").drop("host")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.UrlModel.train()).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("example.com", "/en/71", "example.com/en/7"), ("a.example.com", "/en/8", "com/en/"), ("notexample.net", "/de/8", "net/de/"), ("example.net", "/de/8", "example.net/de/8"),
        ("x.org", "/es/", "org/es/"), ("", "", None), ("", "", None), ("", "", None), ("org", "/es/1", "org/es/"),
    ]
    assert (got[0].verdict, got[1].verdict, got[3].verdict, got[9].verdict) == ("allow", "block", "block", "block")
    assert url_filter.judge(df.limit(0), url_filter.UrlModel.train()).count() == 0


def test_url_model_from_a_table_is_the_same(spark):
    table = spark.createDataFrame(url_filter.LABELLED, "url string, label int")
    a, b = url_filter.UrlModel.train(table), url_filter.UrlModel.train()
    assert (a.weights, a.intercept) == (b.weights, b.intercept)


def test_licenses(spark, odd_docs, no_docs):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ;")
    df = spark.createDataFrame([(1, changed), (2, mit + " and more"), (3, None), (4, "copyright me"), (5, mit)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(df).collect()} == {1: "MIT", 2: None, 3: None, 4: None, 5: "MIT"}
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


def test_usual_license_files(spark):
    import textwrap

    texts = {n: t for n, t in reversed(licenses.KNOWN) if "\n" in t}
    texts = {n: next(t for m, t in licenses.KNOWN if m == n) for n in texts}
    wrapped = [(n, "\n".join(textwrap.fill(x, w) for x in texts[n].split("\n"))) for n in texts for w in range(40, 100)]
    isc = texts["ISC"].replace("that the above copyright notice", "that the above\ncopyright  notice")
    files = [*wrapped, ("ISC", isc), ("ISC", f"ISC License\n\nCopyright 2020 Someone\n\n{isc}"), ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020\n\n{texts['MIT']}")]
    heads = ["Copyright (c) 2020, A", "copyright © B", "# Copyright: C", "Copyright 1999-2001 D", "Copyright The Authors", "Copyright Nota Inc", "Copyright by E", "Copyright Éa"]
    files += [("BSD-3-Clause", f"{h}\nAll rights reserved.\n\n{texts['BSD-3-Clause']}") for h in heads]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(files))] == [n for n, _ in files]


def test_neighbouring_spellings_and_lettered_clauses(spark):
    texts = ["licence licence organisation licence", "license license organization license", "the copyright holder copyright holder", "the copyright owner copyright owner",
             "(a) keep this\n(c) You must retain the notices\n", "(a) keep this\n", "(a) keep this\n(c) 2020 Someone\n(c) Someone, 2019-2021\n", "Terms. All rights reserved. More terms",
             "All rights reserved. More terms", "More terms"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = {r.doc_id: r.digest for r in licenses.scan(df).collect()}
    assert d[0] == d[1] and d[2] == d[3] and d[4] != d[5] and d[5] == d[6] and d[8] == d[9] and d[7] != d[9]


def test_whole_licenses_of_the_system(spark):
    """Long licences, as they are and wrapped anew, if this machine has their texts."""
    import os
    import re
    import textwrap

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    files = [(n, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for f, n in names.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    if not files:
        pytest.skip("no licence texts here")

    def wrapped(t, w):  # lines that name a copyright stay lines of their own
        parts = re.split(r"(?im)(^[ \t]*(?:copyright|\(c\)).*$)", t)
        return "\n".join(x if i % 2 else "\n".join(textwrap.fill(p, w, break_on_hyphens=False) for p in re.split(r"\n\s*\n", x)) for i, x in enumerate(parts))

    rows = [(n, v) for n, t in files for v in (t, wrapped(t, 72), wrapped(re.sub(r"\bLICENSE\b", "LICENCE", t.upper()), 100))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_native_plans_run_no_python(spark):
    for name in ("op8_url_filter", "op10_license_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
