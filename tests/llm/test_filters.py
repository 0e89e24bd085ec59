"""URL filters and decontamination at their edges, and the join's cells on real documents."""

import random

import pytest

pytest.importorskip("tintlake.llm")

from tintlake.llm import decontaminate, jaccard_join, url_filter  # noqa: E402
from tintlake.llm.shared import only  # noqa: E402


def test_long_hosts_make_few_candidates():
    array = url_filter.DigestArray(url_filter.encode_rules([("com/en/", "block"), ("example.com/en/7", "allow"), ("é.org/", "block")]))
    host = "a." * 50_000 + "example.com"
    found = sorted(url_filter.candidates(host, "/en/7" + "x" * 1000, array.hosts, array.lengths))
    assert found == sorted(h + p for h in (b"com", b"example.com") for p in (b"/", b"/en/", b"/en/7"))
    assert b"example.com/en/7" in list(url_filter.candidates(host, "/en/7x", array.hosts, array.lengths))
    assert "é.org/".encode() in list(url_filter.candidates("xé.é.org", "/", array.hosts, array.lengths))
    assert "é.org/".encode() not in list(url_filter.candidates("xé.org", "/", array.hosts, array.lengths))


def test_url_rules_equal_plain_search(spark):
    rng = random.Random(2)
    names = ["com", "a.com", "b.a.com", "net", "x.net", "com.net"]
    rules = [(f"{rng.choice(names)}/{rng.choice(['', 'en/', 'en/7', 'de', 'é'])}", rng.choice(["allow", "block"])) for _ in range(30)]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(['', 'w.', 'A.'])}{rng.choice(names)}{rng.choice(['', '/', '/en/7x', '/de?x', '/é/', '#f'])}" for _ in range(300)] + [None, "", "x"]

    def judge(url):
        host, path = url_filter.split_url(url)
        best = None
        for rule, verdict in rules:
            h, _, p = rule.partition("/")
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                if best is None or len(rule.encode()) > len(best[0].encode()) or rule == best[0] and verdict == "allow":
                    best = (rule, verdict)
        return best or (None, "allow")

    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rule, verdict = judge(u)
        assert got[i][1] == verdict or rule is not None and len(got[i][0].encode()) == len(rule.encode())
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_short_items_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "Tiny"), (2, "one two"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a TINY  thing"), (2, "tinyish"), (3, "so one\ntwo"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: None, 5: None}
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []


def test_shards_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    items = [(i, prose(20)) for i in range(6)]
    docs = []
    for i in range(24):
        passage = list(items[i % 6][1])
        for _ in range(i % 5):
            passage[rng.randrange(len(passage))] = "#"
        docs.append((i, prose(10) + " " + "".join(passage) + " " + prose(10) if i % 3 else prose(40)))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.decontaminate(docs, items).collect()))
    assert any(r[3] is not None and r[4] for r in one)  # some by alignment
    monkeypatch.setattr(decontaminate.shards, "__defaults__", (300,))
    assert len(list(decontaminate.shards(items, 0.1, "item_id", "text"))) > 2
    assert sorted(map(tuple, decontaminate.decontaminate(docs, items).collect())) == one


def test_cells_and_boundary_copies_on_documents(spark):
    docs = only(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), doc_id="doc_id", text="text")
    sim = jaccard_join.Similarity(5, 80, 100)
    pairs = jaccard_join.slice_pivots(docs, sim, jaccard_join.frequent(docs, sim)).collect()
    members = {r.sid for r in pairs}
    assert len({r.pivot for r in pairs}) > 10 and len(pairs) > len(members)  # sets in more cells than their home
