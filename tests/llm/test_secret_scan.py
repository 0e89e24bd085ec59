"""Secret scans against plain regular expressions and sets of places."""

import hashlib
import random
import re
import time

import pytest

pytest.importorskip("tintlake.llm")

from tintlake.llm import secret_scan as ss  # noqa: E402

RX = {k: re.compile(p, re.A) for k, p in ss.PATTERN.items()}


def brute(text):
    """All parts, and those to report, as (start, kind, end, start of the value)."""
    text = text or ""
    parts = []
    for k, kind in enumerate(ss.KINDS):
        for m in RX[kind].finditer(text):
            if kind == "assign" and len(m[2]) < ss.VALUE or kind == "opaque" and not all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                continue
            parts.append((m.start(), k, m.end(), m.start(2) if kind == "assign" else m.start()))
    base = [p for p in parts if p[1] < 3]
    out = list(base)
    for p in parts:
        kind = ss.KINDS[p[1]]
        if kind in ss.NEEDS and not any(b[0] < p[2] and p[0] < b[2] for b in base):
            others = [q for q in parts if ss.ROLE[ss.KINDS[q[1]]] in ss.NEEDS[kind]]
            if any(p[0] - ss.SCOPE <= q[2] <= p[0] or p[2] <= q[0] <= p[2] + ss.SCOPE for q in others):
                out.append(p)
    return base, sorted(out)


def said(spans):
    return ",".join(f"{ss.KINDS[k]}:{a}:{z}" for a, k, z, _ in sorted(spans))


def cut(text, spans):
    """Marks for all places that a span covers."""
    if text is None:
        return None
    gone = [False] * len(text)
    for _, _, z, value in spans:
        gone[value:z] = [True] * (z - value)
    out = []
    for i, c in enumerate(text):
        if not gone[i]:
            out.append(c)
        elif not i or not gone[i - 1]:
            out.append(ss.MARK)
    return "".join(out)


def random_text(rng):
    words = ["password=hunter22", "token: 'abc'", "AKIA" + "Z9" * 9, "AKIAX", "0af3" * 7, "user=bob", "login: root7", "Ab3" * 11, "Ab-1_" * 8 + "=", "https://h.example.com/p", "jdbc:mysql://db/x?password=abcdefgh", "s3://bucket/" + "Qq1" * 12, "plain", "wörds 😀", "=", ":", "secret", "api_key=" + "deadbeef" * 3, "x" * 90]
    return "".join(rng.choice(words) + rng.choice(["", " ", "\n", " , ", "=", " " * 60]) for _ in range(rng.randint(0, 25)))


def held_against_brute(spark, texts):
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, weak int")
    got = {r.doc_id: r for r in ss.scan(docs).collect()}
    assert len(got) == len(texts)
    cleaned = {r.doc_id: r for r in ss.redact(docs).collect()}
    for i, t in enumerate(texts):
        base, spans = brute(t)
        assert got[i].spans == said(spans), t
        assert got[i].base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ss.BASE] == [sum(b[1] == k for b in base) for k in range(3)]
        assert cleaned[i].text == cut(t, spans) and (cleaned[i].base, cleaned[i].weak) == ("e", 1)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(300)]
    held_against_brute(spark, [*texts, *texts[:5], None, ""])


def test_overlapping_spans_lose_no_other_text(spark):
    text = "see https://h.example.com/" + "aB3" * 12 + " password=abcdefgh and more text that is quite ordinary here"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ss.redact(docs).first().text == "see [REDACTED] password=[REDACTED] and more text that is quite ordinary here"
    held_against_brute(spark, [text])


def test_no_string_is_its_own_complement(spark):
    docs = spark.createDataFrame([(1, "see https://h.example.com/" + "aB3" * 12 + " end")], "doc_id long, text string")
    assert ss.scan(docs).first().spans == "" and ss.redact(docs).first().text.startswith("see https")


def test_very_long_texts(spark):
    chain = "http" + ":a" * 500_000 + "://y"  # a million code points in one repeated group
    dense = "password=abcdefgh user=bob " * 3000 + "Ab1" * 12
    began = time.time()
    rows = {r.doc_id: r for r in ss.scan(spark.createDataFrame([(1, chain), (2, dense), (3, "é" * 500_000 + " user=bob " + "Ab1" * 12)], "doc_id long, text string")).collect()}
    assert rows[1].spans == "" and rows[2].n_assign == 3000
    assert rows[2].spans.count("account") == 3000 and rows[3].spans == "account:500001:500009,opaque:500010:500046"
    text = ss.redact(spark.createDataFrame([(2, dense)], "doc_id long, text string")).first().text
    assert text == "password=[REDACTED] [REDACTED] " * 3000 + "[REDACTED]"
    assert time.time() - began < 90


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "password=abcdefgh", 1, "k"), (None, None, 2, "k")], "doc_id long, text string, cuts int, key string")
    assert ss.scan(docs.limit(0)).collect() == [] and ss.redact(docs.limit(0)).collect() == []
    assert sorted(map(tuple, ss.redact(docs).collect()), key=str) == sorted([(None, "password=[REDACTED]", 1, "k"), (None, None, 2, "k")], key=str)
    assert {r.n_assign for r in ss.scan(docs).collect()} == {0, 1}
