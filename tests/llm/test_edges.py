"""Empty tables, clashing columns, repeated rows and very long texts, for each operator that has no test of its own for them."""

import hashlib

import pytest

pytest.importorskip("tintlake.llm")

from tintlake.llm import packing, progressive, quality, toxicity, warc  # noqa: E402
from tintlake.llm.queries import tokenizer  # noqa: E402

LONG = "word and other words, " * 50_000  # a megabyte


def docs_of(spark):
    """Columns named like results and inner names of the operators."""
    rows = [(1, LONG, "x"), (2, "short text", "y"), (2, "short text", "z"), (None, None, None), (3, "", "w")]
    return spark.createDataFrame([(i, t, e, e, e, e, 1.0) for i, t, e in rows], "doc_id long, text string, ids string, label string, media string, sid string, score double")


def test_progressive(spark):
    docs = docs_of(spark)
    got = sorted(progressive.load(progressive.store(docs)).select("doc_id", "n_bytes", "payload_sha256").collect(), key=str)
    assert len(got) == 5 and [r.n_bytes for r in got if r.doc_id == 1] == [len(LONG)]
    padded = LONG.encode() + b" " * (192 - len(LONG) % 192)
    assert next(r for r in got if r.doc_id == 1).payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert progressive.load(progressive.store(docs.limit(0))).collect() == []


def test_toxicity_and_quality(spark):
    docs = docs_of(spark)
    labels = spark.createDataFrame([(1, 1, 0, "t"), (2, 0, 1, "t"), (2, 0, 1, "t"), (None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 2}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
    rated = quality.score(docs, quality.fit(docs, labels))
    assert rated.count() == 5 and set(docs.columns) <= set(rated.columns)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_packing(spark):
    docs = docs_of(spark)
    got = packing.packed(docs, tokenizer(), keep_ids=True).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(packing.ids_of(tokenizer()).text(LONG)) // 4 + 1
    assert all(len(r.ids) == 4 * r.length for r in got) and sum(r.doc_id == 2 for r in got) == 2


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", LONG, "k", 1), (2, "http://a.com/", LONG, "k", 1), (2, "http://a.com/", LONG, "k", 1)], "page_id long, url string, html string, digest string, payload int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_captures(warc.build_index(warc.write_archives(pages)), keep_payload=False).collect())
    assert got == [(1, len(LONG), "response", None), (2, len(LONG), "revisit", 1), (2, len(LONG), "revisit", 1)]


def test_viterbi_equals_enumeration():
    """On short tokens with one reading of each sign the search finds the cheapest letters of all."""
    import itertools

    import numpy as np

    counts = np.zeros((28, 28, 28))
    for word in ["bad", "dab", "sod", "ass"] * 9:
        s = [0, 0, *(toxicity.symbol(c) for c in word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    model = toxicity.CharacterModel(counts.reshape(-1))

    def cost(letters):
        s = [0, 0, *(toxicity.symbol(c) for c in letters), 0]
        return sum(model.cost[a][b][c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("b4d", "d4b", "5od", "s0d", "4ss", "b4b"):  # no letter twice once read, none at the end is a sign
        readings = [[(x, toxicity.COST_SWAP) for x in toxicity.LOOKS_LIKE.get(c, "")] + [(c, 0.0 if c.isalpha() else toxicity.COST_KEEP_SIGN)] for c in token]
        best = min((sum(p for _, p in r) + cost([x for x, _ in r]), "".join(x for x, _ in r)) for r in itertools.product(*readings))
        found = model.restore(token)
        assert found == best[1] or len(found) < len(token)  # a repeat may stand for nothing, at its own cost
