"""The whole pipeline on a small corpus, each stage against brute force on its own input."""

import random
import struct
import sys
from pathlib import Path

import pytest

pytest.importorskip("tintlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))

from test_secret_scan import brute, cut  # noqa: E402
from test_text_operators import brute_classes, edit_distance_within  # noqa: E402

from tintlake.llm import decontaminate, jaccard_join, packing  # noqa: E402
from tintlake.llm.queries import tokenizer  # noqa: E402

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, keep string, edits string, __in_1 int"


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: (" ".join(rng.choices(words, k=n)) + ".").capitalize()
    items = [(i, prose(18)) for i in range(5)]
    docs = [(i, prose(rng.choice([8, 40, 90]))) for i in range(60)]
    junk = [(100 + i, "BUY!! $$$ 777 " * rng.randint(15, 30)) for i in range(60)]
    extra = []
    for k in range(12):  # copies and near copies
        text = docs[k][1].split(" ")
        if k % 3:
            text[len(text) // 2] = "other"
        extra.append((200 + k, " ".join(text)))
    extra += [(220 + k, prose(20) + " " + items[k][1] + " " + prose(20)) for k in range(5)]
    edited = list(items[0][1])
    edited[10] = edited[50] = "#"
    extra += [(230, prose(15) + " " + "".join(edited) + prose(15))]
    extra += [(240, prose(20) + " password=hunter2222 user=bob " + "Ab3" * 12 + " " + prose(9)), (241, None), (242, ""), (None, docs[3][1]), (None, prose(30)), (243, prose(3000)), (7, docs[7][1]), (8, prose(50))]
    labels = [*((i, 1, 0) for i, _ in docs), *((i, 0, 0) for i, _ in junk)]
    return [*docs, *junk, *extra], items, labels


def as_rows(df):
    return sorted(((r.doc_id, r.text, r.keep, r.edits) for r in df.collect()), key=str)


def write(spark, folder, docs, items, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "e", 1) for i, t in docs], FIELDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    folder = f"file://{tmp_path}"
    write(spark, folder, docs, items, labels)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns

    def stage(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/stage{k}")
        return spark.read.parquet(f"{folder}/stage{k}")

    # what is rated low goes, and nothing else
    one = stage(0, df)
    assert as_rows(one) == sorted([(i, t, "k", "e") for i, t in docs if not (i is not None and 100 <= i < 200)], key=str)
    # one document of each class
    sim = jaccard_join.Similarity(5, 80, 100)
    two, rows = stage(1, one), as_rows(one)
    known = [(n, r[1]) for n, r in enumerate(rows)]
    component = {n: c for n, (_, c) in brute_classes(known, sim).items()}
    least = {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            least[component[n]] = min(least.get(component[n], r[0]), r[0])
    gone = {i for i in {r[0] for r in rows} - {None} if all(least[component[n]] < i for n, r in enumerate(rows) if r[0] == i)}
    assert as_rows(two) == [r for r in rows if r[0] not in gone] and len(gone) >= 5
    # documents that hold an item
    three, rows = stage(2, two), as_rows(two)
    index = decontaminate.build(items)

    def clean(text):
        text = decontaminate.normalize(text)
        return not any(edit_distance_within(x, text) <= k for x, k in zip(index.texts, index.edits))

    assert as_rows(three) == [r for r in rows if clean(r[1])] and len(rows) - three.count() == 6
    # secrets
    four, rows = stage(3, three), as_rows(three)
    assert as_rows(four) == sorted([(i, cut(t, brute(t)[1]), a, b) for i, t, a, b in rows], key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in four.collect())
    # all ids of all documents, gapless
    packed = corpus_pipeline.STAGES[4][1](spark, four, folder).collect()
    held_against_library(packed, as_rows(four))
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def held_against_library(packed, rows):
    library = packing.ids_of(tokenizer()).tokenizer
    pieces, sequences = {}, {}
    for r in packed:
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY
    want = {}
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.CLOSING_ID]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want.setdefault(i, []).append((k // packing.CAPACITY, k, struct.pack(f"<{len(part)}I", *part)))
    assert {i: sorted(map(str, p)) for i, p in pieces.items()} == {i: sorted(map(str, p)) for i, p in want.items()}
    total = sum(r.length for r in packed)
    assert -(-total // packing.CAPACITY) <= len(sequences) <= -(-total // packing.CAPACITY) + 1


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
