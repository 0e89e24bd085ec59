"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m characters shares at least m - q + 1 - k * q of the item's character q-grams, and
all of those lie on k + 1 neighbouring diagonals (place in the document minus place in the item). Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are verified by an alignment limited to their
diagonals. Text is compared in lower case with white space runs as one space. A document is contaminated by an item if it
holds the whole item with at most `rate` * m edits (fewer for items so short that the bound would fall under 1).

The benchmark goes to every executor in shards of at most `MOST_CHARS` characters; each shard is one pass over the whole
texts. Long texts are cut into overlapping segments, so a passage is never lost at a cut.

Null or empty text: never contaminated. Items shorter than q are matched exactly, as whole words; null and empty ones by
nothing. An empty benchmark leaves every document clean, an empty table gives an empty result. Repeated rows get equal
results, very long texts are searched whole. Of several items the fewest edits win, then the smallest id.
Extra columns pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintlake.llm.shared import only, with_fields

Q = 8
RATE = 0.1
#: Characters of the benchmark that one pass looks for.
MOST_CHARS = 8_000_000
#: Characters that are worked on at once.
SEGMENT = 1_000_000
TABLE_BITS = 21


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams that start at each character; Q is 8, by three doublings."""
    if len(c) < Q:
        return np.zeros(0, np.uint32)
    h = c * np.uint32(0x9E3779B1) + 1
    h = h[:-1] * np.uint32(0x85EBCA6B) + h[1:]
    h = h[:-2] * np.uint32(0xC2B2AE35) + h[2:]
    h = h[:-4] * np.uint32(0x27D4EB2F) + h[4:]
    h ^= h >> np.uint32(16)
    return h * np.uint32(0x2C1B3C6D)


@dataclass
class Index:
    ids: list[int]
    texts: list[str]
    edits: np.ndarray  # k by item
    needed: np.ndarray  # the lemma's bound by item
    step: np.ndarray  # half a band, in diagonals
    table: np.ndarray  # by the first bits of a hash: is there such a q-gram
    grams: np.ndarray  # distinct hashes, ascending
    starts: np.ndarray  # of each hash's places
    items: np.ndarray  # by place
    places: np.ndarray
    short: list[tuple[int, str]]  # items without a q-gram

    @property
    def reach(self) -> int:
        """Characters that one match and its bands may span."""
        return max((len(t) + int(k) + 2 * int(s) for t, k, s in zip(self.texts, self.edits, self.step, strict=True)), default=0) + Q


def build(items: list[tuple[int, str]], rate: float = RATE) -> Index:
    items = [(i, n) for i, t in sorted(items) if (n := normalize(t))]
    short = [(i, t) for i, t in items if len(t) < Q]
    items = [(i, t) for i, t in items if len(t) >= Q]
    m = np.array([len(t) for _, t in items], np.int64)
    edits = np.minimum(np.floor(rate * m + 1e-9).astype(np.int64), (m - Q) // Q) if len(items) else np.zeros(0, np.int64)
    hashes = [qgrams(codes(t)) for _, t in items]
    flat = np.concatenate(hashes) if items else np.zeros(0, np.uint32)
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if items else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    grams, starts = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, np.bool_)
    table[grams >> np.uint32(32 - TABLE_BITS)] = True
    return Index([i for i, _ in items], [t for _, t in items], edits, m - Q + 1 - edits * Q, np.maximum(edits + 1, 16), table, grams, np.append(starts, len(flat)), item[order], place[order], short)


def bands(index: Index, c: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of (segment, item, band) with enough shared q-grams. owner: the segment of each character; begin: where it starts."""
    h = qgrams(c)
    at = np.flatnonzero(index.table[h >> np.uint32(32 - TABLE_BITS)]) if len(index.grams) else np.zeros(0, np.int64)
    g = np.searchsorted(index.grams, h[at])
    real = index.grams[np.minimum(g, len(index.grams) - 1)] == h[at] if len(at) else np.zeros(0, bool)
    at, g = at[real], g[real]
    at, g = at[(same := owner[at] == owner[at + Q - 1])], g[same]
    n = index.starts[g + 1] - index.starts[g]
    if not n.sum():
        return np.zeros((0, 3), np.int64)
    hit = np.repeat(np.arange(len(at)), n)
    where = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.starts[g], n)
    item, segment = index.items[where], owner[at[hit]].astype(np.int64)
    diagonal = at[hit] - begin[segment] - index.places[where]
    band = diagonal // index.step[item]
    low = 1 << 32
    key = (segment * len(index.ids) + item) * (1 << 33) + band + low
    key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # a diagonal lies in two bands
    pair, band = key >> 33, (key & ((1 << 33) - 1)) - low
    enough = count >= index.needed[pair % len(index.ids)]
    return np.stack((pair // len(index.ids), pair % len(index.ids), band), 1)[enough]


def align(items: list[np.ndarray], texts: list[np.ndarray], first: list[int], width: list[int], most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, the fewest edits that turn the whole item into a part of the text, on `width` diagonals from `first`, and where it ends.

    All pairs go on together, a character of their items at a time; a pair is left, with more than `most` edits, once all its cells exceed them.
    """
    n, w, m = len(items), max(width), np.array([len(i) for i in items])
    chars = np.zeros((n, int(m.max())), np.uint32)
    window = np.full((n, w + int(m.max())), 0xFFFFFFFF, np.uint32)
    for r in range(n):
        chars[r, : m[r]] = items[r]
        part = texts[r][max(0, first[r]) : max(0, first[r] + width[r] + int(m[r]))]
        window[r, max(0, -first[r]) : max(0, -first[r]) + len(part)] = part
    steps = np.arange(w, dtype=np.int32)
    limit = np.array(most)
    row = np.where(steps[None, :] < np.array(width)[:, None], 0, 1 << 20).astype(np.int32)
    edits, end = np.full(n, 1 << 20, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    for j in range(int(m.max())):
        change = row + (window[:, j : j + w] != chars[:, j : j + 1])
        np.minimum(change[:, :-1], row[:, 1:] + 1, out=change[:, :-1])
        row = np.minimum.accumulate(change - steps, axis=1) + steps
        over = m[live] == j + 1
        gone = row.min(1) > limit[live] if j % 16 == 15 else np.zeros(len(live), bool)
        for r in np.flatnonzero(over).tolist():
            best = int(np.argmin(row[r]))
            edits[live[r]], end[live[r]] = row[r, best], best
        if (stay := ~(over | gone)).all():
            continue
        row, window, chars, live = row[stay], window[stay], chars[stay], live[stay]
        if not len(live):
            break
    return edits, np.minimum(np.array(first) + end + m, [len(t) for t in texts])


def matches(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, end in the normalized text) of every contamination; a text and item may come more than once."""
    overlap = index.reach
    segments = [(i, a, t[a : a + SEGMENT + overlap]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
    k = 0
    while k < len(segments):
        size, group = 0, []
        while k < len(segments) and (not group or size + len(segments[k][2]) <= SEGMENT):
            group.append(segments[k])
            size += len(segments[k][2])
            k += 1
        c = codes("".join(s for *_, s in group))
        lengths = np.array([len(s) for *_, s in group])
        owner = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
        begin = np.cumsum(lengths) - lengths
        done: set[tuple[int, int]] = set()
        open_: list[tuple[int, int, int]] = []
        for s, item, band in bands(index, c, owner, begin).tolist():
            if (s, item) in done:
                continue
            text, a, segment = group[s]
            if (p := segment.find(index.texts[item])) >= 0:
                done.add((s, item))
                yield text, item, 0, a + p + len(index.texts[item])
            else:
                open_.append((s, item, band * int(index.step[item])))
        for x in range(0, len(open_), 256):
            part = open_[x : x + 256]
            own = [i for _, i, _ in part]
            edits, end = align([codes(index.texts[i]) for i in own], [c[begin[s] : begin[s] + lengths[s]] for s, *_ in part], [f for *_, f in part], [2 * int(index.step[i]) for i in own], [int(index.edits[i]) for i in own])
            for (s, item, _), e, z in zip(part, edits.tolist(), end.tolist(), strict=True):
                if e <= index.edits[item]:
                    yield group[s][0], item, e, group[s][1] + z


def words(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(text, edits, item id, end) of the short items that stand in a text as whole words."""
    for i, t in enumerate(texts if index.short else ()):
        apart = f" {t} "
        for item, words_ in index.short:
            if (p := apart.find(f" {words_} ")) >= 0:
                yield i, 0, item, p + len(words_)


def shards(benchmark: DataFrame, rate: float, id_col: str, text_col: str, most: int = MOST_CHARS) -> Iterator[Index]:
    """Indexes of parts of the benchmark, none of more than `most` characters but for a single item."""
    part: list[tuple[int, str]] = []
    size = 0
    for row in only(benchmark, item_id=id_col, text=text_col).where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        if part and size + len(row.text) > most:
            yield build(part, rate)
            part, size = [], 0
        part.append((row.item_id, row.text))
        size += len(row.text)
    yield build(part, rate)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with contaminated, item_id, edits and end_char (in the normalized text) of the best match."""
    fields = (("contaminated", T.BooleanType()), ("item_id", T.LongType()), ("edits", T.IntegerType()), ("end_char", T.LongType()))
    for index in shards(benchmark, rate, id_col, item_text_col):
        docs = _pass(docs, index, fields, text_col)
    return docs


def _pass(docs: DataFrame, index: Index, fields: tuple, text_col: str) -> DataFrame:
    """One shard. What an earlier pass found stays unless this one finds better."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    again = all(n in docs.columns for n, _ in fields) and getattr(docs, "_shard", False)
    schema = with_fields(docs, *fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            best: list[tuple | None] = [None] * batch.num_rows
            if again:
                old = zip(*(batch.column(n).to_pylist() for n, _ in fields[1:]), strict=True)
                best = [None if i is None else (e, i, x) for i, e, x in old]
            texts = [normalize(t.as_py()) for t in batch.column(text_col)]
            for text, *found in [*((t, e, index.ids[i], z) for t, i, e, z in matches(index, texts)), *words(index, texts)]:
                if best[text] is None or tuple(found) < best[text]:
                    best[text] = tuple(found)
            made = [pa.array([b is not None for b in best]), *(pa.array([b and b[k] for b in best], kind) for k, kind in ((1, pa.int64()), (0, pa.int32()), (2, pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-4]), *made], names=names)

    out = docs.mapInArrow(run, schema)
    out._shard = True
    return out
