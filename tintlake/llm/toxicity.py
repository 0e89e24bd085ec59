"""Toxicity with noisy-channel deobfuscation.

Words that may be disguised (a digit or sign with a letter, letters or signs set apart, a letter twice) become character
lattices: each observed character may stand for itself, for a letter it resembles, or for nothing (a repeat, a separator, a
mark or number at the end), at a cost; characters set apart may hold breaks between words. A Viterbi search under a trigram character model finds the likeliest word, and the restored text is scored by a logistic
model over its distinct words and their beginnings, hashed.

The character model counts the trigrams of all texts. The logistic model learns from a bounded sample of labelled
documents (`SAMPLE`) outside the held-out fold: rows whose crc32(doc_id as text) mod 5 is 0 are never learned from. No
label, language, source or id enters a score.

Null or empty text: the score of a text without words. Very long texts and tokens are decoded whole; a lattice is searched
with a beam of `BEAM` states. An empty table gives an empty result. Null ids are held out (they have no labels). Null labels are left
out. Without any label, or with a single class, the score is that class's share (0 without any). Repeated rows get equal
scores. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.shared import blocks, only, per_row, utf8

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8000
FOLDS = 5
HASH_BITS = 18
#: A feature has a weight if it tells the classes apart by so much G-squared and is in so many labelled texts.
GAIN, SEEN = 6.0, 3
#: Bytes of tokens whose weights a worker remembers; what a token takes beside its characters.
REMEMBERED, ENTRY_BYTES = 16 << 20, 160

#: Letters that a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
#: Costs in nats.
COST_SWAP, COST_DROP, COST_KEEP_SIGN = 1.0, 0.7, 6.0
#: A letter that is written twice where nothing else is disguised; a number's further digits; a break between words.
COST_DOUBLE, COST_DIGIT, COST_BREAK = 3.0, 2.0, 2.0
#: States that are kept after a character, at most.
BEAM = 64

SYMBOLS = 28  # 0: outside words; 1-26: a-z; 27: other letters
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_GAP = np.zeros(256, np.bool_)
_GAP[list(b" .-_*")] = True
_LOOKS = np.zeros(256, np.bool_)
_LOOKS[list("".join(LOOKS_LIKE).encode())] = True

_SIGNS = re.escape("".join(LOOKS_LIKE))
#: Within a token that holds a letter: a sign or digit, or the same letter twice.
_DISGUISED = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1")
#: The same letter three times.
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: The part of a token that may be a word: from its first letter or sign to its last letter and the signs after it, unless
#: these belong to a number with other digits.
_CORE = re.compile(rf"(?=[^\W_]|[{_SIGNS}]).*[^\W\d_](?:[{_SIGNS}]++(?!\d))?")
#: Four letters or signs or more set apart; one is a letter.
_UNIT = rf"(?:[^\W\d_]|[{_SIGNS}])"
_APART = re.compile(rf"(?<!\w){_UNIT}(?:[ .\-_*]+{_UNIT}){{3,}}(?!\w)")
_LETTER = re.compile(r"[^\W\d_]")
_TAIL = re.compile(rf"[{_SIGNS}]*\Z")
_PIECE = re.compile(r"([ .\-_*]*)([^ .\-_*])")
_WORD = re.compile(r"[^\W\d_]+")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class CharacterModel:
    """Log probabilities of a symbol after two others, with add-a-half smoothing."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float) + 0.5
        self.cost = (-np.log(c / c.sum(2, keepdims=True))).tolist()

    def restore(self, token: str) -> str:
        """The likeliest letters behind a token; the token itself if they are not likelier than it. Signs at the end may be none."""
        tail = _TAIL.search(token).start()
        plain = [0.0] * (len(token) + 1)  # the cost of the rest as what it is: a number, or marks
        for i in range(len(token) - 1, tail - 1, -1):
            c = token[i]
            marks = c == "!" or c * 3 in token[max(tail, i - 2) : i + 3]  # the same sign three times is none in disguise
            plain[i] = plain[i + 1] + (COST_DROP if marks else COST_KEEP_SIGN if not c.isdigit() or i == tail else COST_DIGIT)
        # signs or a letter three times are a disguise for sure, two letters alike are mostly none
        sure = any(c in LOOKS_LIKE for c in token) or _THRICE.search(token)
        return self._best([(c, None) for c in token], COST_DROP if sure else COST_DOUBLE, {i: plain[i] for i in range(tail, len(token))} if tail else {}, token)

    def restore_apart(self, run: str) -> str:
        """The words behind characters set apart. Where gaps differ, the wide ones are likelier between words."""
        pieces = _PIECE.findall(run)
        gaps = [g for g, _ in pieces[1:]]
        least, common = min(map(len, gaps)), Counter(gaps).most_common(1)[0][0]
        wide = [len(g) > least or (" " in g and " " not in common) for g in gaps]
        breaks = [None, *((0.0, COST_BREAK) if w else (COST_BREAK, 0.0) for w in wide)]
        return self._best([(c, b) for (_, c), b in zip(pieces, breaks, strict=True)], COST_DROP, {}, run)

    def _best(self, observed: list[tuple[str, tuple[float, float] | None]], drop: float, ends: dict[int, float], otherwise: str) -> str:
        """observed: each character, and what a break and no break before it cost. ends: costs of leaving out all from a place on."""
        costs = self.cost
        # by the last two symbols and the last letter: the cost and the letters made, as a chain
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        found: list[tuple[float, tuple | None]] = []
        for i, (c, gap) in enumerate(observed):
            if i in ends:
                found += [(cost + costs[a][b][0] + ends[i], made) for (a, b, _), (cost, made) in states.items()]
            if gap is not None:
                split, whole = gap
                apart = {k: (cost + whole, made) for k, (cost, made) in states.items()}
                for (a, b, _), (cost, made) in states.items():
                    key, total = (b, 0, ""), cost + split + costs[a][b][0]
                    if key not in apart or total < apart[key][0]:
                        apart[key] = (total, (made, " "))
                states = apart
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            options = [(x, COST_SWAP) for x in LOOKS_LIKE.get(c, "")] + [(c, 0.0 if c.isalpha() else COST_KEEP_SIGN)]
            for (a, b, last), (cost, made) in states.items():
                for x, price in options:
                    s = symbol(x)
                    key, total = (b, s, x), cost + price + costs[a][b][s]
                    if key not in after or total < after[key][0]:
                        after[key] = (total, (made, x))
                    if x == last:  # a repeat stands for nothing
                        key, total = (a, b, last), cost + price + drop
                        if key not in after or total < after[key][0]:
                            after[key] = (total, made)
            states = after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda kv: kv[1][0])[:BEAM])
        found += [(cost + costs[a][b][0], made) for (a, b, _), (cost, made) in states.items()]
        made = min(found, key=lambda f: f[0], default=(0.0, None))[1]
        if made is None:
            return otherwise
        letters = []
        while made is not None:
            made, x = made
            letters.append(x)
        return "".join(reversed(letters))


class Words:
    """The words behind the tokens of a text."""

    def __init__(self, model: CharacterModel):
        self.model = model

    def of(self, token: str) -> list[str]:
        """Of a lower-cased token without white space."""
        if _DISGUISED.search(token) and (core := _CORE.search(token)) and _DISGUISED.search(core[0]):
            token = token[: core.start()] + self.model.restore(core[0]) + token[core.end() :]
        return _WORD.findall(token)

    def joined(self, m: re.Match) -> str:
        return self.model.restore_apart(m[0]) if _LETTER.search(m[0]) else m[0]

    def tokens(self, text: str, apart: bool) -> set[str]:
        """The distinct tokens of a text. apart: it may hold letters set apart."""
        text = text.lower()
        return set((_APART.sub(self.joined, text) if apart else text).split())


class Weights(dict):
    """The weight of a token."""

    def __init__(self, words: Words, weights: np.ndarray):
        at = np.flatnonzero(weights)
        self.words, self.weights, self.bytes = words, dict(zip(at.tolist(), weights[at].tolist(), strict=True)), 0

    def __missing__(self, token: str) -> float:
        if self.bytes >= REMEMBERED:
            self.clear()
            self.bytes = 0
        weights, out = self.weights, 0.0
        for w in self.words.of(token):
            for f in word_features(w):
                out += weights.get(f, 0.0)
        self[token] = out
        self.bytes += ENTRY_BYTES + 4 * len(token)
        return out


def set_apart(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By text: may it hold a letter or sign and separators four times in turn."""
    gap = _GAP[data]
    # of repeated separators the first counts, of a character of several bytes its first byte
    counts = (data & 0xC0) != 0x80
    counts[1:] &= ~(gap[1:] & gap[:-1])
    unit, gap = (_SYMBOL[data] > 0)[counts] | _LOOKS[data][counts], gap[counts]
    bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[bounds]
    lone = gap[:-2] & unit[1:-1] & gap[2:] if len(gap) > 2 else np.zeros(0, bool)
    turn = lone[:-2] & lone[2:] if len(lone) > 2 else np.zeros(0, bool)
    return per_row(np.append(turn, np.zeros(len(gap) - len(turn), bool)).astype(np.int64), bounds) > 0


def texts_of(column: pa.Array) -> Iterator[tuple[str, bool]]:
    """Each text and whether it may hold letters set apart, found block by block: a batch is never worked on at once."""
    data, bounds = utf8(column)
    for i, j in blocks(bounds):
        apart = set_apart(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        for k in range(i, j):
            yield column[k].as_py() or "", bool(apart[k - i])


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of all texts; each partition sends SYMBOLS ** 3 sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, bounds = utf8(batch.column(0))
            for i, j in blocks(bounds):
                s = _SYMBOL[data[bounds[i] : bounds[j]]]
                s = np.concatenate(([0, 0], s, [0])).astype(np.uint16)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = only(docs, text=text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["gram"]] = rows["n"]
    return out


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings of 4 to 7 letters."""
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(word.encode()) & mask]
    if len(word) > 4:
        h = zlib.crc32(b"^" + word[:4].encode())
        out.append(h & mask)
        for c in word[4 : min(len(word) - 1, 7)]:
            h = zlib.crc32(c.encode(), h)
            out.append(h & mask)
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


@dataclass
class ToxicityModel:
    counts: np.ndarray
    weights: np.ndarray  # by hashed feature
    bias: float


def fit_words(texts: list[list[str]], y: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the features that tell the classes apart, by G-squared, and the bias; rows are held sparse."""
    weights = np.zeros(1 << HASH_BITS, np.float32)
    n1 = int(y.sum())
    if not len(y) or n1 in (0, len(y)):
        return weights, 20.0 if len(y) and n1 else -20.0
    of: dict[str, list[int]] = {}
    rows = []
    for words in texts:
        ids: list[int] = []
        for w in words:
            if (f := of.get(w)) is None:
                f = of[w] = word_features(w)
            ids += f
        rows.append(np.unique(np.array(ids, np.int64), return_counts=True))
    seen = np.zeros((2, 1 << HASH_BITS))
    for (ids, _), label in zip(rows, y.tolist(), strict=True):
        seen[label, ids] += 1
    total = np.array([len(y) - n1, n1], float)[:, None]
    rate_all = (seen.sum(0) + 0.5) / (len(y) + 1)
    p = (seen + 0.5) / (total + 1)
    gain = (total * (p * np.log(p / rate_all) + (1 - p) * np.log((1 - p) / (1 - rate_all)))).sum(0)
    gain[seen.sum(0) < SEEN] = 0
    chosen = np.flatnonzero(gain > GAIN)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = [place[ids] >= 0 for ids, _ in rows]
    column = np.concatenate([place[ids[k]] for (ids, _), k in zip(rows, kept, strict=True)])
    value = np.concatenate([n[k] for (_, n), k in zip(rows, kept, strict=True)]).astype(np.float32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [k.sum() for k in kept])
    w, b = np.zeros(len(chosen)), math.log(n1 / (len(y) - n1))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        total_w = np.bincount(row, value * w[column], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(total_w, -30, 30))) - y) / len(y)
        gw, gb = np.bincount(column, value * g[row], len(chosen)) + decay * w, float(g.sum())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    spark = docs.sparkSession
    counts = character_counts(docs, text_col)
    known = only(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most: small enough to broadcast
    shared = spark.sparkContext.broadcast(counts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(CharacterModel(shared.value))
        for batch in batches:
            own = [" ".join(w for t in sorted(known.tokens(text, a)) for w in known.of(t)) for text, a in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string())], names=["doc_id", "label", "words"])

    texts = only(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", "text")
    rows = texts.mapInArrow(words, "doc_id long, label int, words string").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("words").alias("words")).toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=rows["doc_id"].__getitem__)
    weights, bias = fit_words([rows["words"][i].split(" ") if rows["words"][i] else [] for i in order], np.array([rows["label"][i] for i in order], np.int64))
    return ToxicityModel(counts, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(CharacterModel(model.counts))
        weights = Weights(words, model.weights)
        for batch in batches:
            ids, scores = batch.column(0).to_pylist(), []
            for text, a in texts_of(batch.column(1)):
                total = model.bias + math.fsum([weights[t] for t in words.tokens(text, a)])
                scores.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
