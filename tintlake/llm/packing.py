"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A document becomes its token ids and a closing id. Only a document longer than the capacity is cut, into pieces of the
capacity; its last piece may be shorter. The choice of what shares a sequence depends on lengths alone, so it is made on
the histogram of lengths, which has at most `capacity` entries at any corpus size: a sequence is filled greedily with the
largest length that fits, then its smallest piece is replaced by the two unpacked lengths that fill the expanded gap most
tightly, if they fill it better. The same pattern is taken as often as the histogram allows in one step. Pieces find
their places by their rank among pieces of the same length, counted in salted cells, so no length is a hot key.

Null or empty text: the closing id alone, a piece of length 1. Very long texts are tokenized whole and cut. Null or repeated doc_id: every row is packed on its own.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintlake.llm.shared import only, stored

CAPACITY = 4096
CLOSING_ID = 1
#: Cells that pieces of one length are ranked in.
SALTS = 64
#: Bytes of tokens whose ids a worker remembers, in each of two halves; what a token takes beside its characters and ids.
REMEMBERED, ENTRY_BYTES = 32 << 20, 200
#: Bytes of ids that are sent on at once.
SEND_BYTES = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and the rest that isn't white space, of the characters the fast path handles, as regex classes."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "-": []}
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]):
        kinds.get(unicodedata.category(c)[0], kinds["-"]).append(re.escape(c))
    return "".join(kinds["L"]), "".join(kinds["N"]), "".join(kinds["-"])


_L, _N, _S = _classes()
#: The vocabulary's own split of normalized text, for those characters.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[{_S}]+")
#: A token with anything else goes through the library.
_OTHER = re.compile(rf"[^{_L}{_N}{_S}]")
#: So does a whole text with a special token, white space that not all agree on, or a letter whose lower case hangs on its place.
_WHOLE_ASCII = ("<|", *map(chr, range(28, 32)))
_WHOLE = re.compile("<\\||[\x1c-\x1f\x85\xa0\u03a3\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_tokens(vocab: dict[str, int]) -> dict[str, bytes]:
    """The bytes of each token of a byte-level vocabulary; the end of a word becomes byte 255, which UTF-8 never has."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    byte = {c: b for b, c in shown.items()}
    return {t: bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>") for t in vocab}


def fast_encoder(path: str):
    """(merging engine, packed ids by its ranks) for a vocabulary of byte pairs with word ends, or None for any other.

    The engine joins the pair of lowest rank first, as the library does: bytes, then last bytes of words, then merges in order.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    tokens = byte_tokens(model["vocab"])
    ranks = {bytes([b]): b for b in range(256)}
    for b in range(256):
        ranks[bytes([b, 255])] = 256 + b
    for left, right in model["merges"]:
        ranks.setdefault(tokens[left + right], len(ranks))
    ids = [b""] * len(ranks)
    for token, i in model["vocab"].items():
        ids[ranks[tokens[token]]] = struct.pack("<I", i)
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe, ids


class Ids(dict):
    """Packed ids by token of lower-cased text between white space. Of tokens not seen lately the older half is forgotten.

    The vocabulary's split never crosses white space, so a text's ids are those of its tokens, one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.older, self.fast, self.bytes = Tokenizer.from_file(path), {}, fast_encoder(path), 0

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, token: str) -> bytes:
        if self.bytes >= REMEMBERED:
            self.older, self.bytes = dict(self), 0
            self.clear()
        if (out := self.older.get(token)) is None:
            if self.fast and not _OTHER.search(token):
                engine, packed = self.fast
                out = b"".join([packed[r] for w in _WORDS.findall(token) for r in engine.encode_single_piece(w.encode() + b"\xff")])
            else:
                out = self.whole(token)
        self[token] = out
        self.bytes += ENTRY_BYTES + 2 * len(token) + len(out)
        return out

    def text(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers: equal to those of the library for the whole text."""
        if _WHOLE.search(text) if not text.isascii() else any(c in text for c in _WHOLE_ASCII):
            return self.whole(text)
        return b"".join([self[t] for t in text.lower().split()])


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian, binary) if asked for."""
    end = struct.pack("<I", closing)

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + keep_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = ids.text(text.as_py() or "") + end
                for k in range(0, len(packed), 4 * capacity):
                    part = packed[k : k + 4 * capacity]
                    out.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
                    size += len(part)
                if size > SEND_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=names)
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=names)

    return only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for pieces counted by length: (how many sequences, [(length, pieces of it in each)])."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("lengths must be from 1 to the capacity")
    order = sorted(left)
    patterns = []
    while order:
        use: dict[int, int] = {}
        gap = capacity
        at = len(order) - 1
        while at >= 0 and gap:
            n = order[at]
            if k := min(left[n] - use.get(n, 0), gap // n):
                use[n] = use.get(n, 0) + k
                gap -= k * n
            at = min(at - 1, bisect.bisect_right(order, gap) - 1)
        if gap:
            smallest = min(use)
            room = gap + smallest
            if pair := _pair(order, left, use, smallest, room):
                use[smallest] -= 1
                for n in pair:
                    use[n] = use.get(n, 0) + 1
        use = {n: k for n, k in use.items() if k}
        times = min(left[n] // k for n, k in use.items())
        patterns.append((times, sorted(use.items(), reverse=True)))
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del order[bisect.bisect_left(order, n)]
    return patterns


def _pair(order: list[int], left: dict[int, int], use: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """The two lengths, free once the smallest piece is out, with the largest sum in the room, if it is more than that piece."""
    free = np.array([n for n in order[: bisect.bisect_left(order, room)] if left[n] > use.get(n, 0) - (n == smallest)], np.int64)
    if not len(free):
        return None
    twice = np.array([left[n] - use.get(n, 0) + (n == smallest) > 1 for n in free.tolist()])
    at = np.searchsorted(free, np.minimum(room - free, free), side="right") - 1
    alone = (at == np.arange(len(free))) & ~twice
    at = np.where(alone, at - 1, at)
    sums = np.where(at >= 0, free + free[np.maximum(at, 0)], 0)
    best = int(np.argmax(sums))
    return (int(free[best]), int(free[at[best]])) if sums[best] > smallest else None


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces. To the driver goes a count for each length and salt: capacity * salts numbers at most."""
    spark = pieces.sparkSession
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "salt"])
    counts = {int(k): int(v) for k, v in cells.groupby("length")["n"].sum().items()}
    first = np.full((capacity + 1) * salts, -1, np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    for n, own in cells.groupby("length"):
        first[int(n) * salts + own["salt"].to_numpy()] = own["n"].cumsum().to_numpy() - own["n"].to_numpy()
    base, used = 0, dict.fromkeys(counts, 0)
    for times, use in best_two_fit(counts, capacity):
        offset = 0
        for n, k in use:
            runs[n].append((used[n], k, base, offset))
            used[n] += times * k
            offset += n * k
        base += times
    # The runs of a length begin where the last ended; their number hangs on the lengths, not on the rows.
    table = np.array([(n, *run) for n in sorted(runs) for run in runs[n]], np.int64).reshape(-1, 5)
    where = spark.sparkContext.broadcast((first, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, table = where.value
        start = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + first[length * salts + salt]
            run = table[np.searchsorted(start, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            kept = batch.select([c for c in batch.schema.names if c not in ("salt", "rank")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs; the pieces are stored once, since they are counted and then placed."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)
