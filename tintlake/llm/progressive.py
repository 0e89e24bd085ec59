"""Progressive JPEG media columns.

`store` puts bytes losslessly into progressive JPEG: its unit is the quantised coefficient. A payload of a multiple of 192
bytes fills MCUs of three 8x8 blocks (Y, Cb, Cr); byte b becomes the coefficient b + 2, in zigzag order. Ten scans follow:
spectral selection parts the coefficients of a block, successive approximation sends their last bit later. A restart marker
after every MCU makes each a lane of its own.

`load` reads any progressive JPEG with three components or one, 8-bit samples and Huffman coding: scans accumulate into coefficient
arrays; an exact integer inverse transform in numpy, chroma upsampling and colour conversion give the full-resolution RGB
tensor. All lanes of a block of rows are decoded together, a symbol at a time; only refinement scans that bring new
coefficients, or that hold more than one block between restart markers, are walked lane by lane.

Null or empty text: 192 blanks. Equal texts have equal media. A media value that can't be read (or is null) gives nulls and
the reason in `error`. Repeated rows, null ids and extra columns do no harm; other columns are ignored. A text may have up
to 8191 * 8191 * 192 bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.shared import blocks, only, utf8

UNIT = 192
BIAS = 2
#: MCUs in a row of blocks, at most: 65528 pixels.
WIDE = 8191
#: Bytes of payload that are coded at once.
AT_ONCE = 1 << 20

# Fixed values of the format: the zigzag order (place in the block by index in the scan).
ZIGZAG = np.array(sorted(range(64), key=lambda p: (s := p // 8 + p % 8, p // 8 if s % 2 else p % 8)))

#: Code lengths of the symbols we write, shortest first: sizes 6 and 5 are most letters and the blank, after the last bit is taken off.
DC_SYMBOLS = (6, 5, 7, 8, 4, 3, 2, 1, 0)
AC_SYMBOLS = (6, 5, 7, 8, 4, 3, 2, 1, 0)
REFINE_SYMBOLS = (0,)


def unary_table(symbols: tuple[int, ...]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A Huffman table with codes 0, 10, 110, ...: as in DHT, and code and length by symbol."""
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for i, s in enumerate(symbols):
        code[s], length[s] = (1 << (i + 1)) - 2, i + 1
    return bytes([1 if i < len(symbols) else 0 for i in range(16)]) + bytes(symbols), code, length


_DC, _AC, _REFINE = unary_table(DC_SYMBOLS), unary_table(AC_SYMBOLS), unary_table(REFINE_SYMBOLS)
_SIZE = np.array([i.bit_length() for i in range(2048)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, size: int) -> bytes:
    tables = b"".join(bytes([kind]) + t[0] for kind, t in ((0x00, _DC), (0x10, _AC), (0x11, _REFINE)))
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    return b"\xff\xd8" + _segment(0xFE, b"bytes %d" % size) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables) + _segment(0xDD, b"\0\1")


def _scan(components: tuple[int, ...], ss: int, se: int, ah: int, al: int, ac: int = 0) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, ac]) for c in components) + bytes([ss, se, ah << 4 | al]))


#: (components, first and last coefficient, bits sent before and left) of each scan we write.
SCRIPT = [((1, 2, 3), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in (1, 2, 3)), ((1, 2, 3), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in (1, 2, 3))]


def pack_lanes(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes as rows of bytes, the last byte filled up with ones; and how many bytes each row has. No code is over 16 bits."""
    n, k = codes.shape
    if k % 4:
        more = np.zeros((n, 4 - k % 4), codes.dtype)
        codes, lengths = np.concatenate((codes, more), 1), np.concatenate((lengths, more.astype(lengths.dtype)), 1)
    for _ in range(2):  # four codes are one of 64 bits at most
        right = lengths[:, 1::2]
        codes, lengths = codes[:, ::2] << right.astype(np.uint64) | codes[:, 1::2], lengths[:, ::2] + right
    total = lengths.sum(1)
    fill = -total % 8
    codes = np.concatenate((codes, ((1 << fill) - 1).astype(np.uint64)[:, None]), 1)
    lengths = np.concatenate((lengths, fill[:, None]), 1)
    width = int((total + fill).max(initial=0)) // 64 + 2
    words, row, at = np.zeros((n, width), np.uint64), np.arange(n), np.zeros(n, np.int64)
    for j in range(codes.shape[1]):
        size = lengths[:, j]
        code = codes[:, j] << ((64 - size) % 64).astype(np.uint64)
        shift = (at % 64).astype(np.uint64)
        words[row, at // 64] |= code >> shift
        words[row, at // 64 + 1] |= code << np.uint64(1) << (np.uint64(63) - shift)
        at += size
    return words.byteswap().view(np.uint8).reshape(n, -1), (total + fill) // 8


def _stream(codes: np.ndarray, lengths: np.ndarray, restart: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The lanes with stuffed bytes, each followed by its restart marker; and where each begins."""
    rows, size = pack_lanes(codes, lengths)
    flat = rows[np.arange(rows.shape[1])[None, :] < size[:, None]]
    full = flat == 0xFF
    before = np.cumsum(full) - full
    ends = np.cumsum(size)
    lane = np.repeat(np.arange(len(size)), size)
    out = np.zeros(len(flat) + int(full.sum()) + 2 * len(size), np.uint8)
    out[np.arange(len(flat)) + before + 2 * lane] = flat
    close = ends + np.concatenate(([0], np.cumsum(full)))[ends] + 2 * np.arange(len(size))
    out[close], out[close + 1] = 0xFF, 0xD0 + restart % 8
    return out.tobytes(), np.concatenate(([0], close + 2))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 192 bytes, as a progressive JPEG."""
    units = np.array([len(p) // UNIT for p in payloads], np.int64)
    width = np.minimum(units, WIDE)
    height = -(-units // np.maximum(width, 1))
    padded = b"".join(p + b" " * int(UNIT * (w * h - n)) for p, n, w, h in zip(payloads, units, width, height, strict=True))
    values = np.frombuffer(padded, np.uint8).reshape(-1, 3, 64).astype(np.int64) + BIAS
    first = np.concatenate(([0], np.cumsum(width * height)))
    restart = np.concatenate([np.arange(n) for n in np.diff(first)]) if len(payloads) else np.zeros(0, np.int64)
    scans: list[tuple[bytes, np.ndarray, bytes]] = []
    for components, ss, se, ah, al in SCRIPT:
        table = _REFINE if ah and ss else _AC if ss else _DC
        v = values[:, [c - 1 for c in components], ss : se + 1].reshape(len(values), -1)
        if ah:  # one more bit of each; all are known not to be 0
            codes, lengths = (v & 1).astype(np.uint64), np.ones(v.shape, np.int64)
            if ss:  # no new coefficients: the end of the block comes first
                codes = np.concatenate((np.full((len(v), 1), table[1][0]), codes), 1)
                lengths = np.concatenate((np.full((len(v), 1), table[2][0]), lengths), 1)
        else:  # no zeros, so each has a run of none before it
            v = v >> al
            size = _SIZE[v]
            codes, lengths = table[1][size] << size.astype(np.uint64) | v.astype(np.uint64), table[2][size] + size
        scans.append((*_stream(codes, lengths, restart), _scan(components, ss, se, ah, al, int(bool(ah and ss)))))
    out = []
    for i, p in enumerate(payloads):
        parts = [_head(8 * int(width[i]), 8 * int(height[i]), len(p))]
        for stream, starts, head in scans:
            parts += [head, stream[starts[first[i]] : starts[first[i + 1]] - 2]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass(eq=False)
class Component:
    name: int
    h: int
    v: int
    table: int
    base: int = 0  # of its blocks in the array of all
    wide: int = 0  # blocks in a row, filled up to whole MCUs
    own: tuple[int, int] = (0, 0)  # rows and columns of blocks that scans of it alone have
    rows: int = 0


@dataclass
class Picture:
    """What the markers of one JPEG say. start: its first block in the array of all."""

    start: int
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[Component] = field(default_factory=list)
    quantum: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    scans: list[tuple] = field(default_factory=list)
    error: str = ""


@dataclass
class Scan:
    components: list[Component]
    used: tuple[bytes, ...]  # Huffman table of each
    ss: int
    se: int
    ah: int
    al: int
    at: int  # of its first lane
    low: int  # its first and last restart marker among all of the buffer
    high: int
    units: int
    each: int  # units in a lane
    level: int  # scans it builds on have a lower one


class Bits:
    """A buffer of many JPEGs: its markers, and its bytes without stuffing as overlapping 64-bit words."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + b"\xff\xd9", np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        self.stuffed = ff[after == 0] + 1
        self.restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        self.markers = ff[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
        self.restart_list = self.restarts.tolist()
        keep = np.ones(len(raw), bool)
        keep[self.stuffed] = False
        self.clean = np.concatenate((raw[keep], np.full(16, 0xFF, np.uint8)))
        c = self.clean.astype(np.uint32)
        word = c[:-3] << np.uint32(24) | c[1:-2] << np.uint32(16) | c[2:-1] << np.uint32(8) | c[3:]
        self.words = word[:-4].astype(np.uint64) << np.uint64(32) | word[4:]

    def place(self, at: np.ndarray) -> np.ndarray:
        """Where bytes of the buffer are in `clean`."""
        return at - np.searchsorted(self.stuffed, at)

    def take(self, at: np.ndarray) -> np.ndarray:
        """64 bits, at least 57 of them real, from each bit on."""
        at = np.minimum(at, 8 * len(self.words) - 8)
        return self.words[at >> 3] << (at & 7).astype(np.uint64)


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code begins."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for bits, n in enumerate(table[:16], 1):
        for s in table[at : at + n]:
            low = code << (16 - bits)
            symbol[low : low + (1 << (16 - bits))], length[low : low + (1 << (16 - bits))] = s, bits
            code += 1
        at += n
        code <<= 1
    return symbol, length


_lookups: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def lookup_of(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = lookup(table)
    return _lookups[table]


def parse(data: bytes, start: int, end: int, bits: Bits) -> Picture:
    """Walks the markers from start to end."""
    p = Picture(start)
    at = start + 2
    if data[start:at] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at < end:
        if data[at] != 0xFF or at + 2 > end:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if at + 4 > end:
            raise ValueError("cut short")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if at > end:
            raise ValueError("cut short")
        if marker == 0xFE:
            p.comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                p.quantum[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            p.tables = dict(p.tables)
            while body:
                n = 17 + sum(body[1:17])
                p.tables[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker == 0xDD:
            p.restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            depth, p.height, p.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not p.width or not p.height:
                raise ValueError("not of 8-bit samples and one or three components")
            p.components = [Component(c, hv >> 4, hv & 15, q) for c, hv, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
            if any(not 1 <= x <= 4 for c in p.components for x in (c.h, c.v)):
                raise ValueError("odd sampling")
            high, tall, base = max(c.h for c in p.components), max(c.v for c in p.components), 0
            across, down = -(-p.width // (8 * high)), -(-p.height // (8 * tall))
            if across * down * UNIT > 64 * (end - start) * 64:
                raise ValueError("larger than its bytes can be")
            for c in p.components:
                c.base, c.wide, c.rows = base, across * c.h, down * c.v
                c.own = (-(-(-(-p.height * c.v // tall)) // 8), -(-(-(-p.width * c.h // high)) // 8))
                base += c.wide * c.rows
            named = {c.name: c for c in p.components}
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not progressive with Huffman codes")
        elif marker == 0xDA:
            if not p.components:
                raise ValueError("a scan before its frame")
            n = body[0]
            own = [named[name] for name in body[1 : 1 + 2 * n : 2]]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            ah, al = a >> 4, a & 15
            if se > 63 or ss > se or (ss == 0) != (se == 0) or ss and n > 1:
                raise ValueError("not a progressive scan")
            used = tuple(b"" if ss == 0 and ah else p.tables[t >> 4 if ss == 0 else 0x10 | t & 15] for t in body[2 : 2 + 2 * n : 2])
            i = bisect.bisect_left(bits.markers, at)
            stop = min(bits.markers[i], end) if i < len(bits.markers) else end
            low = bisect.bisect_left(bits.restart_list, at)
            high = bisect.bisect_left(bits.restart_list, stop, low)
            c = own[0]
            units = c.own[0] * c.own[1] if n == 1 else c.wide // c.h * (c.rows // c.v)
            each = p.restart or units
            if high - low + 1 != -(-units // each):
                raise ValueError("restart markers don't fit")
            level = 1 + max((x.level for x in p.scans if x.ss <= se and ss <= x.se and any(y in x.components for y in own)), default=-1)
            p.scans.append(Scan(own, used, ss, se, ah, al, at, low, high, units, each, level))
            at = stop
        # other segments say nothing that matters here
    if not p.components or not p.scans:
        raise ValueError("no picture")
    return p


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def _next(bits: Bits, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, and the bits after it, of each lane; at moves behind the code."""
    word = bits.take(at)
    peek = (word >> np.uint64(48)).astype(np.int64)
    length = table[1][peek]
    if not length.all():
        raise ValueError("no such code")
    at += length
    return table[0][peek], word << length.astype(np.uint64), length


def _head_bits(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _dc(bits: Bits, coef: np.ndarray, at: np.ndarray, count: np.ndarray, block, parts: list[tuple[int, bytes]], ah: int, al: int) -> None:
    """block(step, lanes): the block of each lane at that step. parts: (component, table) of the steps of one unit."""
    before = np.zeros((len(at), 4), np.int64)
    lanes = np.arange(len(at))
    for step in range(int(count.max(initial=0)) * len(parts)):
        lanes = lanes[step < count[lanes] * len(parts)]
        component, table = parts[step % len(parts)]
        ids, own = block(step, lanes), at[lanes]
        if ah:
            coef[ids, 0] |= _head_bits(bits.take(own), np.ones(len(own), np.int64)) << al
            own += 1
        else:
            size, word, _ = _next(bits, own, lookup_of(table))
            if (size > 15).any():
                raise ValueError("no such size")
            before[lanes, component] += _signed(_head_bits(word, size), size)
            coef[ids, 0] = before[lanes, component] << al
            own += size
        at[lanes] = own


def _ac_first(bits: Bits, coef: np.ndarray, at: np.ndarray, count: np.ndarray, block, ss: int, se: int, al: int, table: bytes) -> None:
    lut = lookup_of(table)
    lane, k, unit = np.arange(len(at)), np.full(len(at), ss), np.zeros(len(at), np.int64)
    at, count = at.copy(), count.copy()
    while len(lane):
        symbol, word, _ = _next(bits, at, lut)
        run, size = symbol >> 4, symbol & 15
        k += run
        ended = (size == 0) & (run < 15)
        value = _signed(_head_bits(word, size), size)
        at += size
        if (k[~ended] > se).any():
            raise ValueError("a run leaves its band")
        if ended.any():
            put = size > 0
            coef[block(unit[put], lane[put]), k[put]] = value[put] << al
            more = _head_bits(word, run * ended)
            at += run * ended
            unit += np.where(ended, (1 << run * ended) + more, 0)
            k = np.where(ended, ss, k + 1)
        else:
            put = slice(None) if size.all() else size > 0
            coef[block(unit[put], lane[put]), k[put]] = value[put] << al
            k += 1
        over = k > se
        if over.any():
            unit += over
            k[over] = ss
        if (unit >= count).any():
            stay = unit < count
            lane, k, unit, at, count = lane[stay], k[stay], unit[stay], at[stay], count[stay]


def _ac_refine(bits: Bits, coef: np.ndarray, at: np.ndarray, count: np.ndarray, block, ss: int, se: int, al: int, table: bytes) -> None:
    lut = lookup_of(table)
    symbol, _, length = _next(bits, at.copy(), lut)
    plain = (symbol == 0) & (count == 1)  # a single block without new coefficients
    if plain.any():
        lanes = np.flatnonzero(plain)
        ids, start = block(np.zeros(len(lanes), np.int64), lanes), at[lanes] + length[lanes]
        band = coef[ids, ss : se + 1]
        known = band != 0
        if known.all() and (start % 8 == start[0] % 8).all():
            n, lead = se - ss + 1, int(start[0] % 8)
            rows = bits.clean[np.minimum((start >> 3)[:, None] + np.arange((n + lead + 7) // 8), len(bits.clean) - 1)]
            more = np.unpackbits(rows, axis=1)[:, lead : lead + n].astype(np.int64)
        else:
            where = start[:, None] + np.cumsum(known, 1) - 1
            more = (bits.clean[np.clip(where >> 3, 0, len(bits.clean) - 1)] >> (7 - (where & 7)).astype(np.uint8) & 1).astype(np.int64) * known
        coef[ids, ss : se + 1] = band + np.sign(band) * (more << al)
    for lane in np.flatnonzero(~plain).tolist():
        _refine_lane(bits, coef, int(at[lane]), [int(block(np.array([u]), np.array([lane]))[0]) for u in range(int(count[lane]))], ss, se, al, lut)


def _refine_lane(bits: Bits, coef: np.ndarray, at: int, ids: list[int], ss: int, se: int, al: int, lut: tuple) -> None:
    def bit() -> int:
        nonlocal at
        b = int(bits.clean[min(at >> 3, len(bits.clean) - 1)]) >> (7 - at % 8) & 1
        at += 1
        return b

    left = 0  # blocks without new coefficients still to come
    for i in ids:
        k = ss
        while not left and k <= se:
            peek = int(bits.take(np.array([at]))[0]) >> 48
            symbol, length = int(lut[0][peek]), int(lut[1][peek])
            if not length:
                raise ValueError("no such code")
            at += length
            run, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = (1 if bit() else -1) << al
            elif run < 15:
                left = 1 << run
                for j in range(run):
                    left += bit() << (run - 1 - j)
                break
            while k <= se:
                v = int(coef[i, k])
                if v:
                    coef[i, k] = v + (1 if v > 0 else -1) * (bit() << al)
                elif run:
                    run -= 1
                else:
                    if new:
                        coef[i, k] = new
                    k += 1
                    break
                k += 1
        if left:
            for j in range(k, se + 1):
                if v := int(coef[i, j]):
                    coef[i, j] = v + (1 if v > 0 else -1) * (bit() << al)
            left -= 1


def coefficients(media: list[bytes | None]) -> tuple[list[Picture], np.ndarray]:
    """The pictures, and the blocks of all in a row (zigzag order; picture.start is then its first block)."""
    if all(m is not None for m in media):
        try:
            return _together(media)
        except (ValueError, IndexError, KeyError, struct.error):
            pass
    if len(media) == 1:
        try:
            return _together([media[0] or b""])
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return [Picture(0, error=str(e) or type(e).__name__)], np.zeros((0, 64), np.int32)
    pictures, arrays, base = [], [], 0
    for m in media:  # one can't be read: each on its own
        (p,), c = coefficients([m])
        p.start = base
        base += len(c)
        pictures.append(p)
        arrays.append(c)
    return pictures, np.concatenate(arrays) if arrays else np.zeros((0, 64), np.int32)


def _together(media: list[bytes]) -> tuple[list[Picture], np.ndarray]:
    data = b"".join(media)
    bits = Bits(data)
    ends = np.cumsum([len(m) for m in media]).tolist()
    pictures = [parse(data, e - len(m), e, bits) for m, e in zip(media, ends, strict=True)]
    base = 0
    for p in pictures:
        p.start = base
        base += sum(c.wide * c.rows for c in p.components)
    coef = np.zeros((base, 64), np.int32)
    groups: dict[tuple, list[tuple[Picture, Scan]]] = {}
    for p in pictures:
        for x in p.scans:
            units = ((0,),) if len(x.components) == 1 else tuple((i, c.h, c.v) for i, c in enumerate(x.components))
            groups.setdefault((x.level, x.ss, x.se, x.ah, x.al, x.used, units), []).append((p, x))
    for (_, ss, se, ah, al, used, units), members in sorted(groups.items(), key=lambda g: g[0][0]):
        lanes = np.array([x.high - x.low + 1 for _, x in members])
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        low, each, total, at0 = (np.repeat([v for v in values], lanes) for values in zip(*((x.low, x.each, x.units, x.at) for _, x in members), strict=True))
        at = 8 * bits.place(np.where(nth > 0, bits.restarts[np.maximum(low + nth - 1, 0)] + 2 if len(bits.restarts) else 0, at0))
        unit0 = nth * each
        count = np.minimum(each, total - unit0)
        if len(units) == 1:
            first, wide, across = (np.repeat(np.array(v, np.int64), lanes) for v in zip(*((p.start + x.components[0].base, x.components[0].wide, x.components[0].own[1]) for p, x in members), strict=True))
            home = first + unit0 // across * wide + unit0 % across

            def block(unit, lane, first=first, wide=wide, across=across, unit0=unit0, home=home, single=bool((count == 1).all())):
                if single:
                    return home[lane]
                u = unit0[lane] + unit
                return first[lane] + u // across[lane] * wide[lane] + u % across[lane]

            if ss == 0:
                _dc(bits, coef, at, count, block, [(0, used[0])], ah, al)
            elif ah:
                _ac_refine(bits, coef, at, count, block, ss, se, al, used[0])
            else:
                _ac_first(bits, coef, at, count, block, ss, se, al, used[0])
            continue
        cells = [(i, x, y) for i, h, v in units for y in range(v) for x in range(h)]
        bases = np.repeat(np.array([[p.start + c.base for c in x.components] for p, x in members], np.int64), lanes, 0)
        wides = np.repeat(np.array([[c.wide for c in x.components] for _, x in members], np.int64), lanes, 0)

        def block(step, lane, cells=cells, units=units, bases=bases, wides=wides, unit0=unit0):
            i, x, y = cells[step % len(cells)]
            _, h, v = units[i]
            u, across = unit0[lane] + step // len(cells), wides[lane, i] // h
            return bases[lane, i] + (u // across * v + y) * wides[lane, i] + u % across * h + x

        _dc(bits, coef, at, count, block, [(i, used[i]) for i, _, _ in cells], ah, al)
    return pictures, coef


def _basis() -> np.ndarray:
    """The two-dimensional inverse transform of zigzag coefficients in whole numbers of 2 ** -14."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    two = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[ZIGZAG]
    return np.round(two * (1 << 14))


_BASIS = _basis()


def samples(coef: np.ndarray) -> np.ndarray:
    """8x8 samples of dequantised blocks. Sums are of whole numbers below 2 ** 53, so they are exact in any order."""
    return np.clip((((coef.astype(np.float64) @ _BASIS).astype(np.int64) + (1 << 13)) >> 14) + 128, 0, 255).astype(np.int32).reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """BT.601 full range in whole numbers of 2 ** -16."""
    b, r = cb - 128, cr - 128
    half = 1 << 15
    out = np.stack((y + (91881 * r + half >> 16), y - (22554 * b + 46802 * r + half >> 16), y + (116130 * b + half >> 16)), -1)
    return np.clip(out, 0, 255).astype(np.uint8)


def dequantised(pictures: list[Picture], coef: np.ndarray) -> np.ndarray:
    """The samples of all blocks of all pictures, some thousands of blocks at a time."""
    out = np.zeros((len(coef), 8, 8), np.int32)
    flat = all((q == 1).all() for p in pictures for q in p.quantum.values())
    scale = np.ones((1, 64), np.int64) if flat else np.ones(coef.shape, np.int64)
    for p in pictures if not flat else ():
        for c in p.components:
            scale[p.start + c.base : p.start + c.base + c.wide * c.rows] = p.quantum[c.table]
    for i in range(0, len(coef), 8192):
        out[i : i + 8192] = samples(coef[i : i + 8192] * (scale if flat else scale[i : i + 8192]))
    return out


def tensors(pictures: list[Picture], coef: np.ndarray) -> list[np.ndarray | None]:
    """Each picture as height x width x 3, or None where it couldn't be read."""
    made = dequantised(pictures, coef)
    plain = [len(p.components) == 3 and all((c.h, c.v) == (1, 1) for c in p.components) and not p.error for p in pictures]
    out: list[np.ndarray | None] = [None] * len(pictures)
    whole = [i for i, x in enumerate(plain) if x]
    if whole:  # no chroma to upsample: all colours are converted together
        blocks_of = [pictures[i].components[0].wide * pictures[i].components[0].rows for i in whole]
        y, cb, cr = (np.concatenate([made[pictures[i].start + k * n : pictures[i].start + (k + 1) * n] for i, n in zip(whole, blocks_of, strict=True)]) for k in range(3))
        rgb, at = to_rgb(y, cb, cr), 0
        for i, n in zip(whole, blocks_of, strict=True):
            p, c = pictures[i], pictures[i].components[0]
            out[i] = rgb[at : at + n].reshape(c.rows, c.wide, 8, 8, 3).transpose(0, 2, 1, 3, 4).reshape(8 * c.rows, 8 * c.wide, 3)[: p.height, : p.width]
            at += n
    for i, p in enumerate(pictures):
        if not plain[i] and not p.error:
            out[i] = upsampled(p, made)
    return out


def upsampled(p: Picture, made: np.ndarray) -> np.ndarray:
    high, tall = max(c.h for c in p.components), max(c.v for c in p.components)
    planes = []
    for c in p.components:
        plane = made[p.start + c.base : p.start + c.base + c.wide * c.rows].reshape(c.rows, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.wide)
        # each sample stands for a cell of the full picture, also where the factors don't divide
        planes.append(plane[np.arange(p.height)[:, None] * c.v // tall, np.arange(p.width)[None, :] * c.h // high])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    return to_rgb(*planes)


def feature(rgb: np.ndarray) -> str:
    """Size, then the mean of each channel in thousandths and a checksum of the pixels."""
    h, w, _ = rgb.shape
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def payload(p: Picture, coef: np.ndarray) -> bytes:
    """The bytes that `encode` stored."""
    y, cb, cr = (coef[p.start + c.base : p.start + c.base + c.wide * c.rows] for c in p.components)
    size = int(p.comment.removeprefix(b"bytes "))
    return (np.stack((y, cb, cr), 1) - BIAS).astype(np.uint8).tobytes()[:size]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    return blocks(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), AT_ONCE)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8, filled up with blanks, as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            for i, j in blocks(bounds, AT_ONCE):
                own = [data[a:b].tobytes() for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1], strict=True)]
                media = encode([t + b" " * (-len(t) % UNIT or (0 if t else UNIT)) for t in own])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(t) for t in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes", keep_tensor: bool = False) -> DataFrame:
    """doc_id, n_bytes and, of the stored bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error; with keep_tensor also width, height and rgb (row by row)."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            for i, j in _slices([len(m or b"") for m in values]):
                pictures, coef = coefficients(values[i:j])
                pixels = tensors(pictures, coef)
                columns: list[list] = [[] for _ in range(10)]
                for p, m, rgb in zip(pictures, values[i:j], pixels, strict=True):
                    row: list = [None] * 10
                    if m is not None:
                        row[3:5] = [len(m), hashlib.sha256(m).hexdigest()]
                    if p.error:
                        row[6] = p.error
                    else:
                        row[5] = feature(rgb)
                        if p.comment.startswith(b"bytes ") and len(p.components) == 3:
                            own = payload(p, coef)
                            row[:3] = [len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:])]
                        if keep_tensor:
                            row[7:] = [p.width, p.height, rgb.tobytes()]
                    for column, v in zip(columns, row, strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "width", "height", "rgb"]
                n = 7 + 3 * keep_tensor
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *(pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True))], names=["doc_id", "n_bytes", *names[:n]])

    own = only(media, doc_id=id_col, n_bytes=size_col, media=media_col).select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media")
    return own.mapInArrow(run, fields + ", width int, height int, rgb binary" * keep_tensor)
