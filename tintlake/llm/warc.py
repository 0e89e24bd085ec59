"""WARC archives with a two-level capture index.

`write_archives` puts a gzip member per capture into archives in the shared folder: the first copy of a payload (by least
page_id) as a response, later ones as revisits that point to it; payloads under `LEAST` bytes are always responses.
`build_index` sorts the captures by reversed-host url key, packs lines of them into compressed blocks, and keeps one row
for each block, the sparse directory. `CaptureIndex` finds a url by binary search in the directory, reads that block's
range, searches in it, and reads the records' ranges. `read_captures` goes through every block of the index and reads all
records, in the order they lie in, neighbours in one range.

A task writes archives under names of its own and returns their captures, so what a lost or repeated task left behind is in
no index. Deduplication shuffles digests for pages whose payload occurs twice; whether a page needs it is a join on the
digest, whose hot side Spark splits.

Null html: an empty payload. Null url: no target, key empty. Null page_id: a record without that field; it is never the
first copy unless no copy has an id, then all are responses. Of repeated rows with the least id every one is a response.
An empty table gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.shared import new_path, only, stored

#: Bytes of a payload that may be a revisit, at least.
LEAST = 100
#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 128 << 20
#: Captures in a block of the index.
BLOCK_LINES = 2000
#: Neighbouring records are read at once up to so many bytes; the records of so many are read by one task.
RANGE_BYTES, SPAN_BYTES = 4 << 20, 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "key string, page_id long, archive string, offset long, length long, record_type string, payload_digest string"
_PARTS = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)(.*)", re.S)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host reversed, in lower case, without its port; then the rest without the fragment."""
    url = (url or "").partition("#")[0]
    m = _PARTS.match(url)
    if not m:
        return _CONTROL.sub(_quoted, url)
    host = m[1].rpartition("@")[2].partition(":")[0].lower()
    return _CONTROL.sub(_quoted, ",".join(reversed(host.split("."))) + ")" + (m[2] or "/"))


def _quoted(m: re.Match) -> str:
    return f"%{ord(m[0]):02X}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. refers_to: the page whose equal payload is stored, or None to store it here."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _CONTROL.sub(_quoted, url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", len(payload) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def decode(member: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a gzip member; a stored payload is held against its digest."""
    fields, block = parse(zlib.decompress(member, 31))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    page, refers = (int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    if kind == "revisit":
        return page, fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, kind, refers, None
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} has another digest")
    return page, fields.get("WARC-Target-URI"), len(payload), digest, kind, refers, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes archives and returns their captures, stored."""
    base = new_path(pages.sparkSession, "archives")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = only(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", html.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    own = own.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(base)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                    page, url, payload, digest, refers = page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = _gzip(record(page, url, payload, digest, refers))
                    out.write(member)
                    rows.append((url_key(url), page, f"{base}/{name}", at, len(member), "response" if refers is None else "revisit", digest))
                    at += len(member)
                yield _captures(rows)
        finally:
            if out is not None:
                out.close()

    return stored(own.mapInArrow(write, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.split(" ")[0] for f in CAPTURE.split(", ")])


def _line(row: tuple) -> bytes:
    key, page, archive, offset, length, kind, digest = row
    return f"{key} {'' if page is None else page} {offset} {length} {kind} {digest} {archive}\n".encode()


def _row(line: bytes) -> tuple:
    key, page, offset, length, kind, digest, archive = line.decode().rstrip("\n").split(" ", 6)
    return key, int(page) if page else None, archive, int(offset), int(length), kind, digest


def build_index(captures: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, compressed blocks and returns the sparse directory, stored: first_key, last_key, shard, offset, length, captures."""
    base = new_path(captures.sparkSession, "index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(base)
        shard, out, at, block, rows = f"{base}/{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{shard.rpartition('/')[2]}", compression=None)
            data = _gzip(b"".join(map(_line, block)))
            out.write(data)
            rows.append((block[0][0], block[-1][0], shard, at, len(data), len(block)))
            at += len(data)
            block.clear()

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block.append(row)
                    if len(block) == lines:
                        flush()
            if block:
                flush()
        finally:
            if out is not None:
                out.close()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["first_key", "last_key", "shard", "offset", "length", "captures"])

    order = ("key", "page_id", "archive", "offset")  # a hot key is parted too
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(write, "first_key string, last_key string, shard string, offset long, length long, captures long"), "directory")


class Ranges:
    """Range reads of files, one of which stays open."""

    def __init__(self) -> None:
        self.uri, self.file = "", None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri} is cut short")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = "", None


def captures_of(directory: DataFrame) -> DataFrame:
    """The captures that the index's blocks list."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _captures([_row(x) for x in io.BytesIO(zlib.decompress(ranges.read(shard, offset, length), 31))])
        ranges.close()

    return directory.select("shard", "offset", "length").repartition("shard", "offset").mapInArrow(read, CAPTURE)


def read_captures(directory: DataFrame, keep_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of every capture in the index."""
    rows = captures_of(directory).select("archive", "offset", "length")
    rows = rows.repartition("archive", F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + keep_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()

        def made(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
            archive, first, _ = run[0]
            data = ranges.read(archive, first, run[-1][1] + run[-1][2] - first)
            out = [decode(data[o - first : o - first + n]) for _, o, n in run]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)

        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (archive != run[-1][0] or offset != run[-1][1] + run[-1][2] or offset + length - run[0][1] > RANGE_BYTES):
                    yield made(run)
                    run = []
                run.append((archive, offset, length))
        if run:
            yield made(run)
        ranges.close()

    return rows.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload)


class CaptureIndex:
    """Point lookups. The sparse directory, a row for each BLOCK_LINES captures, is held in memory."""

    def __init__(self, directory: DataFrame):
        rows = sorted((r.first_key.encode(), r.last_key.encode(), r.shard, r.offset, r.length) for r in directory.toLocalIterator())
        self.blocks, self.last = rows, [r[1] for r in rows]

    def find(self, url: str) -> list[tuple]:
        """The captures of a url: (key, page_id, archive, offset, length, record_type, payload_digest)."""
        key, out, ranges = url_key(url), [], Ranges()
        raw = key.encode()
        i = bisect.bisect_left(self.last, raw)
        while i < len(self.blocks) and self.blocks[i][0] <= raw:  # a key may go on in the next block
            _, _, shard, offset, length = self.blocks[i]
            lines = zlib.decompress(ranges.read(shard, offset, length), 31).splitlines()
            keys = [x.partition(b" ")[0] for x in lines]
            out += map(_row, lines[bisect.bisect_left(keys, raw) : bisect.bisect_right(keys, raw)])
            i += 1
        ranges.close()
        return out

    def fetch(self, url: str) -> list[tuple]:
        """The decoded records of a url, as read_captures gives them."""
        ranges = Ranges()
        out = [decode(ranges.read(archive, offset, length)) for _, _, archive, offset, length, _, _ in self.find(url)]
        ranges.close()
        return out
