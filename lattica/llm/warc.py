"""WARC archives with a two-level capture index.

Records are gzip members of their own, so one is read by a single range read.  Level one of the
index holds a line a capture, sorted by reversed-host URL key and cut into compressed blocks; level
two is a sparse directory with each block's first key and place, at the end of each index file.  A
look-up bisects the files by their first keys, the directory of a file, and the lines of one block,
and reads the record.  There are few files (a row each in the manifest, one per INDEX_LINES
captures), so tasks can hold their list.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import files
from lattica.llm.common import BROADCAST_KEYS, PIECE_ROWS, Kept, col, new_path, sliced

#: Bytes of an archive, lines of an index block and of an index file, and bytes of records that a task reads, about.
ARCHIVE_BYTES, BLOCK_LINES, INDEX_LINES, READ_BYTES = 64 << 20, 1000, 50_000, 16 << 20
_DATE = "2024-01-01T00:00:00Z"
_LEVEL = 3


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query, lower-case: ``http://www.A.com/x?y`` is ``com,a,www)/x?y``.

    The scheme and the fragment don't count; a null or unreadable URL gives its own text.
    """
    if not url:
        return ")/"
    try:
        found = urlsplit(url.strip())
        host, port = (found.hostname or ""), found.port
    except ValueError:
        return url.lower()
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = f"?{found.query}" if found.query else ""
    return f"{place}){found.path or '/'}{query}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str | None) -> str:
    """A URL as one header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: int | None, place: str = "") -> bytes:
    """A response, or with ``first`` a revisit of that page's response, as one gzip member.

    A record's id names the page and its payload's digest; ``place`` tells rows that repeat both apart.
    """
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{sha1}{place and f':{place}'}>",
        *([] if url is None else [f"WARC-Target-URI: {_header_value(url)}"]),
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}:{sha1}>"]
    lines.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", _LEVEL, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record's gzip member; a revisit has no payload."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.lstrip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _page(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").partition(":")[0]
    return int(inner) if inner else None


_CAPTURE = "key string, page_id long, path string, place long, size long"


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows, name = [], 0, [], uuid.uuid4().hex

        def flush():
            nonlocal held, size, rows, name
            path = files.write(folder, ".warc.gz", held)
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array([path] * len(rows)), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["key", "page_id", "path", "place", "size"]
            )
            held, size, rows, name = [], 0, [], uuid.uuid4().hex
            return out

        for batch in batches:
            for page_id, url, html, sha1, first, repeated in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()), *(batch.column(i).to_pylist() for i in range(3, 6))):
                place = f"{name}:{size}" if repeated or page_id is None else ""
                raw = record(page_id, url, html.as_py() or b"", base64.b32encode(bytes.fromhex(sha1)).decode(), first, place)
                rows.append((url_key(url), page_id, size, len(raw)))
                held.append(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


_MANIFEST = "first_key string, last_key string, path string, place long, size long"


def _write_index(folder: str):
    """An index file a task: blocks of sorted lines, then the directory of their first keys and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, directory, place, lines = [], [], 0, []
        first, last = None, None

        def block():
            nonlocal place, lines
            raw = zlib.compress("\n".join(x for _, x in lines).encode(), 6)
            directory.append((lines[0][0], place, len(raw)))
            held.append(raw)
            place += len(raw)
            lines = []

        for batch in batches:
            for key, *rest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                first, last = key if first is None else first, key
                lines.append((key, json.dumps([key, *rest])))
                if len(lines) >= BLOCK_LINES:
                    block()
        if lines:
            block()
        if held:
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            path = files.write(folder, ".cdx", [*held, raw])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, path, place, len(raw))], ["first_key", "last_key", "path", "place", "size"])

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes a record per row and the index of all; the manifest (first_key, last_key, path, place, size) of its files and their directories.

    Of the rows whose payloads are equal and of at least ``min_bytes`` bytes, the one with the least
    id is the response and the others revisit it.  A null payload is empty.  Rows that repeat an id
    and a payload are a response each, told apart in their record ids by their place; a null id is a
    response of its own.  A null URL has no header and the key of an empty one.  Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    html = col(payload_column).cast("binary")
    rows = pages.select(col(id_column).cast("long").alias("page_id"), col(url_column).cast("string").alias("url"), html.alias("html"), F.sha1(F.coalesce(html, F.lit(b""))).alias("sha1"))
    signed = rows.where("page_id IS NOT NULL").where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes)
    digests = Kept(signed.groupBy("page_id", "sha1").agg(F.count("*").alias("n")), "digests").df
    firsts = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha1", "first")
    revisits = digests.join(firsts, "sha1").where("page_id > first").select("page_id", "sha1", "first", (F.col("n") > 1).alias("repeated"))
    repeats = digests.where("n > 1").join(firsts, "sha1", "left").where("first IS NULL OR page_id = first").select("page_id", "sha1", F.lit(None).cast("long").alias("first"), F.lit(True).alias("repeated"))
    marks = Kept(revisits.union(repeats), "marks").df
    few = marks.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    told = rows.join(F.broadcast(marks) if few else marks, ["page_id", "sha1"], "left").select("page_id", "url", "html", "sha1", "first", F.coalesce("repeated", F.lit(False)))
    captures = Kept(told.mapInArrow(sliced(_write_archives(folder)), _CAPTURE), "captures").df
    count = max(1, -(-captures.count() // INDEX_LINES))
    ordered = captures.repartitionByRange(count, "key", F.col("page_id").asc_nulls_first(), "path", "place").sortWithinPartitions("key", F.col("page_id").asc_nulls_first(), "path", "place")
    return Kept(ordered.mapInArrow(sliced(_write_index(folder)), _MANIFEST), "manifest").df


class Index:
    """Look-ups in the files of a manifest's rows (first_key, last_key, path, place, size)."""

    def __init__(self, manifest: list[tuple[str, str, str, int, int]]):
        self.files = sorted(manifest, key=lambda x: (x[0], x[1], x[2]))
        self.firsts = [x[0] for x in self.files]
        self.reader, self.open, self.directory, self.keys = files.Reader(), "", [], []
        self.block, self.lines = (), []

    def files_of(self, key: str) -> list[int]:
        """Numbers of the files that may hold the key: the last one that begins before it, and those that begin with it."""
        at = max(0, bisect_left(self.firsts, key) - 1)
        return [i for i in range(at, bisect_right(self.firsts, key)) if self.files[i][1] >= key]

    def in_file(self, number: int, key: str) -> Iterator[list]:
        """(key, page_id, path, place, size) of each of the key's captures in a file, whose directory and last block stay in memory."""
        _, _, path, place, size = self.files[number]
        if path != self.open:
            self.directory = json.loads(zlib.decompress(self.reader.read(path, place, size)))
            self.open, self.keys, self.block = path, [x[0] for x in self.directory], ()
        for b in range(max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)):
            if self.block != (path, b):
                raw = self.reader.read(path, *self.directory[b][1:])
                self.block, self.lines = (path, b), [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]
            i = bisect_left(self.lines, key, key=lambda x: x[0])
            while i < len(self.lines) and self.lines[i][0] == key:
                yield self.lines[i]
                i += 1

    def captures(self, url: str | None) -> list[list]:
        key = url_key(url)
        return [c for i in self.files_of(key) for c in self.in_file(i, key)]

    def read(self, capture: list) -> tuple[dict[str, str], bytes]:
        return parse(self.reader.read(*capture[2:]))


def _place_keys(manifest: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(manifest)
        for batch in batches:
            found = [(i, key) for key in {url_key(u) for u in batch.column(0).to_pylist()} for i in index.files_of(key)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], ["file", "key"])

    return run


def _captures(manifest: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(manifest)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _CAPTURE.split(", ")]
        for batch in batches:
            held = []
            for number, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for capture in index.in_file(number, key):
                    held.append(capture)
                    if len(held) >= PIECE_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        index.reader.close()

    return run


def lookup(manifest: DataFrame, urls: DataFrame, url_column: str = "url") -> DataFrame:
    """(key, page_id, path, place, size) of every capture of the URLs, each once, however often a URL is asked.

    The list of index files is known to every task.  Keys are dealt to the files that may hold them
    and sorted, so a file is read forward, by one task, its directory once.
    """
    known = [tuple(r) for r in manifest.select(*[x.split()[0] for x in _MANIFEST.split(", ")]).collect()]  # a row per INDEX_LINES captures
    asked = urls.select(col(url_column).cast("string").alias("url")).mapInArrow(sliced(_place_keys(known)), "file long, key string").distinct()
    count = max(1, len(known))
    dealt = asked.repartitionById(count, F.col("file").cast("int")).sortWithinPartitions("file", "key")
    return dealt.mapInArrow(sliced(_captures(known)), _CAPTURE)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.Reader()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for path, place, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                headers, payload = parse(reader.read(path, place, size))
                revisit = headers["warc-type"] == "revisit"
                sha1 = headers["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and digest(payload) != sha1:
                    raise ValueError(f"damaged record in {path} at {place}")
                length = int(headers["x-payload-length"]) if revisit else len(payload)
                rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), length, sha1, headers["warc-type"], _page(headers["warc-refers-to"]) if revisit else None, payload if payloads and not revisit else None))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _RECORD.split(", ")])
        reader.close()

    return run


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The record of every capture, verified by its digest; a revisit has no payload of its own.

    Captures are dealt by archive, in the order of their places, so an archive is read forward.
    """
    known = Kept(captures.select("path", "place", "size"), "asked").df
    count = max(1, -(-(known.agg(F.sum("size")).first()[0] or 0) // READ_BYTES))
    dealt = known.repartitionByRange(count, "path", "place").sortWithinPartitions("path", "place")
    return dealt.mapInArrow(sliced(_records(payloads)), _RECORD)
