"""WARC archives with a two-level capture index.

Writing: each task writes its captures as one archive of gzip members, a record each, and gives their places to the
index, whose lines alone are ordered by reversed-host URL key over all tasks. Level one of the index is blocks of sorted
lines, compressed; level two is a sparse directory with each block's first key. A look-up searches the directory, then
reads one block's byte range, searches its lines, and reads one record's byte range.

Archives and blocks are files in the shared folder, written under a name of the attempt's own, so a task that is run
again after a lost executor leaves no half of a file behind that an index names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, written

LINES_PER_BLOCK = 300
DATE = "2026-01-01T00:00:00Z"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ENTRY = "key string, page_id long, record_type string, archive string, offset long, length long"


@dataclass(frozen=True)
class Archive:
    """index: entries, as a table. directory: (first_key, first_id, last_key, last_id, file, offset, length, lines) of
    each block, by key and page_id."""

    index: DataFrame
    directory: DataFrame


# ---- keys, digests, records


def url_key(url: str | None) -> str:
    """The host's labels reversed and comma-joined, then ")" and the path with query: com,example,www)/a?b=c. Scheme,
    user, a leading www., default ports and fragments are left out; what does not parse sorts under its own text."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        host = ""
    if not host:
        return text
    host = host.removeprefix("www.")
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(pairs: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in pairs), "\r\n"]).encode()


def record(page_id: int | None, url: str, payload: bytes, name: str, refers_to: int | None) -> bytes:
    """A response, or with refers_to a revisit, as one gzip member. A revisit keeps the HTTP headers, of which the length
    is that of the payload it leaves out."""
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = http if refers_to is not None else http + payload
    target = "".join(c if " " < c else f"%{ord(c):02X}" for c in url)
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{name}")]
    if refers_to is not None:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return gzip.compress(_headers(pairs, "WARC/1.1") + body + b"\r\n\r\n", 6, mtime=0)


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record's gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


# ---- files of the shared folder


def _open(url: str):
    """(file system, path in it): any that pyarrow knows, such as file, hdfs or s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else f"file://{url}" if url.startswith("/") else url)


def _read(url: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    system, path = _open(url)
    with system.open_input_file(path) as source:
        for offset, length in ranges:
            yield source.read_at(length, offset)


# ---- writing


def write_records(captures: DataFrame, folder: str) -> DataFrame:
    """Entries (ENTRY) of captures(key, page_id, url, html, payload_digest, refers_to); a task's rows make an archive.

    An archive is streamed to its file: a task holds one batch of rows and the entries of those.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, at, sink = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                sink = sink or system.open_output_stream(f"{path}/{name}", compression=None)
                columns = batch.to_pydict()
                offsets, lengths = [], []
                for page_id, url, html, sha, to in zip(columns["page_id"], columns["url"], columns["html"], columns["payload_digest"], columns["refers_to"], strict=True):
                    data = record(page_id, url or "", (html or "").encode(), sha, to)
                    sink.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                kinds = ["response" if to is None else "revisit" for to in columns["refers_to"]]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), pa.array(kinds, pa.string()), pa.array([f"{folder}/{name}"] * len(kinds), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "page_id", "record_type", "archive", "offset", "length"])
        finally:
            if sink:
                sink.close()

    return captures.select("key", "page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, ENTRY)


def write_index(entries: DataFrame, folder: str, lines_per_block: int) -> DataFrame:
    """The directory over entries, whose tasks each hold a range of keys in order: a row per compressed block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, at, sink, held = f"{uuid.uuid4().hex}.cdx.gz", 0, None, []

        def block(lines):
            nonlocal at, sink
            sink = sink or system.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode(), 6, mtime=0)
            sink.write(data)
            at += len(data)
            return [lines[0]["key"], lines[0]["page_id"], lines[-1]["key"], lines[-1]["page_id"], f"{folder}/{name}", at - len(data), len(data), len(lines)]

        try:
            for batch in batches:
                held += batch.to_pylist()
                done = []
                while len(held) >= lines_per_block:
                    done.append(block(held[:lines_per_block]))
                    held = held[lines_per_block:]
                if done:
                    yield _blocks(done)
            if held:
                yield _blocks([block(held)])
        finally:
            if sink:
                sink.close()

    return entries.mapInArrow(run, "first_key string, first_id long, last_key string, last_id long, file string, offset long, length long, lines long")


def _blocks(rows: list[list]) -> pa.RecordBatch:
    names = ["first_key", "first_id", "last_key", "last_id", "file", "offset", "length", "lines"]
    kinds = [pa.string(), pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def base32_of_hex(value: Column) -> Column:
    """Bare base32 of 40 hex digits: each 10 digits are 40 bits, so 8 letters."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    part = lambda k: F.conv(F.substring(value, 1 + 10 * k, 10), 16, 10).cast("long")
    letter = lambda k, i: F.get(letters, F.shiftright(part(k), 35 - 5 * i).bitwiseAND(F.lit(31).cast("long")).cast("int"))
    return F.concat(*[letter(k, i) for k in range(4) for i in range(8)])


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, lines_per_block: int = LINES_PER_BLOCK) -> Archive:
    """Writes a record per row of pages(page_id, url, html). Of equal payloads of at least min_bytes, the one of the
    greatest page_id is a response and the others revisit it; a null page_id never has others revisit it unless all are
    null. Null html is an empty payload, a null url an empty one; repeated rows get a record each."""

    def keys(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], [*batch.schema.names, "key"])

    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = page.mapInArrow(keys, "page_id long, url string, html string, key string")
    named = keyed.withColumns({"size": F.octet_length("html").cast("long"), "payload_digest": base32_of_hex(F.sha1(F.encode("html", "UTF-8")))})
    firsts = page.select("page_id", F.octet_length("html").cast("long").alias("size"), base32_of_hex(F.sha1(F.encode("html", "UTF-8"))).alias("payload_digest"))
    firsts = firsts.groupBy("payload_digest", "size").agg(F.max("page_id").alias("first")).filter(F.col("size") >= min_bytes)
    # a payload that a third of all pages have is a hot key; the other side has one row for it, so Spark splits it
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    captures = named.join(firsts, ["payload_digest", "size"], "left").select("key", "page_id", "url", "html", "payload_digest", refers.alias("refers_to"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = written(write_records(captures, f"{folder}/archives"), "capture-entries")  # only entries are put in order
    sorted_entries = entries.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    return Archive(entries, written(write_index(sorted_entries, f"{folder}/index", lines_per_block), "capture-directory"))


# ---- reading


def _entries(file: str, offset: int, length: int) -> list[dict]:
    return [json.loads(x) for x in gzip.decompress(next(_read(file, [(offset, length)]))).decode().split("\n")[:-1]]


def read_captures(directory: DataFrame) -> DataFrame:
    """Every record that the index names, read from the archives block by block: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload. A revisit's size and digest are those of the payload it refers to."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield _records(_entries(block["file"], block["offset"], block["length"]))

    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.repartition(n, "file", "offset").mapInArrow(run, CAPTURE)


def _records(entries: list[dict]) -> pa.RecordBatch:
    """The records of index lines, an archive's in one pass over the file."""
    by_archive: dict[str, list[dict]] = {}
    for e in entries:
        by_archive.setdefault(e["archive"], []).append(e)
    out = [_row(member) for archive, found in by_archive.items() for member in _read(archive, sorted((e["offset"], e["length"]) for e in found))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], [f.split()[0] for f in CAPTURE.split(", ")])


def _order(key: str, page_id: int | None) -> tuple:
    """Index lines are in this order; Spark puts nulls first, and strings in that of their UTF-8."""
    return key.encode(), page_id is not None, page_id or 0


def look_up(wanted: DataFrame, archive: Archive) -> DataFrame:
    """The captures of wanted(key, page_id), as read_captures() gives them: of each distinct pair, all records.

    The pairs are dealt by ranges of (key, page_id), so a URL that a third of all captures have is spread. A task goes
    through its pairs in order, reads that part of the directory that a batch of them spans, finds the blocks of a pair
    by binary search there, reads their byte ranges, finds the lines by binary search, and reads the records' ranges."""
    blocks = archive.directory.written_to

    def run(batches) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        held: dict[tuple, tuple] = {}  # the last blocks read, by place
        system, path = _open(blocks)
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if not pairs:
                continue
            spans = (ds.field("last_key") >= pairs[0][0]) & (ds.field("first_key") <= pairs[-1][0])
            found = ds.dataset(path, filesystem=system, format="parquet").to_table(filter=spans).to_pylist()
            found.sort(key=lambda b: (_order(b["first_key"], b["first_id"]), _order(b["last_key"], b["last_id"])))
            first, last = [_order(b["first_key"], b["first_id"]) for b in found], [_order(b["last_key"], b["last_id"]) for b in found]
            lines: list[dict] = []
            for pair in pairs:
                at = _order(*pair)
                for b in found[bisect_left(last, at) : bisect_right(first, at)]:
                    place = (b["file"], b["offset"])
                    if place not in held:
                        if len(held) > 8:
                            held.clear()
                        entries = _entries(b["file"], b["offset"], b["length"])
                        held[place] = entries, [_order(e["key"], e["page_id"]) for e in entries]
                    entries, keys = held[place]
                    lines += entries[bisect_left(keys, at) : bisect_right(keys, at)]
                if len(lines) >= LINES_PER_BLOCK:
                    yield _records(lines)
                    lines = []
            if lines:
                yield _records(lines)

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.select("key", "page_id").distinct().repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, CAPTURE)


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").rstrip(">")
    return int(text) if text else None


def _row(member: bytes) -> tuple:
    """A record's columns; a response's digest and size are those of the payload read, which the headers must match."""
    fields, http, payload = parse(member)
    named, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
    response = fields["WARC-Type"] == "response"
    if response and (digest(payload), len(payload)) != (named, size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return _number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, named, fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), payload if response else None


class Directory:
    """The sparse directory in memory, a row per block, for look-ups by URL."""

    def __init__(self, blocks: list[dict]):
        self.blocks = sorted(blocks, key=lambda b: (b["first_key"], b["last_key"]))
        self.first, self.last = [b["first_key"] for b in self.blocks], [b["last_key"] for b in self.blocks]

    def entries(self, url: str) -> list[dict]:
        """The index lines of a URL: a search among blocks, then among the lines of those that can have it."""
        key = url_key(url)
        out = []
        for b in self.blocks[bisect_left(self.last, key) : bisect_right(self.first, key)]:
            lines = _entries(b["file"], b["offset"], b["length"])
            keys = [x["key"] for x in lines]
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        return out

    def captures(self, url: str) -> list[tuple]:
        return [_row(next(_read(e["archive"], [(e["offset"], e["length"])]))) for e in self.entries(url)]


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and looks each of them up by its URL's key: page_id, payload_bytes,
    payload_digest, record_type, refers_to, a row per row of pages; an empty table gives no row, other columns are not
    looked at."""
    found = write_archive(pages, scratch_path(spark, "warc"), min_bytes)
    return look_up(found.index, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
