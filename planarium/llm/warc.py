"""WARC archives with a two-level capture index.

write() puts a record for each page into gzip members of archive files. Captures are then sorted by their keys, URLs with
reversed hosts, and cut into blocks of lines; blocks are compressed one by one into index files, and a sparse directory
keeps each block's first key and place. A lookup searches the directory by bisection, reads the blocks that may hold the
key, and reads the records of its captures, all by byte ranges. Files lie in the shared folder and are reached by its
URI; a task's file has a name of its own, and only files of tasks that ended well are named in the tables.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, prepare, shared_path, written

#: Lines to an index block; bytes to an archive file; rows of the directory that may be broadcast at once (beyond, it is
#: taken in parts); bytes of neighbouring records that are read at once.
LINES, FILE_BYTES, DIRECTORY_ROWS, READ_BYTES = 3000, 256 << 20, 200_000, 4 << 20
#: Bytes of an archive file that one task reads; parts that pages of one payload are dealt into.
SPAN, PARTS = 16 << 20, 64
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def key_of(url: str | None) -> str:
    """`com,example,www)/path?query`: the host's labels reversed, lower-cased, then path and query as they are."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:  # not a URL
        return ")" + quote((url or "").strip(), safe="/?&=%")
    path = parts.path or ("/" if host else "")
    return ",".join(reversed(host.split("."))) + ")" + path + ("?" + parts.query if parts.query else "")


def _record(kind: str, page: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record, names in lower case."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = [dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:]))]
    block = rest[: int(fields[0]["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields.append(dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])))
    return fields[0], fields[1], payload


class _Files:
    """Appends to files of this task in a folder, a new one when the last is full."""

    def __init__(self, folder: str, suffix: str, most: int):
        self.system, self.folder = FileSystem.from_uri(folder)
        self.uri, self.suffix, self.most, self.out = folder, suffix, most, None

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at + len(data) > self.most > 0 < self.at:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.system.create_dir(self.folder, recursive=True)
            self.out, self.at = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
        self.out.write(data)
        self.at += len(data)
        return f"{self.uri}/{self.name}", self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Reader:
    """Reads byte ranges, keeping the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def range(self, uri: str, offset: int, size: int) -> bytes:
        if uri != self.uri:
            system, path = FileSystem.from_uri(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(size, offset)


_CAPTURES = "key string, page_id long, digest string, kind string, file string, at long, size long"


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


#: Where the JSON of an index line starts: a key may hold this too, but in JSON its quotes are escaped.
_START = ' {"key": '


def block_of(captures: list[dict]) -> bytes:
    """An index block: a line for each capture, its key and the whole of it as JSON."""
    return gzip.compress("".join(r["key"] + " " + json.dumps(r) + "\n" for r in captures).encode(), 6, mtime=0)


def lines_of(block: bytes) -> Iterator[tuple[str, str]]:
    """(key, JSON) of each line of an index block."""
    for line in gzip.decompress(block).decode().split("\n")[:-1]:
        name, _, rest = line.rpartition(_START)
        yield name, _START[1:] + rest


def write(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write archives and their index for pages (page_id, url, html); return (captures, directory).

    The payload is html in UTF-8, empty where null. Of records with equal payloads, empty ones too, the one with the
    largest page_id is a response and the others are revisits of it. Rows that repeat the largest page_id are responses
    all; a row without a page_id revisits its payload's response, if one has an id. A null url has an empty key. Other
    columns are not read; no rows give empty tables.

    Only digests travel to find the responses, those of one payload dealt into PARTS tasks; a page meets the result
    under its own page_id, so that no payload, however common, is one task's.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or shared_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    pairs = rows.select("page_id", "sha").distinct().withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)))
    largest = pairs.groupBy("sha", "part").agg(F.max("page_id").alias("kept")).withColumn("kept", F.max("kept").over(Window.partitionBy("sha")))
    again = pairs.join(largest, ["sha", "part"]).where("kept is not null and not page_id <=> kept").select(F.col("page_id").alias("again"), F.col("sha").alias("same"), "kept")
    marked = rows.join(again, F.expr("page_id <=> again and sha = same"), "left").select("page_id", "url", "html", "sha", "kept")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(f"{folder}/archive", ".warc.gz", FILE_BYTES)
        for batch in batches:
            out = []
            for k in range(len(batch)):
                page, url, html, sha, kept = (batch.column(c)[k].as_py() for c in range(5))
                payload, digest = html.encode(), base64.b32encode(bytes.fromhex(sha)).decode()
                kind = "response" if kept is None else "revisit"
                data = gzip.compress(_record(kind, page, url, digest, len(payload), payload if kind == "response" else b"", kept), 6, mtime=0)
                file, at = files.append(data)
                out.append((key_of(url), page, digest, kind, file, at, len(data)))
            yield _columns(out, _CAPTURES)
        files.close()

    captures = written(arrow(marked, archive, _CAPTURES), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(f"{folder}/index", ".cdx.gz", 0)
        held: list[dict] = []

        def block() -> pa.RecordBatch:
            data = block_of(held)
            file, at = files.append(data)
            return _columns([(held[0]["key"], held[-1]["key"], file, at, len(data))], _DIRECTORY)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == LINES:
                    yield block()
                    held.clear()
        if held:
            yield block()
        files.close()

    ordered = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    return captures, written(arrow(ordered, index, _DIRECTORY), "directory")


_DIRECTORY = "first string, last string, file string, at long, size long"


def lookup(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of each distinct key (column key), read from index blocks that the directory points to.

    Null keys and keys without a capture give no rows, as does an empty directory; a key that repeats gives its captures
    once, and captures that are equal in all columns come back as often as they are there. Other columns are not read.
    """
    spark = prepare(directory.sparkSession)
    wanted = keys.select("key").where("key is not null").distinct()
    asked = written(wanted.repartitionByRange("key").sortWithinPartitions("key"), "keys")
    count, out = directory.count(), None
    ranked = directory.orderBy("first", "last", "file", "at")
    for low in range(0, max(1, count), DIRECTORY_ROWS):
        part = spark.sparkContext.broadcast([tuple(r) for r in ranked.offset(low).limit(DIRECTORY_ROWS).collect()])

        def step(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            blocks, reader = part.value, Reader()
            firsts, lines, read = [b[0] for b in blocks], {}, None
            for batch in batches:
                out = []
                for key in batch.column(0).to_pylist():
                    k = max(0, bisect_left(firsts, key) - 1)
                    while k < len(blocks) and firsts[k] <= key:
                        if read != k:
                            read, lines = k, {}
                            for name, line in lines_of(reader.range(*blocks[k][2:])):
                                lines.setdefault(name, []).append(line)
                        for line in lines.get(key, ()):
                            r = json.loads(line)
                            out.append((r["key"], r["page_id"], r["digest"], r["kind"], r["file"], r["at"], r["size"]))
                        k += 1
                        if len(out) >= LINES:
                            yield _columns(out, _CAPTURES)
                            out = []
                yield _columns(out, _CAPTURES)

        rows = arrow(asked, step, _CAPTURES)
        out = rows if out is None else out.union(rows)
    return out


def keys_of(urls: DataFrame) -> DataFrame:
    """The key of each row of urls (column url); a null url has the empty URL's. Rows that repeat give repeated keys."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([key_of(x) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

    return arrow(urls.select(F.col("url").cast("string")), step, "key string")


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def records(captures: DataFrame, texts: bool = False) -> DataFrame:
    """The records of captures, by range reads; html is the payload of responses, or null unless texts is set.

    A response's digest is computed from its payload, and a payload whose digest its record contradicts is an error. A
    revisit has the size and digest of the payload that it revisits. Captures that repeat give repeated rows; none give
    none; other columns are not read. Files are read in spans of SPAN bytes, so as many tasks share the work as the
    records' bytes ask for.
    """
    spark = captures.sparkSession

    def page(urn: str) -> int | None:
        name = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name else None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            files, at, size = (batch.column(k).to_pylist() for k in range(3))
            low = 0
            while low < len(files):  # neighbours in one file are one read
                high, end = low, at[low]
                while high < len(files) and files[high] == files[low] and at[high] == end and (high == low or end - at[low] < READ_BYTES):
                    end += size[high]
                    high += 1
                data, out = reader.range(files[low], at[low], end - at[low]), []
                for k in range(low, high):
                    head, http, payload = parse(zlib.decompress(data[at[k] - at[low] : at[k] - at[low] + size[k]], 31))
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    own = head["warc-type"] == "response"
                    if own and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"damaged record at {at[k]} of {files[k]}")
                    refers = None if own else page(head["warc-refers-to"])
                    out.append((page(head["warc-record-id"]), head.get("warc-target-uri"), int(http["content-length"]), digest, head["warc-type"], refers, payload.decode() if own and texts else None))
                yield _columns(out, _RECORDS)
                low = high

    rows = written(captures.select("file", "at", "size"), "places")
    total = rows.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SPAN))
    span = F.floor(F.col("at") / SPAN)
    return arrow(rows.repartition(tasks, "file", span).sortWithinPartitions("file", "at"), step, _RECORDS)
