"""WARC archives with revisit records and a two-level capture index.

Writing: every task writes its rows as one archive of gzip members in the shared folder and hands
on a capture line for each: reversed-host URL key, id, payload digest, file, offset and length. The
first three name a capture, so rows that share URL and id and differ in payload are told apart, and
records that share all three are equal. Lines are sorted by range into index shards; a shard holds compressed blocks of ``BLOCK`` lines and, beside them, a
sparse directory with the first line of each block. Reading a capture is a binary search among the
shards' first keys, one in the shard's directory, one in the block (a range read), and then a range
read of the archive. Only the list of shards, as long as the index has partitions, is ever on the
driver. Files are named by a fresh token in each attempt, so that a repeated task never overwrites
what another reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint, shared_dir, ship

BLOCK, LEAST_REVISIT, LEVEL = 256, 0, 6
#: The id that stands for null in keys: below all others.
NO_ID = -(1 << 63)
URL = re.compile(r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
CAPTURES = "key string, id long, tag string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, file string, offset long"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: hosts of a domain lie together. Null and relative URLs have an empty host."""
    m = URL.match(url or "")
    host, rest = (m[1], m[2]) if m else ("", url or "")
    name, colon, port = host.lower().partition(":")
    key = ",".join(reversed(name.split("."))) + colon + port + ")" + (rest or "/")
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda c: f"%{ord(c[0]):02X}", key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of ``refers_to`` without the payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    block = http + payload
    raw = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"
    zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zipper.compress(raw) + zipper.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def parse(member: bytes) -> dict:
    """The record of a gzip member: its fields, HTTP fields and payload; damage raises."""
    raw = zlib.decompress(member, 31)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not mark:
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"fields": fields, "http": _fields(http), "payload": payload}


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def facts(found: dict) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to, uri); a response's digest is verified."""
    fields = found["fields"]
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest(found["payload"]) != said:
        raise ValueError("a payload that does not match its digest")
    size = len(found["payload"]) if kind == "response" else int(found["http"]["content-length"])
    return _number(fields["warc-record-id"]), size, said, kind, _number(fields.get("warc-refers-to")), fields["warc-target-uri"]


@dataclass(frozen=True)
class Archive:
    """Where the archives and the index are: shards as (first key, first id, first digest, file), in order."""

    folder: str
    shards: list[tuple[str, int, str, str]]


def named(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"))


def with_origin(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, refers_to``: which record each page revisits, if any.

    Of pages with equal payloads of at least ``least`` bytes the smallest id is the origin. Only
    digests are aggregated; the join hands them back to the rows, and is one that Spark can split.
    """
    keyed = pages.select("*", F.unhex(F.sha1("payload")).alias("sha"))
    first = pages.select("page_id", F.unhex(F.sha1("payload")).alias("sha")).groupBy("sha").agg(F.min("page_id").alias("origin"))
    revisit = (F.length("payload") >= least) & F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return keyed.join(first, "sha").select("page_id", "url", "payload", F.when(revisit, F.col("origin")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, block: int = BLOCK) -> Archive:
    """Write archives and index of ``pages(page_id, url, payload, refers_to)``."""
    spark = ship(pages.sparkSession)
    folder = folder or shared_dir(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page, url, payload, origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page, url, payload, origin)
                out.write(member)
                rows.append((url_key(url), NO_ID if page is None else page, hashlib.sha1(payload).hexdigest(), name, at, len(member)))
                at += len(member)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["key", "id", "tag", "file", "offset", "length"])
        if out is not None:
            out.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.cdx.gz", None, 0
        held: list[tuple] = []
        directory: list[tuple[str, int, str, int, int]] = []

        def flush(n: int) -> None:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            part = zlib.compress("".join(f"{k} {i} {t} {f} {o} {m}\n" for k, i, t, f, o, m in held[:n]).encode(), LEVEL)
            out.write(part)
            directory.append((*held[0][:3], at, len(part)))
            at += len(part)
            del held[:n]

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block:
                flush(block)
        if held:
            flush(len(held))
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx", compression=None) as beside:
                beside.write("".join(f"{k} {i} {t} {o} {m}\n" for k, i, t, o, m in directory).encode())
            # Shards that begin with the same capture are told apart by their range.
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "key": [directory[0][0]], "id": [directory[0][1]], "tag": [directory[0][2]], "file": [name]})

    captures = checkpoint(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(archive, CAPTURES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "id", "tag", "file", "offset"]  # a capture that very many rows repeat is split over shards
    ordered = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(index, "part int, key string, id long, tag string, file string").collect()
    return Archive(folder, [tuple(r)[1:] for r in sorted(shards, key=lambda r: r.part)])


class Reader:
    """Binary searches and range reads over one archive; it keeps a few open files and one block."""

    def __init__(self, archive: Archive):
        self.archive = archive
        self.store, self.root = fs.FileSystem.from_uri(archive.folder)
        self.firsts = [s[:3] for s in archive.shards]
        self.directories: dict[int, list[tuple[str, int, str, int, int]]] = {}
        self.files: dict[str, pa.NativeFile] = {}
        self.block: tuple[tuple[int, int], list[tuple[str, int, str]], list[list[str]]] | None = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)

    def directory(self, shard: int) -> list[tuple[str, int, str, int, int]]:
        if shard not in self.directories:
            self.directories = {shard: []}
            with self.store.open_input_stream(f"{self.root}/{self.archive.shards[shard][3]}.idx", compression=None) as f:
                for line in f.read().decode().splitlines():
                    key, i, tag, offset, length = line.split(" ")
                    self.directories[shard].append((key, int(i), tag, int(offset), int(length)))
        return self.directories[shard]

    def lines(self, shard: int, k: int) -> tuple[list[tuple[str, int, str]], list[list[str]]]:
        """Names and lines of block ``k`` of a shard."""
        if self.block is None or self.block[0] != (shard, k):
            *_, offset, length = self.directory(shard)[k]
            lines = [line.split(" ") for line in zlib.decompress(self.read(self.archive.shards[shard][3], offset, length)).decode().splitlines()]
            self.block = ((shard, k), [(x[0], int(x[1]), x[2]) for x in lines], lines)
        return self.block[1:]

    def locate(self, key: str, page: int, tag: str) -> tuple[str, int, int] | None:
        """File, offset and length of a capture, or None."""
        wanted = (key, page, tag)
        if not self.firsts:
            return None
        shard = max(0, bisect_right(self.firsts, wanted) - 1)
        names, lines = self.lines(shard, max(0, bisect_right(self.directory(shard), (*wanted, 1 << 62)) - 1))
        at = bisect_left(names, wanted)
        if at == len(names) or names[at] != wanted:
            return None
        return lines[at][3], int(lines[at][4]), int(lines[at][5])

    def captures(self, key: str, page: int) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture of a URL key and id."""
        wanted = (key, page, "")
        for shard in range(max(0, bisect_left(self.firsts, wanted) - 1), len(self.firsts)):
            if self.firsts[shard][:2] > wanted[:2]:
                return
            directory = self.directory(shard)
            for k in range(max(0, bisect_left(directory, wanted) - 1), len(directory)):
                if directory[k][:2] > wanted[:2]:
                    return
                for name, line in zip(*self.lines(shard, k), strict=True):
                    if name[:2] == wanted[:2]:
                        yield line[3], int(line[4]), int(line[5])


def read(wanted: DataFrame, archive: Archive, id_col: str = "page_id", url_col: str = "url", tag_col: str | None = None) -> DataFrame:
    """``RECORDS`` for the captures of ``wanted(page_id, url)``, through the index.

    With ``tag_col``, the payload's SHA-1 in hexadecimal digits, a row names one capture and gives one
    record; without it a row gives every capture of its URL and id. What the index lacks gives no row;
    repeated rows are read again each. Requests are dealt by ranges of the index's own order, so that a
    task reads few blocks, and a capture that very many rows want is read by several tasks.
    """
    spark = ship(wanted.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0).fill_null(NO_ID), batch.column(2), batch.column(3)], ["key", "id", "tag", "salt"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        names = [f.split(" ")[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for key, page, tag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                places = reader.captures(key, page) if tag is None else [reader.locate(key, page, tag)]
                rows += [(*facts(parse(reader.read(*place))), *place[:2]) for place in places if place]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    tag = wanted[tag_col].cast("string") if tag_col else F.lit(None).cast("string")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")
    asked = wanted.select(wanted[id_col].cast("long").alias("page_id"), wanted[url_col].cast("string").alias("url"), tag.alias("tag"), salt.alias("salt")).mapInArrow(keyed, "key string, id long, tag string, salt int")
    return asked.repartitionByRange(parts, "key", "id", "tag", "salt").sortWithinPartitions("key", "id", "tag").mapInArrow(fetch, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, then read every record back through the index: the contract's columns.

    A null html is an empty payload; null or repeated ids and URLs are records of their own, and equal
    rows give equal records. A null id never is an origin; where an origin's id repeats, all rows of
    that id are responses. Other columns are not read; payloads are held whole, one at a time; an empty
    table writes nothing and gives no row.
    """
    rows = named(pages)
    archive = write(with_origin(rows))
    wanted = rows.select("page_id", "url", F.sha1("payload").alias("tag"))
    return read(wanted, archive, tag_col="tag").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT)
                  >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM p
"""
