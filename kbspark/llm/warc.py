"""WARC archives: a writer that records repeated payloads as revisits, and a splittable reader."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, fresh_path, marked, own_id, store

#: Bytes after which a writer starts another file, of one reader task's range, and that are decoded at a time (at first, at most).
FILE_BYTES, SPLIT_BYTES, FEED, MOST_FEED = 64_000_000, 4_000_000, 1 << 14, 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1_000


def record(kind: str, page_id: int | str | None, url: str | None, payload: bytes | None, digest: str, date: str, refers_to: int | str | None = None, length: int | None = None) -> bytes:
    """One gzip member. A revisit has the HTTP header with the length and the digest of the payload, not the payload."""

    def page(id_: int | str | None) -> str:
        return f"<urn:page:{'none' if id_ is None else quote(str(id_), safe='-')}>"

    payload = payload or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http if kind == "revisit" else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _sha1(payload: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(payload, F.lit(""))))


def choose_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """_id, _url, _digest, _n (bytes) and refers_to of the rows whose payload of REVISIT_BYTES or more a row with a larger id has
    too. Rows with null ids are never among them."""
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit("")))
    rows = pages.select(own_id(pages, id_col)[0].alias("_id"), F.col(url_col).alias("_url"), _sha1(F.col(payload_col)).alias("_digest"), size.cast("long").alias("_n"))
    rows = store(rows.where(f"_n >= {REVISIT_BYTES} AND _id IS NOT NULL"), "payloads").df
    groups = store(rows.groupBy("_digest").agg(F.max("_id").alias("refers_to"), F.count(F.lit(1)).alias("_count")).where("_count > 1"), "winners").df
    return attach(rows, groups, "_digest", "_count", rows.count()).where("_id < refers_to").drop("_count")


def _write(folder: str, date: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        out, size, n, name = None, 0, 0, ""
        done = []
        for batch in source:
            for page_id, url, html, digest, length, refers_to in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_html", "_digest", "_n", "refers_to")), strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = files.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                if digest is None:
                    payload = (html or "").encode("utf-8", "replace")
                    data = record("response", page_id, url, payload, hashlib.sha1(payload).hexdigest(), date)
                else:
                    data = record("revisit", page_id, url, None, digest.hex(), date, refers_to, length)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "size", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: dt.datetime | None = None) -> DataFrame:
    """Write a record per row and return the stored list of files: path, size, records.

    Of rows with equal payloads of at least REVISIT_BYTES that with the largest id is a response, the others revisit it; if
    several rows have that id, all are responses. Null payloads are empty; rows with null ids are responses named none; rows
    with equal ids are written each. Ids are integers or ordered as strings. Other columns are ignored. An empty table gives no
    files. date (default: now) is that of all records. Responses are written where they are read, but for rows that a bitmap
    of the revisits' ids can't clear; revisits are written from digests and lengths, so a payload that thousands share moves
    no more than once a row. A task writes files of its own under fresh names, and only files of tasks that ended are listed:
    what a lost executor left is never read. folder must be shared (default: under spark.checkpoint.dir).
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    when = (date or dt.datetime.now(dt.UTC)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    files, top = fs.FileSystem.from_uri(folder)
    files.create_dir(top, recursive=True)
    id_, kind, _ = own_id(pages, id_col)
    revisits = store(choose_revisits(pages, id_col, url_col, payload_col), "revisits").df
    gone = store(revisits.groupBy(F.struct("_id", "_digest").alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_gone", F.col("_key._id")), "gone").df
    rows = marked(pages.select(id_.alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_html")), F.col("_id"), gone, "_gone")
    clear = ~F.col("_maybe") | F.col("_id").isNull()
    held = rows.where(~clear).withColumn("_key", F.struct("_id", _sha1(F.col("_html")).alias("_digest")))
    held = attach(held, gone, "_key", "_rows", revisits.count(), "left_anti")
    responses = rows.where(clear).select("_id", "_url", "_html").unionByName(held.select("_id", "_url", "_html"))
    responses = responses.select("*", F.lit(None).cast("binary").alias("_digest"), F.lit(None).cast("long").alias("_n"), F.lit(None).cast(kind).alias("refers_to"))
    records = responses.unionByName(revisits.withColumn("_html", F.lit(None).cast("string")))
    return store(records.mapInArrow(_write(folder, when), "path string, size long, records long"), "archives").df


class Members:
    """The gzip members of a file that hold WARC records, as one reader from its start would meet them.

    Such a reader is always at some place. If a whole member with a record begins there, the next place is the member's end;
    if not, the bytes up to the next place where one does are broken. So where a member ends decides what is one: what
    looks like a member inside another's bytes is none, unless the bytes before it are broken.
    """

    def __init__(self, handle: pa.NativeFile, start: int, end: int) -> None:
        self.handle, self.start, self.end = handle, start, end
        handle.seek(start)
        self.block = handle.read(end - start + len(MAGIC) - 1)

    def _bytes(self, at: int) -> Iterator[bytes]:
        """The file from a place on, in growing pieces; beyond the range it is read as needed."""
        size = FEED
        while piece := self.block[at - self.start : at - self.start + size]:
            yield piece
            at, size = at + len(piece), min(2 * size, MOST_FEED)
        self.handle.seek(at)
        while piece := self.handle.read(size):
            yield piece
            size = min(2 * size, MOST_FEED)

    def member(self, at: int, keep: bool) -> tuple[int, bytes] | None:
        """The end of the member at a place, and its bytes if they are to be kept; None if no whole record is there."""
        unpack, head, out, fed = zlib.decompressobj(31), b"", [], at
        for piece in self._bytes(at):
            fed += len(piece)
            while True:
                try:
                    data = unpack.decompress(piece, MOST_FEED)
                except zlib.error:
                    return None
                if len(head) < 7:
                    head = (head + data)[:7]
                    if not b"WARC/1.".startswith(head):
                        return None
                if keep:
                    out.append(data)
                if unpack.eof or not (piece := unpack.unconsumed_tail):
                    break
            if unpack.eof:
                return (fed - len(unpack.unused_data), b"".join(out)) if len(head) == 7 else None
        return None

    def candidates(self, at: int) -> Iterator[int]:
        """Places from at on, within the range, with the magic of a member."""
        found = self.block.find(MAGIC, at - self.start)
        while 0 <= found < self.end - self.start:
            yield self.start + found
            found = self.block.find(MAGIC, found + 1)

    def exits(self) -> list[tuple[int, int]]:
        """Where a reader leaves the range, by where it enters: (up to this place, it leaves there), in order.

        Beyond the last of these it meets nothing and goes on with the next range.
        """
        known = [(c, m[0]) for c in self.candidates(self.start) if (m := self.member(c, False))]
        places, out = [c for c, _ in known], [0] * len(known)
        for i in range(len(known) - 1, -1, -1):
            e = known[i][1]
            j = bisect_left(places, e)
            out[i] = e if e >= self.end else out[j] if j < len(out) else self.end
        return [(c, x) for i, (c, x) in enumerate(zip(places, out, strict=True)) if i == len(out) - 1 or out[i + 1] != x]

    def read(self, at: int) -> Iterator[tuple[int, int, bytes | None]]:
        """Start, end and content of what a reader that is at a place meets in the range; no content: broken bytes."""
        while at < self.end:
            if found := self.member(at, True):
                yield at, *found
                at = found[0]
                continue
            ahead = next((c for c in self.candidates(at + 1) if self.member(c, False)), None)
            to = self.start + len(self.block) if ahead is None else ahead
            yield at, min(to, self.end), None
            at = self.end if ahead is None else ahead


def parse(data: bytes) -> tuple[dict[str, str], bytes, int | None]:
    """Header fields by lower-case name, the payload, and the length that it has or (of a revisit) had.

    The payload of an HTTP message is its body; that of any other record (warcinfo, metadata, resource, ...) is its block.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = fields.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, block, len(block)
    http, _, body = block.partition(b"\r\n\r\n")
    if fields.get("warc-type") != "revisit":
        return fields, body, len(body)
    size = _fields(http).get("content-length", "")
    return fields, body, int(size) if size.isdigit() else None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _list_exits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, name = fs.FileSystem.from_uri(path)
            with files.open_input_file(name) as handle:
                found = Members(handle, start, end).exits()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([[c for c, _ in found]], pa.list_(pa.int64())), pa.array([[x for _, x in found]], pa.list_(pa.int64()))], names=["path", "start", "upto", "leaves"])


def _enter(table: pa.Table) -> pa.Table:
    """Where the reader of a file enters each of its ranges, from range to range."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("path", "start", "end", "upto", "leaves")), strict=True))
    at, out = 0, []
    for path, start, end, upto, leaves in rows:
        if at < end:
            out.append((path, start, end, at))
            k = bisect_left(upto or [], at)
            at = leaves[k] if upto and k < len(upto) else end
    return pa.table([pa.array(c) for c in zip(*out, strict=True)], names=["path", "start", "end", "enter"])


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
_BROKEN = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64())])


def _read(broken: bool):
    schema = _BROKEN if broken else _RECORD

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, start, end, enter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_file(name) as handle:
                    for offset, to, data in Members(handle, start, end).read(enter):
                        if broken != (data is None):
                            continue
                        if broken:
                            rows.append((path, offset, to - offset))
                            continue
                        h, payload, length = parse(data)
                        refers_to = h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None
                        rows.append((path, offset, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), refers_to, h.get("warc-payload-digest"), length, payload))
                        size += len(payload)
                        if size > 8_000_000:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return run


def _ranges(archives: DataFrame, split_bytes: int) -> DataFrame:
    """The ranges of all files, each with where a reader of its file enters it; ranges that it skips are left out. Stored."""
    cut = archives.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"))
    cut = cut.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"), "size")
    tasks = int(min(20_000, max(1, -(-(archives.agg(F.sum("size")).first()[0] or 1) // SPLIT_BYTES))))
    inner = cut.where("end < size").select("path", "start", "end").repartition(tasks, "path", "start")
    exits = inner.mapInArrow(_list_exits, "path string, start long, upto array<long>, leaves array<long>")
    entered = cut.join(exits, ["path", "start"], "left").groupBy("path").applyInArrow(_enter, "path string, start long, end long, enter long")
    return store(entered, "ranges").df.repartition(tasks, "path", "start")


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files listed in archives (path, size), each with its file, offset, header fields and payload.

    A file is cut into byte ranges. Tasks look for gzip magic, tell members that hold records from chance hits by decoding
    them, and own those that begin in their range. Which members there are is settled as one reader from the file's start
    would do: first each range but the last of its file tells where such a reader leaves it, for every place where it may
    enter; these are followed from range to range; then each range is read from where it is entered. So the same records are
    found however files are cut, and records inside the payload of others are none. A member must hold one record.
    Broken bytes are skipped; find_broken() lists them. Repeated paths give repeated records; empty files and an empty list
    give none. Memory: a range and a record.
    """
    schema = "path string, offset long, record_type string, record_id string, target_uri string, date string, content_type string, refers_to string, payload_digest string, payload_length long, payload binary"
    return _ranges(archives, split_bytes).mapInArrow(_read(False), schema)


def find_broken(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, offset and bytes of what read_archives() skips; a stretch over several ranges comes in pieces."""
    return _ranges(archives, split_bytes).mapInArrow(_read(True), "path string, offset long, bytes long")
