"""WARC archives: writing captures as transactions, reading records, assembling transactions.

A capture is a response or a revisit with the request that asked for it and a
metadata record on it, each a gzip member of its own. Crawlers write these into
different files, so does ``write_archives``. ``assemble`` brings them together by
WARC-Concurrent-To, in either direction and over several links (a metadata record
may name the request, the request the response), and returns one nested row per
capture. Payloads that occurred before are revisits of the identical-payload-digest
profile: they carry the digest and no payload, and ``resolve_revisits`` finds the
response with that digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, materialise, ready, scratch_path

#: Compressed bytes after which a task closes a file, and that a reading task takes.
FILE_BYTES, TASK_BYTES = 32 << 20, 64 << 20
#: zlib's level for archives; level 6 takes 1.7 times as long for 3 % less.
LEVEL = 3
#: Records and payload bytes that a reader returns at a time.
BATCH_RECORDS, BATCH_PAYLOAD = 1000, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record types that are a capture by themselves.
CAPTURES = ("response", "revisit", "resource")
_LINE = {c: f"%{c:02X}" for c in [*range(32), 127]}


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a URI; Hadoop's names of object stores are understood."""
    scheme, colon, rest = uri.partition("://")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri)


# ── writing ─────────────────────────────────────────────────────────────────


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def _capture(row: dict, names: tuple[str, str, str], date: str) -> tuple[bytes, bytes]:
    """The response or revisit, and its request with metadata."""
    main, asked, about = (f"<urn:uuid:{n}>" for n in names)
    uri = None if row["url"] is None else row["url"].translate(_LINE)
    payload, kind = row["payload"], "response" if row["first"] is None else "revisit"
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", main), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    if kind == "revisit":
        first = row["first"]["url"]
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", first and first.translate(_LINE)), ("WARC-Refers-To-Date", date)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    try:
        parts = urlsplit(uri or "")
        host, path = parts.netloc.rpartition("@")[2], (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", "/"
    ask = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = f"page-id: {row['page_id']}\r\n".encode() if row["page_id"] is not None else b""
    linked = lambda name: [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main)]
    return _record(kind, headers, head + (payload if kind == "response" else b"")), (
        _record("request", [*linked(asked), ("Content-Type", "application/http;msgtype=request")], ask)
        + _record("metadata", [*linked(about), ("Content-Type", "application/warc-fields")], fields)
    )


def _write(root: str, date: str, file_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(root)
        part, held, n, size, total = TaskContext.get().partitionId(), ([], []), 0, 0, 0

        def close() -> pa.RecordBatch:
            rows = []
            # An attempt's files count only if its rows reach the manifest; others stay unread.
            for kind, blocks, each in zip(("captures", "links"), held, (1, 2), strict=True):
                name = f"{kind}-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                with store.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                    for b in blocks:
                        sink.write(b)
                rows.append({"path": f"{root}/{name}", "n_records": each * n, "n_bytes": sum(map(len, blocks))})
            return pa.RecordBatch.from_pylist(rows)

        run = uuid.uuid4().hex
        for batch in batches:
            for row in batch.to_pylist():
                names = tuple(str(uuid.UUID(hashlib.md5(f"{run}/{total}/{k}".encode()).hexdigest())) for k in range(3))
                main, rest = _capture(row, names, date)
                held[0].append(main)
                held[1].append(rest)
                n, total, size = n + 1, total + 1, size + len(main) + len(rest)
                if size >= file_bytes:
                    yield close()
                    held, n, size = ([], []), 0, 0
        if n:
            yield close()

    return work


def write_archives(pages: DataFrame, root: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives under ``root``; returns the manifest (path, n_records, n_bytes).

    Of pages with one payload of at least ``least`` bytes the one with the
    smallest page_id is a response, others are revisits. A null html is an empty
    payload. A null page_id comes after all others; rows that repeat both the
    payload and its smallest page_id are responses as well, as they cannot refer
    to themselves. A null url gives records without a target. Each row is a
    capture of its own, repeated rows included. Other columns are not read. No
    rows: no files.
    """
    spark = ready(pages.sparkSession)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    # One row per payload that occurs again: narrow, and its join can be split however many rows share a payload.
    firsts = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("d"))
    firsts = firsts.agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    first = F.when(~own, F.struct("first.page_id", "first.url"))
    joined = joined.select("page_id", "url", "payload", "digest", first.alias("first"))
    return materialise(arrow_map(joined, _write(root, date, file_bytes), "path string, n_records long, n_bytes long"), "manifest")


def archive_root(pages: DataFrame) -> str:
    """A fresh folder for archives under the shared scratch folder, as a URI."""
    path = scratch_path(pages.sparkSession, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


# ── reading ─────────────────────────────────────────────────────────────────


def _headers(source: io.BufferedReader, where: str) -> list[list[str]]:
    """Name (lower case) and value of header lines up to the empty one; folded lines continue the value."""
    out: list[list[str]] = []
    while line := source.readline():
        if not line.rstrip(b"\r\n"):
            return out
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and out:
            out[-1][1] = f"{out[-1][1]} {text.strip()}".strip()
        else:
            name, _, value = text.partition(":")
            out.append([name.strip().lower(), value.strip()])
    raise ValueError(f"{where} ends within its headers")


def parse_archive(source: io.BufferedReader, name: str) -> Iterator[tuple[list[list[str]], bytes]]:
    """Headers and block of every record of an uncompressed archive, one at a time."""
    seq = 0
    while line := source.readline():
        if not line.strip():
            continue
        where = f"record {seq} of {name}"
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where} does not begin with its version")
        headers = _headers(source, where)
        length = next((int(v) for k, v in headers if k == "content-length"), None)
        if length is None:
            raise ValueError(f"{where} has no Content-Length")
        block = source.read(length)
        if len(block) < length:
            raise ValueError(f"{where} is cut off")
        yield headers, block
        seq += 1


class Unpacked(io.RawIOBase):
    """The bytes of all gzip members of a file in turn; members are small, so each is fed a little at a time."""

    FEED, CHUNK = 4 << 10, 1 << 20

    def __init__(self, source) -> None:
        self.source, self.chunk, self.at, self.member, self.rest = source, b"", 0, None, b""

    def readable(self) -> bool:
        return True

    def _next(self) -> bytes | None:
        """The next unpacked bytes, None at the end."""
        if self.at >= len(self.chunk):
            self.chunk, self.at = self.source.read(self.CHUNK), 0
            if not self.chunk:
                if self.member is not None:
                    raise EOFError("the archive ends within a compressed record")
                return None
        if self.member is None:
            self.member = zlib.decompressobj(31)
        piece = self.chunk[self.at : self.at + self.FEED]
        out = self.member.decompress(piece)
        self.at += len(piece) - len(self.member.unused_data)
        if self.member.eof:
            self.member = None
        return out

    def readinto(self, into) -> int:
        parts, size = [self.rest], len(self.rest)
        while size < len(into) and (piece := self._next()) is not None:
            parts.append(piece)
            size += len(piece)
        whole = b"".join(parts)
        n = min(len(whole), len(into))
        into[:n], self.rest = whole[:n], whole[n:]
        return n


def opened(path: str) -> io.BufferedReader:
    """An archive of any store that pyarrow knows, unpacked while it is read if it is compressed."""
    store, name = store_of(path)
    source = store.open_input_file(name)
    packed = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    return io.BufferedReader(Unpacked(source) if packed else source, 1 << 20)


def _bare(uri: str) -> str:
    return uri[1:-1] if uri.startswith("<") and uri.endswith(">") else uri


def _fields(block: bytes) -> list[dict]:
    return [{"name": k, "value": v} for k, v in _headers(io.BufferedReader(io.BytesIO(block.rstrip(b"\r\n") + b"\r\n\r\n")), "a record")]


def _row(headers: list[list[str]], block: bytes, payloads: bool) -> dict:
    one, several = {}, []
    for k, v in headers:
        if k == "warc-concurrent-to":
            several.append(_bare(v))
        else:
            one.setdefault(k, v)
    kind, content = one.get("warc-type"), one.get("content-type", "")
    row = {
        "record_type": kind, "record_id": _bare(one["warc-record-id"]) if "warc-record-id" in one else None, "concurrent_to": several,
        "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "declared_digest": one.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "first_line": None, "payload_bytes": None, "payload_digest": None, "fields": [], "payload": None,
    }
    payload = block
    if content.replace(" ", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        row["first_line"] = head.split(b"\r\n", 1)[0].decode("utf-8", "replace")
    if kind in ("response", "resource"):
        row["payload_bytes"] = len(payload)
        row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if payloads:
            row["payload"] = payload
    elif kind == "metadata" and content.startswith("application/warc-fields"):
        row["fields"] = _fields(block)
    return row


_RECORD = (
    "path string, seq long, record_type string, record_id string, concurrent_to array<string>, target_uri string, date string, "
    "declared_digest string, first_line string, payload_bytes long, payload_digest string, fields array<struct<name:string,value:string>>"
)
_ARROW = pa.schema(
    [("path", pa.string()), ("seq", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id")], ("concurrent_to", pa.list_(pa.string())),
     *[(c, pa.string()) for c in ("target_uri", "date", "declared_digest", "first_line")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())]
)


def _read(payloads: bool):
    schema = _ARROW if payloads else pa.schema(list(_ARROW)[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with opened(path) as source:
                    for seq, (headers, block) in enumerate(parse_archive(source, path)):
                        rows.append({"path": path, "seq": seq} | _row(headers, block, payloads))
                        size += len(block) if payloads else 0
                        if len(rows) >= BATCH_RECORDS or size >= BATCH_PAYLOAD:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return work


def read_records(files: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives ``files`` (path, n_bytes), payloads only if asked for.

    payload_bytes and payload_digest (bare base32 SHA-1) are taken from the bytes
    read, for responses and resources; declared_digest is the header's. Archives
    may be compressed or not. A broken record is an error that names its file.
    The records are stored once, so that no later use reads the archives again.
    """
    total = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    schema = _RECORD + (", payload binary" if payloads else "")
    return materialise(arrow_map(files.select("path").repartition(tasks), _read(payloads), schema), "records")


# ── assembling ──────────────────────────────────────────────────────────────


def _members(records: DataFrame) -> DataFrame:
    """record_id and capture (a capture's record_id) of the records that a chain of links leads to a capture.

    A record that leads to several captures goes to the nearest, then to the
    smallest record_id.
    """
    is_capture = F.col("record_type").isin(*CAPTURES)
    named = records.where(F.col("record_id").isNotNull()).select("record_id", is_capture.alias("c"), F.explode("concurrent_to").alias("other"))
    captures = records.where(is_capture & F.col("record_id").isNotNull()).select("record_id").distinct()
    links = named.select(F.col("record_id").alias("a"), F.col("other").alias("b")).union(named.select("other", "record_id"))
    links = materialise(links.where("a <> b").join(captures, F.col("a") == F.col("record_id"), "left_anti").distinct(), "links")
    found = None
    reached = captures.select("record_id", F.col("record_id").alias("capture"))
    while True:
        step = links.join(reached, F.col("b") == F.col("record_id"))
        if found is not None:
            step = step.join(found.select(F.col("record_id").alias("r")), F.col("a") == F.col("r"), "left_anti")
        reached = materialise(step.groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture")), "reached")
        if reached.isEmpty():
            break
        found = reached if found is None else found.union(reached)
    own = captures.select("record_id", F.col("record_id").alias("capture"))
    return own if found is None else own.union(found)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, capture (nested record), requests and metadata (arrays of nested records).

    Records that name each other by concurrent-to, in either direction and over
    any number of links, belong together. A response or revisit without others is
    a capture with empty arrays. Records that lead to no capture, and those
    without a record id, are in no row (``orphans``). A record that is read twice
    counts once; captures with one record id are one, the first by path and place.
    Arrays stand by record id. A row holds its capture whole, so a capture's
    records must fit a task. No records give no rows.
    """
    ready(records.sparkSession)
    inner = [c for c in records.columns if c not in ("path", "seq", "concurrent_to")]
    joined = records.join(_members(records).select(F.col("record_id").alias("_r"), "capture"), F.col("record_id") == F.col("_r"))
    whole = F.struct(*inner)
    narrow = F.struct(*[c for c in ("record_id", "record_type", "target_uri", "date", "first_line", "fields")])
    is_capture = F.col("record_type").isin(*CAPTURES)
    other = lambda kind: F.sort_array(F.collect_set(F.when(F.col("record_type") == kind, narrow)))
    return joined.groupBy(F.col("capture").alias("capture_id")).agg(
        F.min_by(whole, F.when(is_capture, F.struct("path", "seq"))).alias("capture"), other("request").alias("requests"), other("metadata").alias("metadata")
    )


def orphans(records: DataFrame) -> DataFrame:
    """The records that lead to no capture."""
    known = _members(records).select(F.col("record_id").alias("_r"))
    return records.join(known, F.col("record_id") == F.col("_r"), "left_anti")


def metadata_field(name: str) -> Column:
    """The first value of a field among an assembled capture's metadata."""
    fields = F.flatten(F.transform("metadata", lambda m: m["fields"]))
    return F.get(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"]), F.lit(0))


def resolve_revisits(captures: DataFrame, order: Column) -> DataFrame:
    """Adds payload_bytes, payload_digest and first (order, capture_id, bytes) to assembled captures.

    A revisit takes them from the response with its declared digest, the least by
    ``order`` (nulls last) if there are several; without one they are null but for
    the digest. A response's first is null.
    """
    digest = F.coalesce(F.col("capture.payload_digest"), F.col("capture.declared_digest"))
    rows = captures.withColumn("payload_digest", digest).withColumn("_order", order)
    key = F.struct(F.col("_order").isNull(), F.col("_order").alias("order"), "capture_id", F.col("capture.payload_bytes").alias("bytes"))
    firsts = rows.where(F.col("capture.record_type") != "revisit").groupBy(F.col("payload_digest").alias("_digest")).agg(F.min(key).alias("_first"))
    joined = rows.join(firsts, (F.col("payload_digest") == F.col("_digest")) & (F.col("capture.record_type") == "revisit"), "left")
    first = F.when(F.col("_first").isNotNull(), F.struct("_first.order", "_first.capture_id", "_first.bytes"))
    size = F.coalesce(F.col("capture.payload_bytes"), F.col("_first.bytes"))
    return joined.withColumn("payload_bytes", size).withColumn("first", first).drop("_digest", "_first", "_order")
