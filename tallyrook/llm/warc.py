"""WARC archives: written one gzip member a record, read back by byte ranges.

Reading needs no index: a task scans its byte range for gzip's magic bytes, takes a
candidate for a record if it decompresses and begins with a WARC header, and owns the
records that start in its range (it reads on past the range's end to finish the last).
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, scratch, written

# What a gzip member and a WARC record begin with.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Of reading; a task has several ranges beyond that.
MOST_TASKS = 50_000

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, position long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str | None) -> str:
    """A header's value stays on one line."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value or "")


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, which tells the length of the
    payload, and the payload's digest, but not the payload."""
    body = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is None:
        head.pop(4)
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): of rows with equal payloads the one with the
    smallest page_id has null there, and the others its page_id. Null html is empty;
    rows that repeat the smallest page_id are all responses; a null page_id never is the
    smallest. Digests are counted before the join, and only those that occur more than
    once go into it; the join's hot keys are split by adaptive execution."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha2("html", 256))
    twice = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").select("key", "first")
    joined = keyed.join(twice, "key", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of (page_id, url, html, refers_to) below folder, one a task. Returns the
    manifest (file, bytes, records), written beside them: a task that is run again writes
    another file, and only those in the manifest count."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, out = 0, 0, None
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        try:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        store, path = _open(name)
                        store.create_dir(os.path.dirname(path), recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    member = record(*row)
                    out.write(member)
                    size += len(member)
                    n += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "bytes", "records"])

    schema = "file string, bytes long, records long"
    rows.select("page_id", "url", "html", "refers_to").mapInArrow(lean(run), schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


@dataclass
class Found:
    position: int
    end: int
    headers: dict[str, str]
    block: bytes | None  # None: a damaged member


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a decompressed record; None if it is none."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return None
    n = int(headers["content-length"])
    return (headers, rest[:n]) if len(rest) >= n else None


def _begins(data: bytes) -> bool:
    """Does a record begin here, whatever comes of the rest?"""
    try:
        return zlib.decompressobj(31).decompress(data, len(VERSION)) == VERSION
    except zlib.error:
        return False


def scan(f, start: int, end: int, step: int = 1 << 20) -> Iterator[Found]:
    """Records of an open file that start in [start, end). A member that begins as a record
    and doesn't decompress to a whole one comes out as damaged."""
    f.seek(start)
    base, buf, eof, at = start, b"", False, start

    def more() -> None:
        nonlocal buf, eof
        got = f.read(step)
        eof = not got
        buf += bytes(got)

    while at < end:
        i = buf.find(MAGIC, at - base)
        if i < 0 or base + i >= end:
            keep = min(len(MAGIC) - 1, len(buf))
            if base + len(buf) - keep >= end or eof:
                return
            at = max(at, base + len(buf) - keep)
            buf, base = buf[at - base :], at
            more()
            continue
        at = base + i
        if i > step:  # what lies behind is let go, a step at a time
            buf, base, i = buf[i:], at, 0
        z, used, raw, bad = zlib.decompressobj(31), i, [], False
        checked = False
        while not z.eof:
            if used == len(buf):
                more()
                if eof:
                    bad = True
                    break
            try:
                part = buf[used : used + 16384]
                raw.append(z.decompress(part))
            except zlib.error:
                bad = True
                break
            used += len(part)
            if not checked:  # the version line shows whether this is a record; its header may be of any length
                head = b"".join(raw)
                if head[: len(VERSION)] != VERSION[: len(head)]:
                    bad = True
                    break
                checked = len(head) >= len(VERSION)
        got = None if bad else parse(b"".join(raw))
        if got is None:
            if checked or _begins(buf[i : i + (1 << 16)]):
                yield Found(at, at, {"warc-type": "damaged"}, None)
            at += 1
            continue
        size = used - i - len(z.unused_data)
        yield Found(at, at + size, *got)
        at += size


def ranges(files: DataFrame, split: int) -> DataFrame:
    """(file, start, end) of pieces of at most `split` bytes of (file, bytes)."""
    cuts = files.where("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))))
    return cuts.select("file", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """(file, bytes) of archives below a folder (the contents are not read here)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read(files: DataFrame, split: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """Records of archives (file, bytes): RECORD's columns. payload_bytes and
    payload_digest are of the full payload, also for revisits, whose payload is null.
    Bytes that belong to no record are passed over; a damaged member is a row of the type
    'damaged' with nothing but its file and position. With payloads=False the payload is
    checked against its digest and left out."""
    tasks = ranges(files, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, p = _open(path)
                rows, held = [], 0
                with store.open_input_file(p) as f:
                    for r in scan(f, start, end):
                        rows.append((*_fields(r, payloads), path, r.position))
                        held += len(r.block or b"") if payloads else 0
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    # a number that is given is not made smaller by the few bytes that name the ranges
    return tasks.repartition(max(1, min(tasks.count(), MOST_TASKS))).mapInArrow(lean(run), RECORD)


def _id(value: str | None) -> int | None:
    number = (value or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def _fields(r: Found, payloads: bool) -> tuple:
    h = r.headers
    if r.block is None:
        return (None, None, "damaged", *[None] * 4)
    http, _, body = r.block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    said = h.get("warc-payload-digest", "").partition(":")[2] or None
    whole = h["warc-type"] != "revisit"
    if whole and said != digest(body):
        raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its digest")
    return _id(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], _id(h.get("warc-refers-to")), length, said, body if whole and payloads else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, split: int = 32 << 20) -> DataFrame:
    """Write every page as a record to archives in the shared folder, read these back,
    and return (page_id, payload_bytes, payload_digest, record_type, refers_to). It is an
    error if other than the manifest's number of records is read, or a damaged one."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write(with_revisits(pages), folder)
    found = read(manifest.select("file", "bytes"), split, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = written(found, "warc-records")
    sent, got = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.where("record_type <> 'damaged'").count()
    if sent != got or found.where("record_type = 'damaged'").count():
        raise ValueError(f"{sent} records were written and {got} read whole")
    return found
