"""WARC files: a splittable reader of gzipped archives, and a writer.

A .warc.gz file is a row of gzip members, one for each record, and has no index.
The reader cuts files into byte ranges, one task each.  A task scans its range
for the gzip magic, tries each candidate by inflating its first bytes and
looking for a WARC header, and from the first true one on reads member by
member; it owns the records that start in its range, and reads the last of
them beyond the range's end.

Magic bytes that occur inside compressed data fail to inflate to a header; where
a member is damaged the task scans on for the next.  A record may itself hold an archive, stored
as it is, whose members look like any other.  So where a file has several ranges they are
walked once before: each says where its first record starts and where the one after its
last; the driver holds each range against the one before it, and those that began with a nested
record are walked again from where the records in fact go on.  So every record
is read once, by one task, and what is read is the same for all ranges as for the
file as one.

Files are opened by pyarrow.fs from the workers, so any file system that it
knows will do, and only bytes that a task needs are read.  Paths and sizes are
listed on the driver, as by Spark's own sources.

The writer gives each task's rows one file under a name of its own with the
task attempt, and returns their paths: those of lost attempts aren't listed.

Nulls: null urls, ids or bodies are written as empty ones; a record without the
headers asked for gives null.  Empty files and tables give no records.  Bodies
may be empty or very long; a task holds one record at a time, and a batch of 16 MB or one record.
Repeated rows give repeated records.  Extra columns of any name aren't read; page ids are
integers or can be cast to them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import col, cut, shared_path

MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 20
_RANGE = "path string, start long, `end` long, size long, entry long"
SCHEMA = "path string, offset long, type string, uri string, record_id string, date string, content_type string, payload binary"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        where, at = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    else:
        where, at = fs.LocalFileSystem(), path
    return where, at


def is_record(head: bytes) -> bool:
    """Whether a gzip member that starts so holds a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(read, at: int, size: int) -> tuple[bytes, int] | None:
    """The member at the offset, and where it ends; None if it is damaged."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            data = read(pos, min(_STEP, size - pos))
            if not data:
                return None
            out.append(z.decompress(data))
            pos += len(data)
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case names, and the block."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    try:
        n = int(fields.get("content-length", ""))
    except ValueError:
        n = len(body)
    return fields, body[:n]


def payload(fields: dict[str, str], block: bytes) -> tuple[str | None, bytes]:
    """Content type and body: of HTTP responses those inside."""
    if fields.get("content-type", "").startswith("application/http"):
        head, sep, body = block.partition(b"\r\n\r\n")
        kind = next((x.partition(":")[2].strip() for x in head.decode("latin-1").split("\r\n")[1:] if x.lower().startswith("content-type:")), None)
        return kind, body if sep else b""
    return fields.get("content-type"), block


def read_range(path: str, start: int, end: int, size: int, entry: int | None = None) -> Iterator[tuple[int, bytes | None]]:
    """(offset, record) of the records that start in [start, end); last, without a record, where the next one starts, or -1 if that isn't known.

    entry is where a record is known to start, if that is known; else it is looked for from start on."""
    where, at = _open(path)
    with where.open_input_file(at) as f:

        def read(pos: int, n: int) -> bytes:
            f.seek(pos)
            return f.read(n)

        pos, known = (start, False) if entry is None else (entry, True)
        while pos < end:
            if not known:
                # the next candidate in the range
                data, found = read(pos, min(_STEP, end + 2 - pos, size - pos)), -1
                i = data.find(MAGIC)
                while i >= 0 and pos + i < end:
                    if is_record(read(pos + i, 4096)):
                        found = pos + i
                        break
                    i = data.find(MAGIC, i + 1)
                if found < 0:
                    if not data or pos + len(data) >= min(end + 2, size):
                        pos = end
                    else:
                        pos += max(1, len(data) - 2)
                    continue
                pos = found
            # from a record on, members follow each other
            member = _member(read, pos, size)
            known = member is not None and member[0].startswith(b"WARC/")
            if known:
                yield pos, member[0]
                pos = member[1]
            else:
                pos += 1
        yield (pos if known else -1), None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, first, next) of ranges: where the first of their records starts, and the next after their last."""
    for b in batches:
        for r in b.to_pylist():
            first, after = None, -1
            for offset, record in read_range(r["path"], r["start"], r["end"], r["size"], r["entry"]):
                if record is None:
                    after = offset
                elif first is None:
                    first = offset
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["start"]]), pa.array([-1 if first is None else first]), pa.array([after])], ["path", "start", "first", "next"])


def _entries(spark: SparkSession, ranges: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int, int | None]]:
    """The ranges, in order, with where their first record starts; None where it is to be looked for."""
    several = {r[0] for r in ranges if r[1]}
    ask, said, entry = {(p, lo): None for p, lo, _, _ in ranges if p in several}, {}, {}
    while ask:
        todo = [(p, lo, hi, n, ask[p, lo]) for p, lo, hi, n in ranges if (p, lo) in ask]
        walked = spark.createDataFrame(todo, _RANGE).repartition(len(todo)).mapInArrow(_walk, "path string, start long, first long, next long")
        said |= {(p, lo): (ask[p, lo], first, after) for p, lo, first, after in walked.collect()}
        ask, at = {}, {}
        for p, lo, hi, _ in ranges:
            if p not in several:
                continue
            # None: unknown from here on; -1: to be looked for
            want = at.get(p) if lo else -1
            if want is None:
                continue
            if want >= hi:
                entry[p, lo] = want
                continue
            was, first, after = said[p, lo]
            if want < 0 and was is None or want >= 0 and (was == want or first == want):
                entry[p, lo] = None if want < 0 else want
                at[p] = after
            else:
                ask[p, lo] = None if want < 0 else want
                at[p] = None
    return [(*r, entry.get(r[:2])) for r in ranges]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "offset", "type", "uri", "record_id", "date", "content_type", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for b in batches:
        for r in b.to_pylist():
            rows, held = [], 0
            for offset, record in read_range(r["path"], r["start"], r["end"], r["size"], r["entry"]):
                if record is None:
                    break
                fields, block = parse(record)
                kind, body = payload(fields, block)
                rows.append((r["path"], offset, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), fields.get("warc-date"), kind, body))
                held += len(body)
                if held > 16 << 20 or len(rows) >= 2000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def read_warc(spark: SparkSession, paths: list[str], *, split_bytes: int | None = None) -> DataFrame:
    """The records of the files, as SCHEMA; split_bytes is ``spark.sql.files.maxPartitionBytes`` if not given."""
    if split_bytes is None:
        split_bytes = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    systems: list[tuple] = []
    for path in dict.fromkeys(paths):
        where, at = _open(path)
        some = next((x for w, x in systems if w == where), None)
        if some is None:
            systems.append((where, some := []))
        some.append((path, at))
    sizes = {p: i.size for where, some in systems for (p, _), i in zip(some, where.get_file_info([at for _, at in some]))}
    ranges = [(path, lo, min(lo + split_bytes, sizes[path]), sizes[path]) for path in paths for lo in range(0, sizes[path] or 0, split_bytes)]
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    tasks = spark.createDataFrame(_entries(spark, ranges), _RANGE)
    return tasks.repartitionByRange(len(ranges), "path", "start").mapInArrow(_read, SCHEMA)


def record(uri: str, record_id: str, body: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nWARC-Record-ID: {record_id}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def write_warc(rows: DataFrame, folder: str, *, uri: str, record_id: str, body: str) -> list[str]:
    """Writes a gzipped record of each row, one file a task; the paths of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        where, at = _open(name)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        n = 0
        with where.open_output_stream(at, compression=None) as out:
            for b in batches:
                for u, i, x in zip(*(c.to_pylist() for c in b.columns)):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(z.compress(record(u or "", i or "", (x or "").encode())) + z.flush())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n"])

    made = rows.select(col(uri).cast("string"), col(record_id).cast("string"), col(body).cast("string")).mapInArrow(run, "path string, n long")
    return [r[0] for r in cut(made, "warc-paths").where("n > 0").orderBy("path").collect()]


def pages_by_warc(pages: DataFrame, *, split_bytes: int | None = None) -> DataFrame:
    """(page_id, url, n_chars, sha256) of pages (page_id, url, html) written as archives and read back."""
    spark = pages.sparkSession
    paths = write_warc(pages, shared_path(spark, "warc"), uri="url", record_id="page_id", body="html")
    r = read_warc(spark, paths, split_bytes=split_bytes)
    html = F.decode("payload", "utf-8")
    return r.select(F.when(F.col("record_id") != "", F.col("record_id").cast("long")).alias("page_id"), F.col("uri").alias("url"), F.length(html).cast("long").alias("n_chars"), F.sha2(F.col("payload"), 256).alias("sha256"))


def sql() -> str:
    return "select page_id, coalesce(url, '') as url, length(coalesce(html, '')) as n_chars, sha256(coalesce(html, '')) as sha256 from pages"
