"""WARC archives: writing pages as gzipped records, and a splittable reader.

Writing: each task writes one archive of one gzip member per record into the shared folder, under the name of its attempt.
Nothing is renamed: the list of files that is returned names those of the attempts that counted, so that neither a lost
executor's half-written file nor a second attempt's is ever read. Of records with equal payloads the one
with the smallest page_id is a response, the others are revisits that refer to it.

Reading: archives are cut into byte ranges. The task of a range scans it for gzip's magic number, takes a place for a record
only if a member that decodes to a WARC header begins there, and owns the records that begin inside its range, wherever they
end. So ranges need no index and no agreement with record bounds, and none reads a whole file.

Files are reached through pyarrow's file systems, by the folder's URL (file, hdfs, s3, gcs), never by a local path.

Defined results: null html is the empty payload, which takes part like any other; very long payloads are one record each;
repeated rows (the same page_id twice) are two records, of which neither refers to the other unless the id is not the
smallest; null page_id or url is left out of the record and read back as null; a payload's digest and length always are
those of the full payload; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, settled, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are always written in full.
MIN_BYTES = 0
#: Bytes of a reader's range.
RANGE = 16 << 20
#: Groups of equal payloads (a digest and an id each) whose first page is broadcast at most; beyond that the join shuffles, and
#: the pages of one payload are dealt into so many parts.
BROADCAST_GROUPS = 500_000
PARTS = 32
DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 18


def _filesystem(url: str):
    """The file system of a URL, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A record, not yet compressed: a response, or if ``first`` is the page that has the same payload, a revisit of it."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join("%%%02X" % b for b in c.encode("utf-8", "replace")) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_digest(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """One gzip member (without a time, so that equal records give equal bytes)."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_record(data: bytes) -> dict:
    """The fields of a whole record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda name: int(fields[name][10:-1]) if name in fields else None  # noqa: E731  <urn:page:N>
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (base32_digest(payload) != digest or len(payload) != length):
        raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not have the digest or the length it was written with")
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": page("WARC-Refers-To"), "payload": payload}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into ``folder`` (a URL). Returns (path, bytes) of the files, settled."""
    arrow_batches(pages.sparkSession, rows=500)
    html = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = html.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    groups = settled(groups)
    if groups.count() <= BROADCAST_GROUPS:
        todo = html.join(F.broadcast(groups), "digest", "left")
    else:
        parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        todo = html.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int")).join(parts, ["digest", "part"], "left")
    todo = todo.select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        task = TaskContext.get()
        own = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        size, out = 0, None
        for batch in batches:
            for page_id, url, text, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{own}", compression=None)  # members are compressed already
                data = member(record(page_id, url, text.encode("utf-8"), first))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([size], pa.int64())], names=["path", "bytes"])

    _make_dir(folder)
    return settled(todo.mapInArrow(run, "path string, bytes long"))


def _make_dir(folder: str) -> None:
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)


class _Window:
    """Bytes of a file from some place on, read block by block and let go again."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.over = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_BLOCK)
        self.data += got
        self.over = not got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The records that begin in ``file[start:end]``."""
    w = _Window(file, start)
    while w.at < end:
        place = w.data.find(MAGIC)
        if place < 0:
            w.drop(max(0, len(w.data) - len(MAGIC) + 1))
            if not w.more():
                return
            continue
        w.drop(place)
        if w.at >= end:
            return
        # A candidate: decode, and look at the first bytes before going on.
        d, out, used, good = zlib.decompressobj(31), [], 0, False
        try:
            while not d.eof:
                if used == len(w.data) and not w.more():
                    break
                part = d.decompress(w.data[used:])
                used = len(w.data) - len(d.unused_data)
                out.append(part)
                if not good and sum(map(len, out)) >= 7:
                    good = b"".join(out).startswith(b"WARC/1.")
                    if not good:
                        break
        except zlib.error:
            good = False
        if good and d.eof:
            w.drop(used)
            yield b"".join(out)
        elif good:
            raise ValueError(f"a record at byte {w.at} breaks off")
        else:
            w.drop(1)


def read_archives(spark: SparkSession, files: DataFrame, folder: str, payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of the archives ``files(path, bytes)`` in ``folder``, read by byte ranges."""
    arrow_batches(spark, rows=500)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, min(ranges.count(), 1_000_000))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    fields = [tuple(x.split()) for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in fields], names=[k for k, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{path}") as file:
                    for data in records_in(file, start, start + range_bytes):
                        rows.append(parse_record(data))
                        held += len(data) if payload else 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.repartition(n, "path", "start").mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
