"""WARC: writes archives with one gzip member per record, and reads them back sequentially.

The reader inflates each member piece by piece, frames the record by its content length and holds
payloads against their digests; its memory is bounded by a record header and one piece.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, new_dir, pinned

PIECE = 1 << 16
MAX_HEADER = 1 << 20
ARCHIVE_BYTES = 64 << 20
MAX_BROADCAST_PAYLOADS = 50_000
#: Fixed value: the profile of records that stand for an equal payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def one_line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the headers of its response and no payload."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated pieces that must be used up before the next."""
    rest = stream.read(PIECE)

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            rest = rest or stream.read(PIECE)
            out = inflate.decompress(rest, PIECE)
            if out:
                yield out
            elif not rest and not inflate.eof:
                raise ValueError("the archive ends inside a record")
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if not rest:
            rest = stream.read(PIECE)

    while rest:
        yield pieces()


def read_records(stream: BinaryIO) -> Iterator[dict[str, str]]:
    """The header fields of each record, with lower-case names; raises ValueError on a broken length or digest."""
    for pieces in members(stream):
        head = b""
        for piece in pieces:
            head += piece
            if (end := head.find(b"\r\n\r\n")) >= 0:
                break
            if len(head) > MAX_HEADER:
                raise ValueError("a record without an end of its header")
        else:
            raise ValueError("a member without a record")
        first, *lines = head[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        left, sha, got, body = int(fields["content-length"]), hashlib.sha1(), 0, b""
        in_payload = False

        def block(data: bytes) -> None:
            nonlocal body, in_payload, got
            if not in_payload:
                body += data
                at = body.find(b"\r\n\r\n")
                if at < 0:
                    return
                in_payload, data, body = True, body[at + 4 :], b""
            sha.update(data)
            got += len(data)

        tail = b""
        for piece in (x for part in ([head[end + 4 :]], pieces) for x in part):
            block(piece[:left])
            tail += piece[left:]
            left -= min(left, len(piece))
        if left or tail != b"\r\n\r\n":
            raise ValueError(f"{fields.get('warc-record-id')}: the content length is wrong")
        if fields["warc-type"] == "response" and (f"sha1:{sha.hexdigest()}" != fields["warc-payload-digest"] or got != int(fields["x-payload-length"])):
            raise ValueError(f"{fields.get('warc-record-id')}: the payload does not match its digest")
        yield fields


def with_revisits(pages: DataFrame, min_bytes: int, ident: str, url: str, html: str) -> DataFrame:
    """page, url, payload, digest and refers_to (null for responses)."""
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(pages[ident].alias("page"), pages[url].alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keepers = pinned(large.select("digest", "keeper"))
    joined = rows.join(if_small(keepers, keepers.count(), MAX_BROADCAST_PAYLOADS), "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def write(pages: DataFrame, min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page into archives in the shared folder; a row (path, records, bytes) an archive.

    Of records with equal payloads of min_bytes or more, that with the largest page id is the response and the others
    revisit it (rows that repeat this id are responses too). Null html is an empty payload; a null id is
    written as null and is the largest only among nulls, which then do not revisit. A task that is run again writes files of another name,
    and only those of the finished attempt are listed.
    """
    folder = new_dir(pages.sparkSession, "warc")
    rows = with_revisits(pages, min_bytes, ident, url, html).select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches):
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done, out, written, count = [], None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path = f"{name}-{len(done):04d}.warc.gz"
                    out, written, count = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = record("null" if page is None else page, url, payload, digest, refers_to, date)
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", count, written))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", count, written))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return pinned(rows.mapInArrow(run, "path string, records bigint, bytes bigint"))


def read(archives: DataFrame) -> DataFrame:
    """A row a record: page, url, payload_bytes, payload_digest, record_type and refers_to, from archives (path)."""
    names = ("page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    page = lambda x: None if x is None or x == "<urn:page:null>" else x[len("<urn:page:") : -1]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for f in read_records(stream):
                        rows.append((page(f["warc-record-id"]), f["warc-target-uri"], int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], page(f.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(names))
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(names))

    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    n = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(max(n, 1), "path").mapInArrow(run, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
