"""WARC archives: a writer, and a sequential reader with one gzip member per record.

Archives are real ``.warc.gz`` files in a folder that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CHUNK = 1 << 16


class WarcError(ValueError):
    """A record whose framing or digest does not hold."""


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(fields: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each gzip member of a byte stream, in order.

    Members are inflated as bytes arrive; only one record is held at a time.
    """
    rest, done = b"", False
    chunks = iter(chunks)
    while True:
        if not rest:
            rest = next(chunks, b"")
            if not rest:
                return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                rest = next(chunks, b"")
                if not rest:
                    raise WarcError("the archive ends within a member")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else b""
        yield _split(b"".join(parts))


def _split(member: bytes) -> tuple[dict[str, str], bytes]:
    head, found, body = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if body[length:] != b"\r\n\r\n" or len(body) != length + 4:
        raise WarcError("Content-Length does not frame the block")
    return fields, body[:length]


def _local(path: str) -> str | None:
    """The path if the shared folder is mounted, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes under a name that a retry would use too; the last step replaces atomically."""
    here = _local(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        part = f"{here}/.{name}.{os.getpid()}.{id(data)}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{here}/{name}")
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at)
    with store.open_output_stream(f"{at}/{name}") as f:
        f.write(data)


def write_warc(pages: DataFrame, folder: str, archive_mb: int = 16) -> DataFrame:
    """Writes pages(page_id, url, payload, digest, first_id) into ``folder``; returns (name, records, bytes).

    A row whose first_id is another page's becomes a revisit of it without the payload.
    Archive names come from the partition and a counter and rows stand in order of
    page_id, so a task that is run again writes the same bytes under the same names.
    """

    def write(batches):
        from pyspark import TaskContext

        part, no, buffer, records, out = TaskContext.get().partitionId(), 0, bytearray(), 0, []

        def close():
            nonlocal no, records
            name = f"part-{part:06d}-{no:05d}.warc.gz"
            _put(folder, name, bytes(buffer))
            out.append((name, records, len(buffer)))
            buffer.clear()
            no, records = no + 1, 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buffer += _page_record(*row)
                records += 1
                if len(buffer) >= archive_mb << 20:
                    close()
        if records:
            close()
        names, counts, sizes = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["name", "records", "bytes"])

    return pages.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(write, "name string, records long, bytes long")


def _page_record(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": "".join(c for c in (url or "") if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if first_id is None or first_id == page_id:
        return encode_record({"WARC-Type": "response"} | fields, http + payload)
    revisit = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first_id}>"}
    return encode_record({"WARC-Type": "revisit"} | fields | revisit, http)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload). The
    payload of a response is checked against its length and its digest; a revisit has none.
    """

    def read(batches):
        for batch in batches:
            for blob in batch.column(0):
                data = memoryview(blob.as_buffer())
                rows, held = [], 0
                for record in read_records(bytes(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)):
                    rows.append(_page_row(*record))
                    held += len(rows[-1][-1] or b"")
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _page_row(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise WarcError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    page = fields["WARC-Record-ID"][10:-1]
    refers = fields["WARC-Refers-To"][10:-1] if kind == "revisit" else None
    return int(page) if page else None, fields["WARC-Target-URI"], length, digest, kind, int(refers) if refers else None, payload if kind == "response" else None


def archive_pages(pages: DataFrame, folder: str, least: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes every row of pages(page_id, url, html) as a record and returns the manifest.

    Of equal payloads (by SHA-256) of at least ``least`` bytes the page with the largest id
    is the response and the others revisit it. Null html is an empty payload; rows with a null
    id are responses (they can't be told from a copy); a row repeated with its id is a
    response each time. Other columns are ignored.
    """
    @F.pandas_udf("string")
    def digests(payload):
        return payload.map(digest32)

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": digests("payload"), "_full": F.sha2("payload", 256)})
    enough = F.octet_length("payload") >= least
    firsts = rows.where(enough).groupBy(F.col("_full").alias("_f")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1").select("_f", "first_id")
    firsts = materialize(firsts, "warc-firsts")
    joined = rows.join(firsts, (F.col("_full") == F.col("_f")) & enough, "left").drop("_f", "_full")
    n = partitions or max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = joined.repartition(n, "page_id", "digest").sortWithinPartitions("page_id", "digest", "url")
    return materialize(write_warc(dealt, folder), "warc-manifest")
