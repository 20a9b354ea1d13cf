"""WARC archives: one gzip member for each record, revisits for repeated payloads, and a sequential reader.

Writing: each page is a record whose block is an HTTP response with the payload. Of pages with equal payloads of
min_bytes bytes or more, that with the greatest page_id is the response; the others become revisit records, which
carry only the HTTP header and point to the response (payload digests decide equality: SHA-1 and length). Which is
which is worked out on narrow rows (id, digest, length), pre-aggregated by digest, so that a payload with a third of
all pages is no heavier than any other; pages then meet these decisions by page_id and digest, which deals them
evenly, and each task of that join writes one archive to the shared folder and reports it in a manifest that is
itself a table there. Payloads are shuffled once.

Reading: an archive is read front to back, decompressed piece by piece; a record ends where its gzip member ends, its
block where Content-Length says; block and payload digests are verified, and a mismatch or a cut file is an error.

Defined cases: null html is the empty payload; null url gives a record without target; repeated rows each have a
record, and all rows with the greatest page_id of a payload are responses; null page_id sorts below all others;
an empty table gives no archives and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.shared import cut, open_file, scratch_path, small_batches, write_file

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _sha(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. The HTTP header of a revisit gives the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: {_sha(payload)}", f"WARC-Block-Digest: {_sha(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in pairs}


def members(stream: BinaryIO, piece: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one after another; only one member is held at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(piece)
        if not rest:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = stream.read(piece)
                if not rest:
                    raise ValueError("archive ends inside a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record, framed by Content-Length and verified."""
    for data in members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        warc = _headers(head)
        length = int(warc["content-length"])
        block = rest[:length]
        if not warc[""].startswith("WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"record {warc.get('warc-record-id')} is not framed by its Content-Length")
        if _sha(block) != warc["warc-block-digest"]:
            raise ValueError(f"record {warc['warc-record-id']} does not have its block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = _headers(http)
        if warc["warc-type"] == "response" and (_sha(payload) != warc["warc-payload-digest"] or len(payload) != int(fields["content-length"])):
            raise ValueError(f"record {warc['warc-record-id']} does not have its payload digest or length")
        yield warc, fields, payload


def decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, _sha, revisit, refers_to), one row for each distinct page_id and payload that is repeated elsewhere."""
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_len"))
    long_ones = narrow.where(F.col("_len") >= min_bytes).groupBy("_sha", "_len", "page_id").agg(F.lit(1).alias("_one"))
    first = long_ones.groupBy("_sha", "_len").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twins = long_ones.join(first, ["_sha", "_len"])
    return twins.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), F.col("_sha").alias("_sha_of"), "refers_to")


def write_archives(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """Write pages (page_id, url, html, ...) as archives in the shared folder; returns the manifest (uri, bytes,
    records), a table that is already written."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "warc")
    repeated = decisions(pages, min_bytes)
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    x = pages.select("page_id", "url", "html", sha.alias("_sha"))
    x = x.join(repeated, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_sha_of")), "left")
    x = x.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to", F.col("_sha_of").isNotNull().alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = 0

        def chunks() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, html, refers_to, revisit = (batch.column(i)[k].as_py() for i in range(5))
                    count += 1
                    yield record(page_id, url, html or b"", refers_to, revisit)

        context = TaskContext.get()
        uri, size = write_file(folder, f"{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", chunks())
        if count:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [size], "records": [count]})

    return cut(x.mapInArrow(write, "uri string, bytes long, records long"), "manifest")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """manifest (uri, ...) -> RECORD, one row for each record of the archives; payload is null for revisits."""

    def number(urn: str) -> int | None:
        digits = urn[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_file(uri) as stream:
                    for warc, http, payload in read_records(stream):
                        revisit = warc["warc-type"] == "revisit"
                        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append(
                            (number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], number(warc["warc-refers-to"]) if revisit else None, int(http["content-length"]), digest, payload if payloads and not revisit else None)
                        )
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = max(1, manifest.count())
    return manifest.select("uri").repartition(spread, "uri").mapInArrow(read, RECORD)
