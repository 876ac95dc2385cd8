"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: every task writes archives of its own (one gzip member per record) into the shared folder
and hands out an index row per record: file, offset, length, url, digest, page. The index is
committed as Parquet, so the records of a lost or repeated task attempt are never referred to.
Reading: the selected index rows are sorted by file and offset, neighbouring ranges are joined
into one read, and records are parsed and their digests checked.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id
holds the payload (response); the others are revisit records that refer to it.

Defined results: a null html is an empty payload; a null page_id comes after all others, and
equal payloads whose page_ids are all null are all responses, as are repeated rows of the smallest
page_id; a null url is written as an empty one; an empty table gives no archive and an empty
index. Payloads are written and read whole, however long. Only the three named columns are read, so
others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.runtime import new_folder

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
GAP, READ = 64 << 10, 8 << 20


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _of_urn(urn: str) -> int | None:
    text = urn.rpartition(":")[2].rstrip(">")
    return None if text == "null" else int(text)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One uncompressed WARC record and its payload digest."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page, payload length, digest, type, refers_to, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    to = _of_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _of_urn(fields["WARC-Record-ID"]), length, sha, kind, to, payload


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per page below ``folder`` (a URI that executors can write to); gives the committed index."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2("html", 256))
    thin = rows.filter(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    firsts = thin.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    again = thin.join(firsts, "sha").filter("page_id IS NULL OR page_id <> first").select(F.col("page_id").alias("again"), F.col("sha").alias("same"), "first").distinct()
    match = F.col("page_id").eqNullSafe(F.col("again")) & (F.col("sha") == F.col("same"))
    work = rows.join(again, match, "left").select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        task = TaskContext.get()
        out = name = None
        index: list[tuple] = []
        try:
            for batch in batches:
                for page, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        system.create_dir(base, recursive=True)
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, at = system.open_output_stream(f"{base}/{name}", compression=None), 0
                    data, sha = record(page, url, html.encode(), first)
                    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = zipped.compress(data) + zipped.flush()
                    out.write(member)
                    index.append((name, at, len(member), url, sha, page))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                if index:
                    yield _batch(index, INDEX)
                    index = []
        finally:
            if out is not None:
                out.close()

    work.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, TYPES[k]) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (all of it or a selection) names; the payload (of responses) on request."""
    schema = RECORDS + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            names, starts, sizes = (batch.column(i).to_pylist() for i in range(3))
            rows, k = [], 0
            while k < len(names):
                to = k + 1
                end = starts[k] + sizes[k]
                while to < len(names) and names[to] == names[k] and starts[to] - end <= GAP and starts[to] + sizes[to] - starts[k] <= READ:
                    end = starts[to] + sizes[to]
                    to += 1
                with system.open_input_file(f"{base}/{names[k]}") as f:
                    data = f.read_at(end - starts[k], starts[k])
                for i in range(k, to):
                    found = parse(zlib.decompress(data[starts[i] - starts[k] : starts[i] - starts[k] + sizes[i]], 31))
                    rows.append(found if with_payload else found[:5])
                k = to
            if rows:
                yield _batch(rows, schema)

    sorted_ranges = index.select("file", "offset", "length").repartition("file", F.expr(f"offset div {READ}")).sortWithinPartitions("file", "offset")
    return sorted_ranges.mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives and give back what their records hold."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)
