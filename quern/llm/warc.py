"""WARC archives behind an index: offset, length, URL and digest of every record, then coalesced range reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, materialize, open_store, scratch

#: Bytes after which a task begins another file; bytes of a file that one read task takes; gap and size of a range read.
FILE_BYTES, READ_SHARE, GAP, RANGE = 256 << 20, 32 << 20, 64 << 10, 4 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id long, url string, digest string, record_type string, path string, offset long, length long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (p.split() for p in ddl.split(", "))])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {clean}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "None" else int(number)


def write_archives(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages and returns the index, itself written to shared storage.

    Of rows with equal payloads of at least min_bytes, those of the smallest page_id are responses and the others
    revisit it. A file's name is of its attempt: the index names only files of tasks that ended well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sink, path, at = _schema(_INDEX), None, "", 0
        for batch in batches:
            rows: list[list] = [[] for _ in out]
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                revisit = first is not None and page_id != first
                data = record(page_id, url, payload, digest, first, revisit, date)
                if sink is None:
                    path, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    store, name = open_store(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(name, compression=None)
                sink.write(data)
                for column, value in zip(rows, (page_id, url, digest, "revisit" if revisit else "response", path, at, len(data)), strict=True):
                    column.append(value)
                at += len(data)
                if at > FILE_BYTES:
                    sink.close()
                    sink = None
            yield batch_of(out, rows)
        if sink is not None:
            sink.close()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    large = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_bytes
    firsts = rows.filter(large).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("sha", "first")
    joined = rows.join(firsts, "sha", "left").select("page_id", "url", "html", "first")
    return materialize(arrow_map(joined, run, _INDEX), "index")


def read_records(selected: DataFrame) -> DataFrame:
    """The records that rows of an index name, read from the archives.

    Rows are sorted by file and offset, and ranges that lie close are read at once, up to RANGE bytes. Payload digests of
    responses are verified.
    """

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        group: list[tuple[str, int, int]] = []
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] - group[-1][1] - group[-1][2] > GAP or row[1] + row[2] - group[0][1] > RANGE):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, file = _schema(_READ), None, None
        for batch in batches:
            found: list[list] = [[] for _ in out]
            for group in ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                path, begin, end = group[0][0], group[0][1], max(o + n for _, o, n in group)
                if path != name:
                    store, inner = open_store(path)
                    name, file = path, store.open_input_file(inner)
                block = file.read_at(end - begin, begin)
                for _, offset, length in group:
                    raw = zlib.decompress(block[offset - begin : offset - begin + length], 31)
                    fields, http, payload = parse_record(raw)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: a record at {offset} fails its digest")
                    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    values = (_page(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers, fields.get("WARC-Target-URI"))
                    for column, value in zip(found, values, strict=True):
                        column.append(value)
            yield batch_of(out, found)

    share = F.floor(F.col("offset") / READ_SHARE)
    dealt = selected.select("path", "offset", "length").repartition("path", share).sortWithinPartitions("path", "offset")
    return arrow_map(dealt, run, _READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives, reads every record back through the index, and returns what the records say.

    Null html is an empty payload; equal payloads of any length are revisits but for the smallest page_id's. Repeated
    rows of that page_id are responses all. A null page_id revisits the smallest of its payload, if there is one, and is
    a response otherwise. Empty tables give no rows; other columns are not read. Payloads are shuffled once, by digest.
    """
    index = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_records(index).drop("url")


def warc_sql() -> str:
    """The same rows in DuckDB SQL. Five hexadecimal digits of a SHA-1 are four base32 digits."""
    return """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first, count(*) OVER (PARTITION BY t) AS n FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
           CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM h
    """
