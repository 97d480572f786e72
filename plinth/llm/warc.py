"""Deduplicated WARC archives: revisit resolution.

Headers alone, a row number, id, URL and digest for each page, are shuffled by payload digest and joined to the digests that
occur more than once, which name the record that stays a response. What comes out, a row for each revisit, goes back to the
task that scans the page (``rows``): payloads are never shuffled. That task writes gzip archives of its own, a member for each
record; a revisit's fresh headers refer to its response and its payload isn't written again. The rows of the tasks that
succeeded are the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import prepare, tidy
from plinth.llm.files import new_file, old_file
from plinth.llm.rows import decided, met, pinned, row_number_id
from plinth.session import scratch_path, staged

#: Payloads from this many bytes on are deduplicated.
LEAST_BYTES = 1000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 4
#: Tasks that read archives; each reads its share.
MOST_TASKS = 10_000
#: Pages carry no date of their own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:plinth:page"


def payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, n): digest and n are the SHA-1 in hex and the bytes of a row's payload."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    return pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("n"))


def revisits(headers: DataFrame) -> DataFrame:
    """(row, check, original, original_url) of the headers (row, id, url, digest) that revisit another record: where a digest
    occurs again, all but the one with the greatest id. Rows that repeat the greatest id all stay responses; where no row of a
    digest has an id, all do."""
    again = headers.groupBy("digest").agg(F.max("id").alias("original"), F.max_by("url", "id").alias("original_url"), F.count("*").alias("copies"))
    again = staged(again.filter("copies > 1 and original is not null").drop("copies"), "revisited")
    check = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("check")
    return headers.join(again, "digest").filter(~F.col("id").eqNullSafe(F.col("original"))).select("row", check, "original", "original_url")


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(page: int | None, digest: str) -> str:
    return f"<{URN}:{'none' if page is None else page}:{digest}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, n: int, original: int | None, original_url: str | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit's block holds the HTTP headers only, which still give the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": _urn(page, digest),
        "WARC-Target-URI": None if url is None else _uri(url),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if is_revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(original, digest), "WARC-Refers-To-Target-URI": None if original_url is None else _uri(original_url)}
    else:
        block += payload
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive; one member is held at a time."""
    rest, inflate, got = b"", zlib.decompressobj(31), []
    while True:
        if not rest:
            rest = source.read(chunk)
            if not rest:
                break
        got.append(inflate.decompress(rest))
        rest = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            whole, got, inflate = b"".join(got), [], zlib.decompressobj(31)
            head, _, block = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            yield fields, block[: int(fields["Content-Length"])]
    if any(got):
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` into gzip archives; the manifest: (path, records, revisits, bytes).

    A null payload is empty. Payloads under ``least_bytes`` are never revisits; of ties and null ids ``revisits`` tells. No
    rows give no archives."""
    spark = prepare(pages)
    folder = folder or scratch_path(spark, "warc")
    own = payloads(pinned(pages), id_col, url_col, payload_col)
    headers = own.select(row_number_id().alias("row"), "id", "url", "digest", "n").filter(F.col("n") >= least_bytes).drop("n")
    decisions = decided(revisits(staged(headers, "warc-headers")))

    def check(batch: pa.RecordBatch, places: np.ndarray) -> np.ndarray:
        return np.array([int(x[:15], 16) for x in batch.column(3).take(pa.array(places)).to_pylist()], np.int64)

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, places, known in met(batches, decisions, check):
            found = dict(zip(places.tolist(), zip(known.column("original").to_pylist(), known.column("original_url").to_pylist()))) if known else {}
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                yield *row, i in found, *found.get(i, (None, None))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = resolved(batches)
        row = next(rows, None)
        done = []
        while row is not None:
            with ExitStack() as stack:
                out, path = stack.enter_context(new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz"))
                n = revisits = size = 0
                while row is not None and size < archive_bytes:
                    page, url, payload, digest, length, is_revisit, original, original_url = row
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = deflate.compress(record(page, url, payload, digest, length, original, original_url, is_revisit)) + deflate.flush()
                    out.write(data)
                    n, revisits, size, row = n + 1, revisits + is_revisit, size + len(data), next(rows, None)
            done.append((path, n, revisits, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "revisits", "bytes"])

    return staged(own.mapInArrow(tidy(kernel), "path string, records bigint, revisits bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the manifest's archives: page_id, url, record_type, payload_bytes, payload_digest (SHA-1 in
    hex), refers_to (page id of a revisit's response) and, if asked, payload (null for revisits). A response's length and
    digest are taken from its payload, and must agree with its headers."""
    paths = manifest.select("path").repartition(min(max(manifest.count(), 1), MOST_TASKS))

    def parse(fields: dict[str, str], block: bytes) -> tuple:
        page = fields["WARC-Record-ID"].strip("<>").split(":")[3]
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(re.search(rb"(?m)^Content-Length: (\d+)\r?$", http)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't agree with its headers")
        refers = fields["WARC-Refers-To"].strip("<>").split(":")[3] if revisit else None
        return (None if page == "none" else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], n, digest, None if refers is None else int(refers), None if revisit else payload)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    take = 7 if with_payload else 6

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with old_file(path) as source:
                    rows, size = [], 0
                    for fields, block in records(source):
                        rows.append(parse(fields, block)[:take])
                        size += len(block) if with_payload else 100
                        if size > 1 << 22:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names[:take])

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload
    return paths.mapInArrow(tidy(kernel), schema)
