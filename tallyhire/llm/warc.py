"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing makes one archive per task in the shared folder, each record a gzip member of its own, and yields the index:
file, offset, length, URL, digest, type and page of every record.  The index is settled before anything reads it, so it
names exactly the files of the task attempts that counted; files of lost attempts are never looked at.

Reading starts from selected index rows.  They are dealt out by file and ``CHUNK`` of it, to as many tasks as their bytes
call for (index rows are small, so the size of the shuffle would not tell), and sorted by offset inside a task; neighbours with a gap of at most ``GAP`` bytes become one ranged read of at most about ``READ`` bytes.

Which record is the response is settled on digests alone: the largest page_id per payload digest, aggregated before the
shuffle.  The digests of a hot payload meet their one answer in a join that adaptive execution may split.

Cases: a null html is an empty payload; equal payloads that share the largest page_id are all responses; a null page_id
revisits a page that has one and is a response if no page with the payload has one; a null url leaves out the target
header; control characters of a URL are percent-encoded in the record; page_id, url and html only are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhire.llm.common import as_bytes, slices
from tallyhire.operators.settle import run_folder, settled

GAP = 64 * 1024
READ = 4 * 1024 * 1024
CHUNK = 8 * 1024 * 1024
#: Bytes of archive for one reading task once every core has some.
TASK = 128 * 1024 * 1024
GZIP_LEVEL = 1
LEAST_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"

INDEX_DDL = ("page_id long, url string, payload_digest string, record_type string, file string, offset long, length long")
INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def _page_of(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisits: bool) -> tuple[bytes, str]:
    """One WARC record and its payload digest.  A revisit keeps the HTTP head, which states the payload's length."""
    name = digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <{_page(page_id)}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{name}",
    ]
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_page(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", name


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, its HTTP head's stated length, and the payload it carries."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields | {"stated": stated, "payload": payload}


def responses(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and ``first``: the page that a page's equal payload is stored under, null where it is its own."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_sha"))
    largest = own.where(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(
        F.max("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1 and first is not null").drop("_n")
    return own.join(largest, "_sha", "left").select(
        "page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write one archive per task under ``folder``; the index of all records, settled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        file, offset, sink = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in slices(batches):
                rows = []
                for page_id, url, payload, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                        as_bytes(batch, "html"), batch.column(3).to_pylist()):
                    raw, name = record(page_id, url, payload, first, first is not None)
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(raw) + packer.flush()
                    sink = sink or store.open_output_stream(f"{top}/{file}", compression=None)
                    sink.write(data)
                    rows.append((page_id, url, name, "response" if first is None else "revisit", file, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)
        finally:
            if sink:
                sink.close()

    return settled(responses(pages, least_bytes).mapInArrow(run, INDEX_DDL))


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) places into (start, stop, the places' numbers)."""
    start = stop = 0
    members: list[int] = []
    for i, (offset, length) in enumerate(places):
        if members and (offset - stop > GAP or offset + length - start > READ):
            yield start, stop, members
            members = []
        if not members:
            start = offset
        stop = max(stop, offset + length) if members else offset + length
        members.append(i)
    if members:
        yield start, stop, members


RECORDS_DDL = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
               "payload binary")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows given; each response's payload is checked against its digest and length.

    Without ``payloads`` the checked payload stays in the task and its column is null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):  # runs of one file
                file, end = rows[at]["file"], at
                while end < len(rows) and rows[end]["file"] == file:
                    end += 1
                with store.open_input_file(f"{top}/{file}") as source:
                    for start, stop, members in ranges([(r["offset"], r["length"]) for r in rows[at:end]]):
                        data = source.read_at(stop - start, start)
                        yield _unpacked([data[rows[at + i]["offset"] - start:][:rows[at + i]["length"]] for i in members], payloads)
                at = end

    size = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = 1 + min(size // CHUNK, max(2 * cores, size // TASK))
    chunk = F.floor(F.col("offset") / CHUNK)
    return (
        index.select("file", "offset", "length").repartition(tasks, "file", chunk).sortWithinPartitions("file", "offset")
        .mapInArrow(run, RECORDS_DDL)
    )


def _unpacked(members: list[bytes], payloads: bool) -> pa.RecordBatch:
    rows = []
    for member in members:
        found = parse(zlib.decompress(member, 31))
        kind, name = found["warc-type"], found["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (digest(found["payload"]) != name or len(found["payload"]) != found["stated"]):
            raise ValueError(f"damaged record {found['warc-record-id']}")
        rows.append((
            _page_of(found["warc-record-id"]), found.get("warc-target-uri"), kind, name, found["stated"],
            _page_of(found["warc-refers-to"]) if kind == "revisit" else None, found["payload"] if payloads and kind == "response" else None,
        ))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive all pages and read every record back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = run_folder(spark, "warc")
    return read(write(pages, folder), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
