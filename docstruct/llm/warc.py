"""WARC archives as tables of chunks.

A record's bytes (header, then block, then two line ends) are cut into rows (record, chunk) of
bounded size; the concatenation of an archive's chunks in that order is a WARC 1.1 file. Chunks
carry the SHA-1 of the payload up to their end, so a reader updates one digest per chunk, finds
damage at the chunk where it is, and never holds a whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
BATCH_BYTES = 1 << 22
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"

CHUNKS = "record bigint, chunk int, last boolean, running_sha1 string, data binary"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMES = ["record", "chunk", "last", "running_sha1", "data"]
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def to_chunks(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT,
    chunk_bytes: int = CHUNK_BYTES, date: str = DATE,
) -> DataFrame:
    """Pages as chunk rows: record, chunk, last, running_sha1, data.

    Of pages with one payload of at least *min_revisit* bytes the one with the largest identifier
    is a response and the others are revisits of it; all smaller ones are responses. A null page
    has the empty payload, a null url leaves the target out. Rows that repeat the largest
    identifier are responses too; a null identifier sorts below all others, and a group of null
    identifiers only is all responses. An empty table gives no rows.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("size", F.octet_length("payload"))
    key = F.when(F.col("size") >= min_revisit, F.sha1("payload"))
    # Digests with one page only need no join; they leave before it.
    groups = rows.select(key.alias("key"), "page_id").where("key IS NOT NULL").groupBy("key").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    rows = rows.withColumn("key", key).join(groups, "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", "payload", refers.alias("refers_to"))
    return rows.mapInArrow(_chunked(chunk_bytes, date), CHUNKS)


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk rows back to one row per record, each length and digest checked: page_id,
    payload_bytes, payload_digest, record_type, refers_to. Damaged bytes fail the job.

    Records of one chunk are read where they lie; only longer ones are brought together, in chunk
    order, and streamed.
    """
    single = chunks.where("chunk = 0 AND last").mapInArrow(_records, RECORDS)
    longer = chunks.where("NOT (chunk = 0 AND last)").repartition("record").sortWithinPartitions("record", "chunk")
    return single.union(longer.mapInArrow(_records, RECORDS))


def header(record_type: str, page_id: int | None, url: str | None, size: int, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """WARC and HTTP header of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [
        "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1).decode(),
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _chunked(chunk_bytes: int, date: str):
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(batch.num_rows):
            record, page_id, url, refers_to = (batch.column(c)[i].as_py() for c in ("record", "page_id", "url", "refers_to"))
            payload = memoryview(batch.column("payload")[i].as_buffer())
            size = len(payload)
            head = header("response" if refers_to is None else "revisit", page_id, url, size, hashlib.sha1(payload).digest(), refers_to, date)
            if refers_to is not None:
                yield record, 0, True, None, head + b"\r\n\r\n"
                continue
            running = hashlib.sha1()
            for number, start in enumerate(range(0, max(size, 1), chunk_bytes)):
                piece = payload[start : start + chunk_bytes]
                running.update(piece)
                last = start + chunk_bytes >= size
                yield record, number, last, running.hexdigest(), (head if not start else b"") + bytes(piece) + (b"\r\n\r\n" if last else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                size += len(row[4])
                if size >= BATCH_BYTES:
                    yield _chunk_batch(held)
                    held, size = [], 0
        if held:
            yield _chunk_batch(held)

    return run


def _chunk_batch(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], _NAMES)


class _Reader:
    """One record, fed chunk by chunk."""

    def __init__(self, first: bytes):
        cut = first.index(b"\r\n\r\n") + 4
        lines = first[:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record begins here")
        self.fields = dict(line.split(": ", 1) for line in lines[1:] if line)
        self.length = int(self.fields["Content-Length"])
        body = first.index(b"\r\n\r\n", cut) + 4
        self.declared = int(re.search(rb"Content-Length: (\d+)", first[cut:body])[1])
        self.seen = body - cut
        self.sha1, self.payload = hashlib.sha1(), 0
        self.feed(memoryview(first)[body:])

    def feed(self, data) -> None:
        inside = data[: self.length - self.seen]
        self.sha1.update(inside)
        self.payload += len(inside)
        self.seen += len(inside)
        self.tail = bytes(data[len(inside) :])

    def record(self) -> tuple:
        digest = base64.b32decode(self.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        kind = self.fields["WARC-Type"]
        if self.seen != self.length or self.tail != b"\r\n\r\n":
            raise ValueError(f"{self.fields['WARC-Record-ID']}: the block has another length")
        if kind == "response" and (self.payload != self.declared or self.sha1.hexdigest() != digest):
            raise ValueError(f"{self.fields['WARC-Record-ID']}: the payload has another length or digest")
        return _page(self.fields["WARC-Record-ID"]), self.declared, digest, kind, _page(self.fields.get("WARC-Refers-To", "<none>"))


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(URN)
    return None if name == "none" else int(name)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    reader, expected = None, (None, 0)
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            record, chunk, last, running = (batch.column(c)[i].as_py() for c in _NAMES[:4])
            data = batch.column("data")[i].as_buffer()
            if chunk == 0:
                reader = _Reader(bytes(data))
            elif (record, chunk) != expected:
                raise ValueError(f"record {record}: chunk {chunk} where {expected} was due")
            else:
                reader.feed(memoryview(data))
            if running is not None and reader.sha1.hexdigest() != running:
                raise ValueError(f"record {record}: damage in chunk {chunk}")
            expected = (record, chunk + 1)
            if last:
                found.append(reader.record())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_files(chunks: DataFrame, folder: str, archives: int) -> DataFrame:
    """Write the chunks to *archives* files ``<folder>/<number>.warc`` (a URI that pyarrow opens and
    all executors share) and return (path, records). A file appears under its name only when it is
    whole, so a task that runs again replaces it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        number, out, records = None, None, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            files.move(f"{base}/{number}.part", f"{base}/{number}.warc")
            done.append((f"{base}/{number}.warc", records))

        for batch in batches:
            for archive, last, data in zip(batch.column("archive").to_pylist(), batch.column("last").to_pylist(), batch.column("data")):
                if archive != number:
                    if out is not None:
                        close()
                    number, records = archive, 0
                    out = files.open_output_stream(f"{base}/{number}.part")
                out.write(data.as_buffer())
                records += last
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    dealt = chunks.withColumn("archive", F.pmod("record", F.lit(archives)).cast("int"))
    dealt = dealt.repartition(archives, "archive").sortWithinPartitions("archive", "record", "chunk")
    return dealt.mapInArrow(run, "path string, records bigint")
