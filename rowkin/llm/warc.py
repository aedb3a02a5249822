"""WARC archives (2): write pages as gzip-membered records, index every record first, read back by byte ranges.

Each task of the writer makes one archive file in the shared folder and returns one index row per record (archive, offset,
length, url, digest). A reader takes any selection of index rows, sorts it by archive and offset, and coalesces neighbouring
records into ranged reads of bounded size, so fetching everything is sequential and fetching little seeks.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm._io import new_path, pieces, stage

#: Payloads below this many bytes are stored again rather than revisited.
LEAST_REVISIT = 100
#: Records at most this far apart are fetched by one read, and a read ends at about this size.
MOST_GAP, MOST_READ = 64 << 10, 4 << 20
#: Stored bytes that one task reads, about; index rows are too small for adaptive execution to deal records out by.
TASK_BYTES = 32 << 20
STAMP = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, record_type string, payload_digest string, payload_bytes long"


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_text(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F or c == "%" else c for c in value or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {header_text(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive for each task attempt; only the attempt whose index rows Spark keeps is ever read."""
    system, path = file_system(folder)
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz" if task else f"{uuid.uuid4().hex}.warc.gz"
    out, at = None, 0
    for whole in batches:
        for batch in pieces(whole, "html"):
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                rows.append((name, at, len(member), page_id, url, "response" if refers_to is None else "revisit", digest, len(payload)))
                at += len(member)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if out is not None:
        out.close()


def first_of_equals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload of at least LEAST_REVISIT bytes.

    Only digests travel to find the repeats: they are counted with map-side sums, and those that stand alone fall out
    before the join back, which adaptive execution splits where one payload holds most rows.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    payload = F.coalesce("html", F.lit(""))
    marked = own.withColumn("digest", F.when(F.octet_length(payload) >= LEAST_REVISIT, F.sha2(payload, 256)))
    repeats = marked.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeats = repeats.filter("n > 1").select("digest", "first")
    return marked.join(repeats, "digest", "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) as archives; returns their folder and the index (staged Parquet).

    Null html is an empty payload, null urls are empty headers, a null page_id has no header, is read back as null and is always
    a response; other columns are ignored; rows that repeat a page_id give a
    record each, all responses if the payload's smallest page_id is their own.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    index = first_of_equals(pages).mapInArrow(lambda it: _write(it, folder), INDEX)
    return folder, stage(index, "warc-index")


def coalesced(spans: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, indices) of reads that cover (offset, length) spans, which are sorted by offset."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][1] <= MOST_GAP and offset + length - out[-1][0] <= MOST_READ:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), [*out[-1][2], i])
        else:
            out.append((offset, offset + length, [i]))
    return out


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    handle, opened = None, None
    for batch in batches:
        names, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
        at = 0
        while at < len(names):
            upto = at
            while upto < len(names) and names[upto] == names[at]:
                upto += 1
            if opened != names[at]:
                handle, opened = system.open_input_file(f"{path}/{names[at]}"), names[at]
            for start, end, found in coalesced(list(zip(offsets[at:upto], lengths[at:upto], strict=True))):
                block = handle.read_at(end - start, start)
                rows = []
                for i in found:
                    begin = offsets[at + i] - start
                    headers, payload = parse(block[begin : begin + lengths[at + i]])
                    stored = headers["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if stored else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = len(payload) if stored else int(headers["X-Payload-Length"])
                    own, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append((int(own) if own else None, size, digest, headers["WARC-Type"], int(other) if other else None, payload if payloads else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                keep = 6 if payloads else 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in list(zip(zip(*rows, strict=True), kinds, strict=True))[:keep]], fields[:keep])
            at = upto


def read(folder: str, selected: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of the selected index rows: page_id, payload_bytes, payload_digest, record_type, refers_to (payload).

    A revisit has no payload of its own: its size and digest are those its header states.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    tasks = -(-(selected.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    by_place = selected.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return by_place.mapInArrow(lambda it: _read(it, folder, payloads), schema)
