"""WARC archives with revisit resolution by payload digest.

``write_archives`` writes every page as a response record; ``headers`` lists the records;
``decide_revisits`` shuffles only the headers, by payload digest; ``rewrite_archives``
copies each archive with fresh headers, dropping the payload of revisits; and
``resolve`` reads the result and joins revisit records to their originals.
Records are gzip members of their own, as the format asks, so any can be read alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.shared import open_file, shared_folder, stored, task_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HEADERS = (
    "file string, offset long, size long, record_id string, page_id long, url string, warc_date string, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _line(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    raw = b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0)


def read_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, compressed size, fields, block) of every record of one archive."""
    held, at = b"", 0
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    break
            parts.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        if not inflate.eof:
            if used:
                raise ValueError("archive ends inside a record")
            return
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield at, used, fields, rest[: int(fields["Content-Length"])]
        at += used


def write_archives(pages: DataFrame, folder: str, date: str, max_bytes: int = 1 << 30) -> DataFrame:
    """One response record per row; the payload is the html in UTF-8, null the empty
    payload. A task writes files of about ``max_bytes`` and returns their names; the rows
    stay where they are."""

    run = uuid.uuid4().hex  # record ids of two crawls never clash; a retried task repeats its own

    def write(batches):
        part = TaskContext.get().partitionId()
        rows, n = _rows(batches), 0
        row = next(rows, None)
        while row is not None:
            name = f"pages-{part:06d}-{n:04d}.warc.gz"
            with task_file(folder, name) as out:
                size = place = 0
                while row is not None and size < max_bytes:
                    page_id, url, html = row
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    fields = {
                        "WARC-Type": "response",
                        "WARC-Record-ID": f"<{uuid.uuid5(NAMESPACE, f'{run}/{name}/{place}').urn}>",
                        "WARC-Date": date,
                        "WARC-Target-URI": _line(url),
                        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                        "Page-ID": "" if page_id is None else str(page_id),
                        "Content-Type": "application/http; msgtype=response",
                    }
                    size += out.write(record(fields, HTTP % len(payload) + payload))
                    place += 1
                    row = next(rows, None)
            n += 1
            yield pa.RecordBatch.from_pydict({"file": [name]})

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(keyed.mapInArrow(write, "file string"), "archives")


def _rows(batches):
    for batch in batches:
        for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield page_id.as_py(), url.as_py(), html.as_py()


def headers(files: DataFrame, folder: str, verify: bool = True) -> DataFrame:
    """One row per record of the archives: place, fields, and the payload's length. With
    ``verify`` a response whose payload does not have the digest of its header fails."""

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for at, size, f, block in read_records(open_file(folder, name)):
                    said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = None
                    if f["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length = len(payload)
                        if verify and digest(payload) != said:
                            raise ValueError(f"{name} at {at}: payload and digest differ")
                    page, refers = f["Page-ID"], f.get("Refers-To-Page-ID", "")
                    held.append((name, at, size, f["WARC-Record-ID"], int(page) if page else None, f["WARC-Target-URI"], f["WARC-Date"], length, said, f["WARC-Type"], int(refers) if refers else None))
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return _one_each(files).mapInArrow(read, HEADERS)


def _one_each(files: DataFrame) -> DataFrame:
    """The file names, about one to a task."""
    return files.select("file").repartition(max(1, files.count()), "file")


KINDS = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in HEADERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def decide_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with record_type and refers_* set: of those with equal payload digests
    of at least ``min_bytes``, the one with the smallest page_id (then file and offset)
    stays response, the others revisit it. Records without page_id stay responses.

    The original per digest is a map-side combined minimum; it goes back to the headers
    by an equi join whose hot digests adaptive execution splits.
    """
    able = records.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    first = able.groupBy("payload_digest").agg(
        F.min(F.struct("page_id", "file", "offset", "record_id", "url", "warc_date")).alias("o"), F.count(F.lit(1)).alias("copies")
    )
    first = first.filter("copies > 1").select("payload_digest", "o")
    joined = records.drop("record_type", "refers_to").join(first, "payload_digest", "left")
    other = (
        F.col("o").isNotNull()
        & F.col("page_id").isNotNull()
        & (F.col("payload_bytes") >= min_bytes)
        & ((F.col("file") != F.col("o.file")) | (F.col("offset") != F.col("o.offset")))
    )
    pick = lambda name: F.when(other, F.col(f"o.{name}"))
    return joined.select(
        *records.drop("record_type", "refers_to").columns,
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        pick("page_id").alias("refers_to"),
        pick("record_id").alias("refers_record"),
        pick("url").alias("refers_url"),
        pick("warc_date").alias("refers_date"),
    )


def rewrite_archives(decided: DataFrame, source: str, target: str, files: int) -> DataFrame:
    """Each archive of ``source`` written to ``target`` with fresh headers, revisits
    without payload. Decisions travel to the task of their archive, payloads do not."""

    def write(batches):
        rows = _decisions(batches)
        row = next(rows, None)
        while row is not None:
            name = row["file"]
            with task_file(target, name) as out:
                for at, _, f, block in read_records(open_file(source, name)):
                    if row is None or (row["file"], row["offset"]) != (name, at):
                        raise ValueError(f"{name} at {at}: no decision")
                    fields = {k: v for k, v in f.items() if k != "Content-Length"}
                    if row["record_type"] == "revisit":
                        fields |= {
                            "WARC-Type": "revisit",
                            "WARC-Profile": PROFILE,
                            "WARC-Refers-To": row["refers_record"],
                            "WARC-Refers-To-Target-URI": row["refers_url"],
                            "WARC-Refers-To-Date": row["refers_date"],
                            "Refers-To-Page-ID": str(row["refers_to"]),
                        }
                        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                    out.write(record(fields, block))
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"file": [name]})

    columns = ["file", "offset", "record_type", "refers_to", "refers_record", "refers_url", "refers_date"]
    dealt = decided.select(columns).repartition(files, "file").sortWithinPartitions("file", "offset")
    return stored(dealt.mapInArrow(write, "file string"), "archives")


def _decisions(batches):
    for batch in batches:
        yield from batch.to_pylist()


def resolve(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of deduplicated archives, a revisit with the payload length of
    the response it refers to. Fails if that response is missing or has another digest."""
    records = stored(headers(files, folder), "records")
    response = records.filter((F.col("record_type") == "response") & F.col("page_id").isNotNull()).select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_full")
    )
    # repeated rows of one page_id and payload hold one response that others refer to
    response = response.groupBy("refers_to", "payload_digest").agg(F.max("_full").alias("_full"))
    joined = records.join(response, ["refers_to", "payload_digest"], "left")
    full = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(
        F.coalesce("_full", F.raise_error(F.concat(F.lit("no response for revisit of page "), F.col("refers_to"))).cast("long"))
    )
    return joined.select("page_id", full.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "file")


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write, decide, rewrite, read back. A null html is the empty payload; a null
    page_id makes a plain response; repeated rows revisit the first of them; other
    columns are ignored; an empty table gives no record."""
    spark = pages.sparkSession
    raw, clean = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    written = write_archives(pages, raw, date)
    decided = decide_revisits(stored(headers(written, raw, verify=False), "headers"), min_bytes)
    return resolve(rewrite_archives(decided, raw, clean, max(1, written.count())), clean)
