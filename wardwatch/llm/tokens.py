"""Token-ID files: Arrow IPC files of equal-length sequences with masks.

One file holds the ids of a range of documents in ascending order, laid end to end and
cut into rows of ``seq_len`` ids: a record batch has the columns ``input_ids``
(fixed_size_list of unsigned integers) and ``mask`` (fixed_size_list of bool, false only
in the padding of a file's last row). Batches have ``batch_rows`` rows, all but the last,
so row r lies in batch r // batch_rows at r % batch_rows and is a view, not a copy. A
second file beside it lists (doc_id, start, n_tokens) of its documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardwatch.llm.shared import open_file, shared_folder, stored, task_file
from wardwatch.llm.vocabulary import encoder, id_type

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
LEAST = -(1 << 63)
MANIFEST = "part int, name string, n_docs long, n_tokens long, n_rows long"


class RowWriter:
    """Cuts a stream of ids into fixed-size-list batches."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int, batch_rows: int):
        self.len, self.rows = seq_len, batch_rows
        self.room = seq_len * batch_rows
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.dtype = dtype
        self.file = ipc.new_file(sink, self.schema)
        self.held, self.size, self.n_tokens, self.n_rows = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        while self.size + len(ids) >= self.room:
            cut = self.room - self.size
            self.held.append(ids[:cut])
            self.size += cut
            self._flush()
            ids = ids[cut:]
        if len(ids):
            self.held.append(ids)
            self.size += len(ids)

    def _flush(self) -> None:
        n = -(-self.size // self.len)
        flat = np.zeros(n * self.len, self.dtype)
        mask = np.zeros(n * self.len, bool)
        flat[: self.size] = np.concatenate(self.held)
        mask[: self.size] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.len) for x in (flat, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n_rows += n
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        self.file.close()


class TokenFile:
    """Random access to the rows of one file; ``rows(b)`` gives views of batch ``b``."""

    def __init__(self, source, batch_rows: int):
        self.file = ipc.open_file(source)
        self.batch_rows = batch_rows
        self.seq_len = self.file.schema.field("input_ids").type.list_size

    def rows(self, batch: int) -> tuple[np.ndarray, pa.FixedSizeListArray]:
        got = self.file.get_batch(batch)
        ids = got.column("input_ids")
        flat = ids.values.slice(ids.offset * self.seq_len, len(ids) * self.seq_len)
        return flat.to_numpy(zero_copy_only=True).reshape(-1, self.seq_len), got.column("mask")

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.rows(r // self.batch_rows)
        return ids[r % self.batch_rows], np.array(mask[r % self.batch_rows].as_py())

    def stream(self) -> Iterator[np.ndarray]:
        """All ids that a mask covers, batch by batch."""
        for b in range(self.file.num_record_batches):
            ids, mask = self.rows(b)
            valid = mask.values.true_count
            yield ids.reshape(-1)[:valid]


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, seq_len: int = 1024, batch_rows: int = 256
) -> DataFrame:
    """Encode ``text``, append ``end_id`` and write the ids in ascending (doc_id, text
    hash) order; nulls come first. Returns the manifest, one row per file.

    Documents are dealt by range of doc_id, so that each task writes one contiguous file
    and no task sees more than its range. A null or empty text has the end id alone; rows
    with one doc_id are kept apart, equal ones in any order; other columns are ignored; an
    empty table writes nothing.
    """

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dtype = id_type(vocabulary)

    def write(batches):
        end = np.array([end_id], dtype)
        for part, rows_of_part in _parts(batches):
            name = f"tokens-{part:06d}"
            with task_file(folder, f"{name}.arrow") as out, task_file(folder, f"{name}.docs.arrow") as listing:
                rows = RowWriter(out, dtype, seq_len, batch_rows)
                index = ipc.new_file(listing, DOCS)
                n_docs = 0
                for batch in rows_of_part:
                    starts, counts = [], []
                    for body in batch.column("ids"):
                        starts.append(rows.n_tokens)
                        rows.add(np.concatenate([np.frombuffer(body.as_buffer(), dtype), end]))
                        counts.append(rows.n_tokens - starts[-1])
                    n_docs += batch.num_rows
                    index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
                rows.close()
                index.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_tokens": [rows.n_tokens], "n_rows": [rows.n_rows]}
            )

    placed = encoded(docs, vocabulary, range_starts(docs, parts))
    dealt = placed.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h")
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def _keys(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def range_starts(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """First (doc_id, text hash) of about ``parts`` even ranges, one row a range; only ids
    and hashes are shuffled to find them. Null ids come before all others."""

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    keys = _keys(docs).select("doc_id", "h").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = keys.mapInArrow(first, "doc_id long, h long").collect()
    return sorted((LEAST if d is None else d, h) for d, h in found)


def encoded(docs: DataFrame, vocabulary: str, starts: list[tuple[int, int]], cache: int = 400_000) -> DataFrame:
    """(part, doc_id, h, ids): the ids of each text as bytes, and the range it lies in.
    Encoding comes before the shuffle, which then moves ids instead of texts. A task
    remembers the ids of up to twice ``cache`` words."""

    def rows(batches):
        enc = encoder(vocabulary, cache)
        for batch in batches:
            ids = [enc.packed(t.as_py()) for t in batch.column(2)]
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            part = [max(0, bisect_right(starts, (LEAST if d is None else d, h)) - 1) for d, h in keys]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["part", "doc_id", "h", "ids"])

    return _keys(docs).mapInArrow(rows, "part int, doc_id long, h long, ids binary")


def _parts(batches) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(part, its batches) of rows sorted by part; a part's batches are read before the next."""

    def pieces():
        for batch in batches:
            part = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield int(part[a]), batch.slice(a, b - a)

    for part, group in groupby(pieces(), key=lambda x: x[0]):
        yield part, (batch for _, batch in group)


def read_token_files(manifest: DataFrame, folder: str, batch_rows: int = 256) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone. ``start``
    counts the ids of all documents before it over all files, in file order. Each task
    streams its files batch by batch."""

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                tokens = TokenFile(open_file(folder, f"{name}.arrow"), batch_rows).stream()
                index = ipc.open_file(open_file(folder, f"{name}.docs.arrow"))
                held = np.zeros(0, np.uint32)
                for b in range(index.num_record_batches):
                    listed = index.get_batch(b)
                    sums = []
                    for n in listed.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if not len(held):
                                held = next(tokens).astype("<u4")
                            crc = zlib.crc32(held[:n], crc)
                            took = min(n, len(held))
                            held, n = held[took:], n - took
                        sums.append(crc)
                    starts = np.asarray(listed.column("start")) + before
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": listed.column("doc_id"), "start": pa.array(starts, pa.int64()), "n_tokens": listed.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())}
                    )

    files = max(1, manifest.count())
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("part", "name", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    return placed.repartition(files).select("name", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, vocabulary: str, end_id: int = 0, seq_len: int = 1024) -> DataFrame:
    """Write the files to a fresh shared folder, then read the documents back from them."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id, seq_len), folder)
