"""Large JSON files of the form ``{"name": [{...}, ...], ...}``, read by many tasks.

A file is cut into byte ranges. What a range means depends on what stands before it: it
may start inside a string, or any number of brackets deep. One job summarises each range
under both guesses (outside and inside a string): change of depth, state at the end, and
the last array opened at each depth. Summaries, one small row a range, are put together
in file order, which gives every range its true start. A data source then plans one
partition per range and reads the objects that start in it, to their end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEAD = 1024  # bytes before a range that may hold the name of an array opened in it
SOURCE = "json_array_objects"
ROW = "source string, name string, at long, object string"
NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


def _opened(path: str):
    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
    return store.open_input_file(root)


def _bytes(file, start: int, end: int) -> bytes:
    file.seek(start)
    return file.read(max(0, end - start))


@dataclass
class Brackets:
    """Brackets outside strings: places, whether opening, and the depth before each."""

    at: np.ndarray
    opens: np.ndarray
    before: np.ndarray
    net: int
    in_string: bool


def brackets(data: bytes, lead: int, depth: int, in_string: bool) -> Brackets:
    """Of ``data[lead:]``; the bytes before are there for escapes that run into it."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    escaped = [q for q in quotes[(quotes > 0) & (b[np.maximum(quotes - 1, 0)] == 92)].tolist() if (q - len(data[:q].rstrip(b"\\"))) % 2]
    quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    quotes = quotes[quotes >= lead]
    at = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
    at = at[at >= lead]
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    opens = (b[at] == 123) | (b[at] == 91)
    after = depth + np.cumsum(np.where(opens, 1, -1))
    return Brackets(at, opens, np.concatenate([[depth], after[:-1]]) if len(at) else after, int(after[-1]) - depth if len(at) else 0, bool((len(quotes) + in_string) % 2))


def _name_of(data: bytes, at: int) -> str | None:
    """The name of the array that opens at ``at``; none for other brackets."""
    if data[at : at + 1] != b"[":
        return None
    found = NAME.search(data, max(0, at - LEAD), at)
    return json.loads(b'"' + found.group(1) + b'"') if found else None


def summary(data: bytes, lead: int) -> list[dict]:
    """What the range does, for a start outside and inside a string."""
    out = []
    for guess in (False, True):
        found = brackets(data, lead, 0, guess)
        last = {}
        for depth in np.unique(found.before[found.opens & (found.before <= 1)]).tolist():
            at = int(found.at[found.opens & (found.before == depth)][-1])
            last[str(depth)] = _name_of(data, at)
        out.append({"net": found.net, "in": found.in_string, "last": last})
    return out


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    depth: int
    in_string: bool
    name: str | None


def planned(summaries: list[tuple[str, int, int, str]]) -> list[FileRange]:
    """The true start of every range, from the summaries of all ranges."""
    out, state = [], (0, False, None)
    for path, start, end, made in sorted(summaries):
        if start == 0:
            state = (0, False, None)
        depth, inside, name = state
        out.append(FileRange(path, start, end, depth, inside, name))
        s = json.loads(made)[inside]
        state = (depth + s["net"], s["in"], s["last"].get(str(1 - depth), name))
    return out


def objects_of(part: FileRange, wanted: str) -> Iterator[tuple[str, int, str]]:
    """(name, place, text) of the objects of array ``wanted`` that start in the range."""
    with _opened(part.path) as file:
        lead = min(part.start, LEAD)
        data = _bytes(file, part.start - lead, part.end)
        found = brackets(data, lead, part.depth, part.in_string)
        tops = found.at[found.opens & (found.before == 1)]
        names = [part.name, *(_name_of(data, a) for a in tops.tolist())]
        starts = found.at[found.opens & (found.before == 2)]
        starts = [a for a, i in zip(starts.tolist(), np.searchsorted(tops, starts).tolist(), strict=True) if names[i] == wanted and data[a : a + 1] == b"{"]
        ends = found.at[~found.opens & (found.before == 3)]
        after = np.searchsorted(ends, starts)
        for a, i in zip(starts, after.tolist(), strict=True):
            place = part.start - lead + a
            if i < len(ends):
                yield wanted, place, data[a : int(ends[i]) + 1].decode("utf-8", "replace")
                continue
            body, step = data[a:], 1 << 16  # the last object may go on behind the range
            while True:
                inner = brackets(body, 0, 2, False)
                closed = inner.at[~inner.opens & (inner.before == 3)]
                if len(closed):
                    yield wanted, place, body[: int(closed[0]) + 1].decode("utf-8", "replace")
                    break
                more = _bytes(file, place + len(body), place + len(body) + step)
                if not more:
                    break  # the file ends within an object
                body, step = body + more, 2 * step


class JsonArrayObjects(DataSource):
    """Rows (source, name, at, object) of the array ``name`` over the ranges of ``plan``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return JsonArrayReader(self.options["name"], self.options["plan"])


class JsonArrayReader(DataSourceReader):
    def __init__(self, name: str, plan: str):
        self.array, self.plan = name, plan

    def partitions(self) -> list[FileRange]:
        return [FileRange(*r) for r in json.loads(self.plan)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []

        def batch():
            name, at, text = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"source": [partition.path] * len(held), "name": list(name), "at": pa.array(at, pa.int64()), "object": list(text)})

        for found in objects_of(partition, self.array):
            held.append(found)
            if len(held) == 4096:
                yield batch()
                held = []
        if held:
            yield batch()


def plan_ranges(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> str:
    """The plan of the files under ``path``, as text for the data source. Files are listed
    by Spark; ranges are summarised by tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))

    def rows(batches):
        for batch in batches:
            made = []
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(p) as file:
                    lead = min(a, LEAD)
                    made.append(json.dumps(summary(_bytes(file, a - lead, b), lead)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["path", "start", "end", "made"])

    made = ranges.repartition("path", "start").mapInArrow(rows, "path string, start long, end long, made string")
    parts = planned([tuple(r) for r in made.collect()])  # one small row a range
    return json.dumps([[p.path, p.start, p.end, p.depth, p.in_string, p.name] for p in parts])


def array_objects(spark: SparkSession, plan: str, name: str, fields: str) -> DataFrame:
    """(source, at, fields...) of the objects of one array, ``fields`` a DDL list; values of
    another type are null, as with Spark's own reader."""
    spark.dataSource.register(JsonArrayObjects)
    rows = spark.read.format(SOURCE).option("name", name).option("plan", plan).load()
    return rows.select("source", "at", F.from_json("object", fields).alias("o")).select("source", "at", "o.*")


def write_array_files(arrays: dict[str, DataFrame], folder: str, key: str, files: int) -> list[str]:
    """Files ``{"name": [...], ...}`` of the rows of several tables, each streamed by the
    task that writes it; rows of one ``key`` go to one file. Tables without that column
    are repeated in every file. Returns the paths."""
    one = None
    for order, (name, df) in enumerate(arrays.items()):
        text = F.to_json(F.struct(*[c for c in df.columns]))
        place = F.pmod(F.xxhash64(key), F.lit(files)).cast("int") if key in df.columns else F.explode(F.sequence(F.lit(0), F.lit(files - 1)))
        rows = df.select(place.alias("file"), F.lit(order).alias("kind"), text.alias("object"))
        one = rows if one is None else one.unionByName(rows)
    names = list(arrays)

    def write(batches):
        now, kind, half, store, first = None, -1, None, None, True
        out = None

        def upto(last: int):
            nonlocal kind, first
            while kind < last:
                out.write((b"]" if kind >= 0 else b"{") + (b",\n" if kind >= 0 else b"") + (json.dumps(names[kind + 1]) + ": [").encode())
                kind, first = kind + 1, True

        def close():
            upto(len(names) - 1)
            out.write(b"]}")
            out.close()
            store.move(half, f"{root}/part-{now:05d}.json")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{now:05d}.json"]})

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for file, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != now:
                    if out is not None:
                        yield close()
                    now, kind = file, -1
                    half = f"{root}/_part-{file:05d}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(half)
                upto(k)
                out.write((b"" if first else b",\n") + text.encode("utf-8"))
                first = False
        if out is not None:
            yield close()

    dealt = one.repartition(files, "file").sortWithinPartitions("file", "kind")
    return sorted(r[0] for r in dealt.mapInArrow(write, "path string").collect())  # one row a file
