"""Evidence as a log of commits: several writers, snapshot reads, compaction.

A write adds a folder of Parquet files with its rows alone, and then one small commit file
under a name of its own, put in place by a rename. So writers of one run never touch each
other's files, and a reader, which starts from the commit files it lists, sees a write
whole or not at all. Commits are ordered by (number, name); a number is one more than the
largest its writer saw. Of the rows of one id the last commit's counts. Compaction writes
the current rows of the commits it read into one folder, with the commit each row came
from, and names the commits it stands for; commits made meanwhile stay beside it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["feature", "run_id", "evidence_id"]
ORDER = ["commit_no", "commit_name"]


def _store(path: str):
    return fs.FileSystem.from_uri(path)


def commits(path: str, upto: int | None = None) -> list[dict]:
    """The commits that count for a reader, in order; ``upto`` reads an earlier state."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    made = []
    for f in found:
        if f.base_name.endswith(".json") and not f.base_name.startswith("_"):
            with store.open_input_file(f.path) as file:
                made.append(json.loads(file.read()))
    made = [c for c in made if upto is None or c["no"] <= upto]
    gone = {name for c in made for name in c["replaces"]}
    return sorted((c for c in made if c["name"] not in gone), key=lambda c: (c["no"], c["name"]))


def _commit(path: str, commit: dict) -> None:
    store, root = _store(path)
    store.create_dir(f"{root}/_commits", recursive=True)
    half = f"{root}/_commits/_{uuid.uuid4().hex}"
    with store.open_output_stream(half) as out:
        out.write(json.dumps(commit).encode())
    store.move(half, f"{root}/_commits/{commit['name']}.json")


def _last(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per id, the last in ``order``."""
    body = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("_b")).select(*KEY, "_b.*")


def append_evidence(rows: DataFrame, path: str, order: Sequence[str] = (), name: str | None = None) -> str:
    """Add ``rows``; of several with one id the last in ``order`` counts. A write under a
    ``name`` that is there already, as when a batch runs again, changes nothing."""
    seen = commits(path)
    if name is not None:
        store, root = _store(path)
        if store.get_file_info(f"{root}/_commits/{name}.json").type != fs.FileType.NotFound:
            return name
    name = name or uuid.uuid4().hex
    number = max([c["no"] for c in seen], default=0) + 1
    if order:
        rows = _last(rows, order)
    folder = f"data/{name}-{uuid.uuid4().hex}"
    rows = rows.withColumns({"commit_no": F.lit(number).cast("long"), "commit_name": F.lit(name)})
    rows.write.parquet(f"{path}/{folder}")
    _commit(path, {"name": name, "no": number, "folder": folder, "schema": rows.schema.json(), "replaces": []})
    return name


def _rows(spark: SparkSession, path: str, made: list[dict]) -> DataFrame | None:
    out = None
    for schema in dict.fromkeys(c["schema"] for c in made):
        folders = [f"{path}/{c['folder']}" for c in made if c["schema"] == schema]
        some = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders)
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def read_evidence(spark: SparkSession, path: str, upto: int | None = None, order: Sequence[str] = ()) -> DataFrame | None:
    """One row per id, that of the last commit, with the commit it came from; columns of
    ``order``, if any, decide before the commit. None where nothing is written."""
    rows = _rows(spark, path, commits(path, upto))
    return None if rows is None else _last(rows, [*order, *ORDER])


def compact_evidence(spark: SparkSession, path: str, least: int = 2, order: Sequence[str] = ()) -> bool:
    """Put the commits there are into one, if there are ``least`` or more; ``order`` as the
    readers have it."""
    made = commits(path)
    if len(made) < least:
        return False
    rows = _last(_rows(spark, path, made), [*order, *ORDER])
    name = f"compact-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{name}")
    # What a replaced compaction stood for stays replaced: its name is listed with the others.
    _commit(path, {"name": name, "no": made[-1]["no"], "folder": f"data/{name}", "schema": rows.schema.json(), "replaces": [c["name"] for c in made]})
    return True


def vacuum_evidence(path: str) -> int:
    """Remove the data of replaced commits, once no reader of an older state is left. Their
    commit files stay, so that a repeated write is still known."""
    store, root = _store(path)
    used = {c["folder"] for c in commits(path)}
    known = set()
    for f in store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)):
        if f.base_name.endswith(".json") and not f.base_name.startswith("_"):
            with store.open_input_file(f.path) as file:
                known.add(json.loads(file.read())["folder"])
    gone = [folder for folder in known - used if store.get_file_info(f"{root}/{folder}").type != fs.FileType.NotFound]
    for folder in gone:
        store.delete_dir(f"{root}/{folder}")
    return len(gone)
