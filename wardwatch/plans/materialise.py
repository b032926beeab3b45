"""Tables that several branches of one plan read, and files that tasks read."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from wardwatch.session import ensure_checkpoint_dir


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back, so that its
    input is scanned and shuffled once however many branches follow, and a lost
    executor costs no recomputation. ``clean`` then removes the shuffle files behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    if not clean:
        return df.checkpoint()
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, which takes up the setting
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(folder: str) -> None:
    """Remove a folder of the shared folder, if it is there."""
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        store.delete_dir(root)


def parquet_files(folder: str) -> list[str]:
    """Names of the Parquet files that Spark wrote to a folder, in order."""
    store, root = fs.FileSystem.from_uri(folder)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet"))


def open_file(folder: str, name: str):
    """Random access to a file of the shared folder."""
    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")
