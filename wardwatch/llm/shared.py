"""Intermediate tables and task-written files in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut,
    several readers share one computation, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(folder)


def remove_folder(folder: str) -> None:
    """Remove a folder of task-written files, if it is there."""
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        store.delete_dir(root)


def apart(df: DataFrame, keys: DataFrame, on: str, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """(maybe, others): the rows of ``df`` whose ``on`` may be among those of ``keys``, and
    the rows whose ``on`` is not. An exact join with ``keys`` then moves the first alone,
    few if keys are few. ``keys`` become a filter of ``2**bits`` bits, broadcast as at most
    ``2**bits / 64`` words: a full one only sends more rows to that join."""
    cell = F.pmod(F.xxhash64(on), F.lit(1 << bits))
    word, bit = F.shiftright(cell, 6), (cell % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = keys.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    marked = df.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return marked.filter(hit).select(df.columns), marked.filter(~hit).select(df.columns)


def text_tag() -> Column:
    """128 bits of hash of the column ``text``."""
    text = F.col("text").cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


@contextmanager
def task_file(folder: str, name: str) -> Iterator:
    """A binary file written by one task: under an attempt's own name first, then renamed,
    so that a retried or speculative task leaves one whole file."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    half, whole = f"{root}/_{name}.{attempt}", f"{root}/{name}"
    with store.open_output_stream(half) as out:
        yield out
    if store.get_file_info(whole).type != fs.FileType.NotFound:
        store.delete_file(whole)
    store.move(half, whole)


def open_file(folder: str, name: str):
    """Random access to a file of the shared folder."""
    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")
