"""Gaps and islands on dense positions, parallel inside a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.plans import ordered


def mark_runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cond: Column,
    length: int = ordered.DEFAULT_CHUNK,
    name: str = "run_start",
) -> DataFrame:
    """Rows where ``cond`` holds, with the position at which their unbroken run
    began. A missing position or a row where ``cond`` is not true breaks the run."""
    hits = df.filter(cond)
    halo = ordered.with_halo(hits, pos, length, before=1)
    prior = F.lag(pos).over(ordered.chunk_window(keys, pos))
    starts = ordered.core_rows(
        halo.withColumn("_start", F.when(prior.isNull() | (prior < F.col(pos) - 1), F.col(pos)))
    )
    return ordered.carried(starts, keys, pos, length, last={name: F.col("_start")}).drop("_start")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cond: Column,
    length: int = ordered.DEFAULT_CHUNK,
    aggs: Sequence[Column] = (),
) -> DataFrame:
    """One row per unbroken run: half-open [run_start, run_end), run_len and ``aggs``."""
    marked = mark_runs(df, keys, pos, cond, length)
    return (
        marked.groupBy(*keys, "run_start")
        .agg((F.max(pos) + 1).alias("run_end"), F.count(F.lit(1)).alias("run_len"), *aggs)
    )
