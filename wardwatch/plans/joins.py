"""Interval joins as bucketed equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Points matched to the half-open intervals [start, end) of the same key.

    Each interval is listed under every bucket of ``width`` it touches, so the
    inequality is only tested inside (keys, bucket). Empty intervals never match.
    """
    spread = (
        intervals.filter(F.col(end) > F.col(start))
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col(start) / F.lit(width)).cast("long"),
                    F.floor(F.col(end) / F.lit(width)).cast("long"),
                )
            ),
        )
        .withColumnsRenamed({k: f"_k_{k}" for k in keys})
    )
    p = points.withColumn("_pb", F.floor(F.col(point) / F.lit(width)).cast("long"))
    cond = (F.col("_pb") == F.col("_bucket")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return p.join(spread, cond, how).drop("_pb", "_bucket", *[f"_k_{k}" for k in keys])
