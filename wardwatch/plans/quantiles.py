"""Exact quantiles of large groups without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl
from wardwatch.plans.ordered import CHUNK, ranged


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, nth: bool = False, parts: int | None = None) -> DataFrame:
    """Linearly interpolated ``q`` quantile per key; with ``nth`` the element
    ``int(q * n)`` of the sorted values instead.

    Values are counted (combined map-side) and dealt into sampled ranges of (keys,
    value), so values bunched in one place spread like others; the ranges that hold the
    two order statistics are found from their counts, and only their values are ranked.
    NULL values are left out; NaN is the largest value.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranged(counted, [*keys, value], parts)
    upto = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = (
        placed.groupBy(*keys, CHUNK)
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_cum", F.sum("_m").over(upto))
        .withColumn("_rank", F.floor(F.sum("_m").over(whole) * dbl(q)).cast("double") if nth else (F.sum("_m").over(whole) - 1) * dbl(q))
        .withColumn("_base", F.col("_cum") - F.col("_m"))
        .filter((F.col("_cum") > F.floor("_rank")) & (F.col("_base") <= F.ceil("_rank")))
        .select(*keys, CHUNK, "_base", "_rank")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.join(counts, [*keys, CHUNK], "inner")
        .withColumn("_to", F.col("_base") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(value)))

    frac = F.max("_rank") - F.floor(F.max("_rank"))
    below, above = at(F.floor("_rank")), at(F.ceil("_rank"))
    return ranked.groupBy(*keys).agg((below + (above - below) * frac).alias("quantile"))
