"""Binary and multi-class quality metrics. Undefined metrics are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.guards import col, count_where, dbl, ratio


def metrics_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counts.select(
        *by, "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), (F.col("tp") + F.col("fn")).alias("support")
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.try_divide(dbl(2) * p * r, p + r))


def binary_metrics(
    df: DataFrame, truth: str | Column, predicted: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    t, p = col(truth), col(predicted)
    counts = df.groupBy(*by).agg(
        count_where(t & p).alias("tp"), count_where(~t & p).alias("fp"), count_where(t & ~p).alias("fn")
    )
    return metrics_of_counts(counts, by)


def zero_filled(metrics: DataFrame) -> DataFrame:
    """The bedside variant: undefined metrics read as zero."""
    return metrics.fillna(0.0, subset=["precision", "recall", "f1"])


def one_vs_rest(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """One row per class of ``classes``, present in the data or not.

    Rows shrink to (truth, predicted) counts first; each class then reads those.
    """
    pairs = df.groupBy(F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    listed = spark.createDataFrame([(c,) for c in classes], "class string")
    hits = pairs.select(
        "_n", "_t", "_p", F.explode(F.array_distinct(F.array(F.col("_t"), F.col("_p")))).alias("_c")
    )
    joined = listed.join(hits, F.col("class") == F.col("_c"), "left")
    t, p = F.col("_t") == F.col("class"), F.col("_p") == F.col("class")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    counts = joined.groupBy("class").agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"))
    return metrics_of_counts(counts, ["class"])


def prevalence(df: DataFrame, truth: str | Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col(truth).cast("double")).alias("prevalence"))
