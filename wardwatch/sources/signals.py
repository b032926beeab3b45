"""Reading and routing of signal records and their side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch.functions.guards import count_where

SAMPLES = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("channel", T.StringType()),
        T.StructField("x", T.DoubleType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("fs", T.DoubleType()),
        T.StructField("ph", T.DoubleType()),
    ]
)

# Fixed value: a decimal or special number as the line formats write it.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(text: Column) -> Column:
    """Text as a double, else NULL; unlike a bare cast it rejects suffixes such as 5f."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SAMPLES).format(fmt).load(path)


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RECORDS).format(fmt).load(path)


def clean_channel(name: Column) -> Column:
    """Trimmed, without trailing commas."""
    return F.regexp_replace(F.trim(name), ",+$", "")


def split_valid_rejects(samples: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejects with the first reason: a missing FHR or UC channel,
    or a missing pH outcome. One bad record never stops the load."""
    channels = samples.groupBy("record_id").agg(
        F.bool_or(F.col("channel") == "FHR").alias("_fhr"), F.bool_or(F.col("channel") == "UC").alias("_uc")
    )
    reason = (
        F.when(~F.coalesce("_fhr", F.lit(False)), "missing channel FHR")
        .when(~F.coalesce("_uc", F.lit(False)), "missing channel UC")
        .when(F.col("ph").isNull() | F.isnan("ph"), "missing pH")
    )
    judged = records.join(channels, "record_id", "left").withColumn("reason", reason).drop("_fhr", "_uc")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).select(
        "record_id", "reason"
    )


def outcome_from_comments(lines: DataFrame) -> DataFrame:
    """pH per record from its comment lines ``(record_id, line_no, line)``: the first
    line that is exactly ``pH <value>``; a value that is no number gives NULL."""
    value = F.regexp_extract(F.trim("line"), r"^pH\s+(\S+)\s*$", 1)
    return lines.groupBy("record_id").agg(
        F.min_by(F.struct(parse_number(value).alias("ph")), F.when(value != "", F.col("line_no"))).alias("_o")
    ).select("record_id", F.col("_o.ph").alias("ph"))


def route_by_channels(samples: DataFrame) -> DataFrame:
    """Case per record: heart rate and saturation, else fetal heart rate, else rejected."""
    has = lambda c: F.bool_or(F.col("channel") == c)
    return samples.groupBy("record_id").agg(
        F.when(has("HR") & has("SpO2"), "inpatient").when(has("FHR"), "ctg").otherwise("rejected").alias("route")
    )


def beat_annotations(beats: DataFrame) -> DataFrame:
    n = beats.groupBy("record_id").agg(count_where(F.col("symbol") != "N").alias("n_anomalous"))
    return n.withColumn("has_anomaly", F.col("n_anomalous") > 0)
