"""Queries over patients, uploads, analyses and alerts.

"Newest per key" is an argmax aggregate, combined before the shuffle, so a key
with very many rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl, half_up


def patients_ordered(patients: DataFrame) -> DataFrame:
    return patients.orderBy("start_date", "id")


def uploads_of(uploads: DataFrame, patient_id: str) -> DataFrame:
    return uploads.filter(F.col("patient_id") == patient_id).orderBy("created_at", "id")


def newest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    body = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("_b")).select(*by, "_b.*")


def latest_analysis_per_upload(analyses: DataFrame) -> DataFrame:
    """Newest analysis per upload; of equal times the greatest id."""
    return newest(analyses, ["upload_id"], ["created_at", "id"])


def analyses_of_patient(analyses: DataFrame, uploads: DataFrame, patient_id: str) -> DataFrame:
    mine = uploads.filter(F.col("patient_id") == patient_id).select(F.col("id").alias("upload_id"), "patient_id")
    return analyses.join(mine, "upload_id").orderBy("created_at", "id")


def alerts_newest_first(alerts: DataFrame, patient_id: str | None = None) -> DataFrame:
    rows = alerts if patient_id is None else alerts.filter(F.col("patient_id") == patient_id)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def cascade_delete(
    removed: DataFrame, patients: DataFrame, uploads: DataFrame, analyses: DataFrame, alerts: DataFrame
) -> dict[str, DataFrame]:
    """The four tables after removing ``removed(patient_id)`` with all that hangs on it."""
    gone_uploads = uploads.join(removed, "patient_id", "left_semi").select(F.col("id").alias("upload_id"))
    return {
        "patients": patients.join(removed, patients["id"] == removed["patient_id"], "left_anti"),
        "uploads": uploads.join(removed, "patient_id", "left_anti"),
        "analyses": analyses.join(gone_uploads, "upload_id", "left_anti"),
        "alerts": alerts.join(removed, "patient_id", "left_anti"),
    }


def apply_status_updates(uploads: DataFrame, log: DataFrame) -> DataFrame:
    """Uploads with the last status of the log ``(upload_id, seq, status)``."""
    last = log.groupBy(F.col("upload_id").alias("id")).agg(F.max_by("status", "seq").alias("_s"))
    return uploads.join(last, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def filter_alerts(
    alerts: DataFrame, patients: DataFrame, patient_id: str | None = None, level: str | None = None
) -> DataFrame:
    rows = alerts
    if patient_id is not None:
        rows = rows.filter(F.col("patient_id") == patient_id)
    if level is not None:
        rows = rows.filter(F.col("level") == level)
    names = patients.select(F.col("id").alias("patient_id"), F.col("name").alias("patient_name"))
    return rows.join(names, "patient_id", "left")


def modality_panel(uploads: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per patient and modality: last upload, its status, its newest analysis."""
    last = newest(uploads.select("patient_id", "modality", "id", "created_at", "status"), ["patient_id", "modality"], ["created_at", "id"])
    current = latest_analysis_per_upload(analyses).select(
        F.col("upload_id").alias("id"), F.col("id").alias("analysis_id"), "score"
    )
    return last.join(current, "id", "left").select(
        "patient_id",
        "modality",
        F.col("id").alias("upload_id"),
        "status",
        "analysis_id",
        "score",
        F.coalesce(F.col("score") > 0, F.lit(False)).alias("has_finding"),
    )


def patient_overview(patients: DataFrame, levels: DataFrame) -> DataFrame:
    """Every patient with the current level; no events means green."""
    now = levels.select(F.col("patient_id").alias("id"), "level")
    return patients.join(now, "id", "left").withColumn("level", F.coalesce("level", F.lit("green")))


def analysis_fields(analyses: DataFrame) -> DataFrame:
    parsed = F.from_json("result", "summary string, evidence_id string, details struct<instant_s double>")
    return analyses.withColumn("_r", parsed).select(
        "id", F.col("_r.summary").alias("summary"), F.col("_r.evidence_id").alias("evidence_id"), F.col("_r.details.instant_s").alias("instant_s")
    )


def readable_time(seconds: Column) -> Column:
    """Seconds, rounded and not below zero, as "N min" or "H h MM min"."""
    minutes = F.floor(F.greatest(F.lit(0).cast("long"), half_up(seconds).cast("long")) / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    rest = F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.when(hours == 0, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(
        F.concat(hours.cast("string"), F.lit(" h "), rest, F.lit(" min"))
    )


def monitoring_days(now: Column, start: Column) -> Column:
    """Whole days since the start, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(now) - F.unix_micros(start)) / dbl(86400e6)).cast("long"))


def percent(share: Column) -> Column:
    return F.concat(half_up(share * dbl(100)).cast("long").cast("string"), F.lit("%"))
