"""Streaming jobs run to the end of the files there are, then read back.

The sink is a parquet folder under the checkpoint folder, never the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracles.views import stmt
from registered import Family
from registered import fusion as FQ
from registered import prescriptions as RQ
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import fusion as FU
from wardwatch.operators import prescriptions as RX
from wardwatch.operators import tracking as TR
from wardwatch.session import ensure_checkpoint_dir
from wardwatch.streaming import streams as ST

fam = Family()
ORIGIN_MS = V.EPOCH_US // 1000
HOUR, YEARS = 3600.0, 10 * 366 * 86400.0
# Rows whose hour has ended when the watermark stands an hour before the newest event.
PASSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def event_stream(spark: SparkSession, sf: str, delay: str = "1 hour", end: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    return ST.stream_samples(spark, sf, schema, "ts", delay, end=end, pathGlobFilter="events.parquet")


def whole_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events with the watermark moved past the last of them by a closing row, so that
    none waits in state when the input ends."""
    events = V.table(spark, sf, "events")
    folder = f"{ensure_checkpoint_dir(spark)}/stream-end-{uuid.uuid4().hex}"
    events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).filter("ts IS NOT NULL").write.parquet(folder)
    closing = spark.read.schema("ts timestamp_ntz").parquet(folder).agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    rows = event_stream(spark, sf, end=folder)
    # a condition on the event time itself stays behind the watermark
    return rows if closing is None else rows.filter(F.coalesce(F.unix_micros("ts") < closing, F.lit(True)))


def drained(stream: DataFrame) -> DataFrame:
    """Run over all input once, write parquet, and return what was written."""
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/log")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@fam.add("str_samples", "SELECT event_id, user_id, event_type, value FROM events")
def _samples(spark, sf):
    return drained(event_stream(spark, sf)).select("event_id", "user_id", "event_type", "value")


@fam.add(
    "str_window_features",
    """SELECT user_id::VARCHAR AS record_id, strftime(w, '%Y-%m-%d %H:%M') AS start, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max, baseline FROM (
      SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(12 * o::INTEGER) + to_hours(0) AS w, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS baseline
      FROM events, (VALUES (0), (1)) AS s(o) GROUP BY 1, 2) WHERE w + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _windows(spark, sf):
    ev = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("record_id"), "ts", F.col("value").alias("x"))
    out = drained(ST.stream_window_features(ev, "24 hours", "12 hours"))
    return out.select(
        "record_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "baseline"
    )


@fam.add(
    "str_zscore",
    """SELECT event_id, round(score, 6) AS score, score > 1.5 AS flag FROM (SELECT event_id, CASE WHEN count(*) OVER b = 5 THEN CASE WHEN min(value) OVER b = max(value) OVER b
      THEN CASE WHEN value = min(value) OVER b THEN 0.0 ELSE 'inf'::DOUBLE END ELSE abs(value - avg(value) OVER b) / stddev_pop(value) OVER b END END AS score
    FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
)
def _zscore(spark, sf):
    ev = whole_event_stream(spark, sf)
    means = ev.select(F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("start"), F.col("value").alias("mean"), "event_id")
    out = drained(ST.on_time(ST.stream_zscore(means, 5, 1.5, ["event_id"], HOUR, YEARS)))
    return out.select("event_id", F.round("score", 6).alias("score"), "flag")


def fusion_stream(spark, sf) -> DataFrame:
    ev = event_stream(spark, sf)
    t, v = F.col("event_type"), F.col("value")
    modality = F.when(t == "click", "video").when(t == "view", "audio").when(t == "purchase", "vitals").when(t == "error", "prescription").otherwise("other")
    level = F.when(v >= 100, "CRITICAL").when(v >= 60, "HIGH").when(v >= 30, "MEDIUM").when(v >= 10, "LOW").otherwise("INFO")
    return ev.select(
        F.col("user_id").cast("string").alias("patient_id"),
        modality.alias("modality"),
        ((F.unix_micros("ts") - F.lit(V.EPOCH_US)) / dbl(1e6)).alias("t"),
        F.col("event_id").alias("seq"),
        FU.severity_weight(level).alias("severity"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("evidence_id"),
        "ts",
    )


def risk_stream(spark, sf) -> DataFrame:
    ST.use_rocksdb(spark)
    return ST.stream_risk(fusion_stream(spark, sf), ORIGIN_MS, step=FQ.STEP, half_life=FQ.HALF)


DUE = "TIMESTAMP '2024-01-01' + to_seconds(t) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@fam.add("str_risk", stmt(f"SELECT * FROM (SELECT patient_id, t, round(score, 6) AS score, level, lag(level, 1, 'green') OVER (PARTITION BY patient_id ORDER BY k) AS previous_level FROM levels) WHERE {DUE}", "levels"))
def _risk(spark, sf):
    return drained(risk_stream(spark, sf)).select("patient_id", "t", F.round("score", 6).alias("score"), "level", "previous_level")


@fam.add(
    "str_alert_dedup",
    """SELECT DISTINCT user_id::VARCHAR AS patient_id, event_type || '-' || (value >= 60)::VARCHAR AS alert_key FROM events""",
)
def _dedup(spark, sf):
    ev = event_stream(spark, sf, "60 days")
    alerts = ev.select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.concat("event_type", F.lit("-"), (F.col("value") >= 60).cast("string")).alias("alert_key"),
        "ts",
    )
    return drained(ST.stream_alert_dedup(alerts, delay=None)).select("patient_id", "alert_key")


@fam.add(
    "str_rx_rules",
    f"""SELECT patient_id, seq, rule, kind FROM (SELECT user_id::VARCHAR AS patient_id, event_id AS seq, event_type AS drug, value AS dose,
      ts, lag(event_type) OVER w AS pdrug, lag(value) OVER w AS pdose FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e
    LEFT JOIN (VALUES ('click', 5.0, 40.0, 1), ('view', 1.0, 30.0, 1), ('purchase', 10.0, 45.0, 2), ('error', 8.0, 50.0, 3)) AS c(name, lo, hi, crit) ON c.name = e.drug
    LEFT JOIN (VALUES ('click', 1), ('view', 1), ('purchase', 2), ('error', 3)) AS p(pname, pcrit) ON p.pname = e.pdrug,
    LATERAL (SELECT 'dose_range' AS rule, {RQ.DOSE_KIND} AS kind UNION ALL SELECT 'substitution', {RQ.SUB_KIND} UNION ALL SELECT 'abrupt_change', {RQ.abrupt(True)}) WHERE {PASSED}""",
)
def _rx(spark, sf):
    rows = [
        ("click", 5.0, 40.0, "mg", "", "", False, "", 1),
        ("view", 1.0, 30.0, "mg", "", "", False, "", 1),
        ("purchase", 10.0, 45.0, "mg", "", "", False, "", 2),
        ("error", 8.0, 50.0, "mg", "", "", False, "", 3),
    ]
    catalog = RQ.literal_table(spark, rows, RX.CATALOG_SCHEMA)
    ev = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("event_type").alias("drug"),
        F.col("value").alias("dose"),
        F.lit("mg").alias("unit"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    out = ST.stream_rx_rules(ev, catalog, "ts", ["seq"], HOUR, YEARS)
    return drained(RX.rule_rows(out, "patient_id", "seq")).select("patient_id", "seq", "rule", "kind")


FRAME_S = 14400


@fam.add(
    "str_tracks",
    f"""SELECT user_id::VARCHAR AS seq_id, count(*) AS boxes, 0::BIGINT AS twice, 0::BIGINT AS broken, 0::BIGINT AS missed FROM events
    WHERE (epoch_us(ts) // {FRAME_S * 1_000_000} + 1) * {FRAME_S} <= epoch_us((SELECT max(ts) FROM events) - INTERVAL 1 HOUR) / 1e6 GROUP BY 1""",
)
def _tracks(spark, sf):
    ev = event_stream(spark, sf)
    x, y = (F.col("event_id") % 3) * dbl(80), (F.col("user_id") % 4).cast("double")
    boxes = ev.select(
        F.col("user_id").cast("string").alias("seq_id"),
        F.floor(F.unix_timestamp("ts") / FRAME_S).cast("long").alias("frame_idx"),
        F.col("event_id").cast("string").alias("box_idx"),
        (x + F.col("value") % 9).alias("x1"),
        y.alias("y1"),
        (x + F.col("value") % 9 + 50).alias("x2"),
        (y + 80).alias("y2"),
        "ts",
    )
    return TR.track_faults(drained(ST.on_time(ST.stream_tracks(boxes, "ts", float(FRAME_S), YEARS))))


@fam.add(
    "str_evidence_sink",
    """SELECT 'vitals' AS feature, 'run-' || (user_id % 3) AS run_id, 'e' || (event_id // 2) AS evidence_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3""",
)
def _sink(spark, sf):
    ev = event_stream(spark, sf)
    rows = ev.select(
        F.lit("vitals").alias("feature"),
        F.concat(F.lit("run-"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("evidence_id"),
        "value",
        "event_id",
    )
    root = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    ST.stream_evidence_sink(rows, f"{root}/out", f"{root}/log", ["event_id"]).trigger(availableNow=True).start().awaitTermination()
    out = ST.read_evidence_sink(spark, f"{root}/out", ["event_id"])
    return out.select("feature", "run_id", "evidence_id", "value")
