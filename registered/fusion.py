"""Risk fusion on the bridge events: 6 h grid, 24 h half-life."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.operators import fusion as FU

fam = Family()
STEP, HALF = 21600.0, 86400.0


def events(spark: SparkSession, sf: str) -> DataFrame:
    return V.fusion_events(spark, sf).withColumn("severity", FU.severity_weight(F.col("severity_level")))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return FU.risk_points(events(spark, sf), step=STEP, half_life=HALF)


def levelled(spark: SparkSession, sf: str) -> DataFrame:
    return FU.hysteresis_level(points(spark, sf))


cte(
    "fe",
    """SELECT *, CASE upper(severity_level) WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.7::DOUBLE WHEN 'MEDIUM' THEN 0.45::DOUBLE
    WHEN 'LOW' THEN 0.2::DOUBLE WHEN 'INFO' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS severity FROM fusion_events""",
    "fusion_events",
)
cte(
    "grid",
    """SELECT patient_id, k, k * 21600.0::DOUBLE AS t FROM (
    SELECT patient_id, unnest(range(0, floor((max(t) + 21600) / 21600)::BIGINT + 1)) AS k FROM fe GROUP BY patient_id)""",
    "fe",
)
cte(
    "weights",
    """SELECT * FROM (VALUES ('video', 0.4::DOUBLE, 1), ('audio', 0.3::DOUBLE, 2), ('vitals', 0.4::DOUBLE, 3),
    ('prescription', 0.45::DOUBLE, 4)) AS w(modality, weight, ord)""",
)
cte(
    "latest",
    """SELECT g.patient_id, g.k, g.t, g.modality, g.weight, g.ord, e.t AS event_t, e.severity, e.summary, e.evidence_id,
      g.weight * e.severity * pow(2.0::DOUBLE, -(g.t - e.t) / 86400.0::DOUBLE) AS part
    FROM (SELECT * FROM grid CROSS JOIN weights) g
    ASOF LEFT JOIN fe e ON g.patient_id = e.patient_id AND g.modality = e.modality AND g.t >= e.t""",
    "grid",
    "weights",
)
cte(
    "points",
    """SELECT patient_id, k, t, coalesce(sum(part ORDER BY ord), 0.0) AS score,
      coalesce(string_agg(CASE WHEN part IS NOT NULL THEN modality || '=' || printf('%.6f', part) END, ',' ORDER BY modality), '') AS contributions,
      coalesce(string_agg(CASE WHEN part IS NULL THEN modality END, ',' ORDER BY ord), '') AS missing,
      count(part) AS n_parts,
      string_agg(CASE WHEN part IS NOT NULL THEN '[' || modality || '] ' || summary || ' (' || CASE
          WHEN round_even(t - event_t, 0) <= 1 THEN 'now'
          WHEN round_even(t - event_t, 0) < 60 THEN round_even(t - event_t, 0)::BIGINT || 's ago'
          WHEN round_even(t - event_t, 0) < 3600 THEN round_even(t - event_t, 0)::BIGINT // 60 || 'min ago'
          ELSE round_even(t - event_t, 0)::BIGINT // 3600 || 'h ago' END || ')' END, ' — ' ORDER BY ord) AS said,
      string_agg(CASE WHEN part IS NOT NULL THEN modality || ': ' || printf('%.2f', part) END, ' | ' ORDER BY modality) AS listed,
      string_agg(CASE WHEN part IS NOT NULL THEN modality || ';' || summary || ';/evidence/' || evidence_id END, ',' ORDER BY ord) AS payload,
      coalesce(string_agg(evidence_id, '|' ORDER BY evidence_id), '') AS alert_key
    FROM latest GROUP BY patient_id, k, t""",
    "latest",
)
cte(
    "levels",
    """SELECT *, CASE lv WHEN 2 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS level FROM (
      SELECT p.*, list_reduce(list_concat([0.0::DOUBLE], scores[1:k + 1]), lambda acc, s: CASE
        WHEN acc = 0 THEN CASE WHEN s > 0.35::DOUBLE + 0.05::DOUBLE THEN 2.0 WHEN s > 0.15::DOUBLE + 0.05::DOUBLE THEN 1.0 ELSE 0.0 END
        WHEN acc = 1 THEN CASE WHEN s > 0.35::DOUBLE + 0.05::DOUBLE THEN 2.0 WHEN s < 0.15::DOUBLE - 0.05::DOUBLE THEN 0.0 ELSE 1.0 END
        ELSE CASE WHEN s < 0.15::DOUBLE - 0.05::DOUBLE THEN 0.0 WHEN s < 0.35::DOUBLE - 0.05::DOUBLE THEN 1.0 ELSE 2.0 END END) AS lv
      FROM points p JOIN (SELECT patient_id, list(score ORDER BY k) AS scores FROM points GROUP BY patient_id) USING (patient_id))""",
    "points",
)
cte(
    "moves",
    """SELECT * FROM (SELECT *, lag(level, 1, 'green') OVER (PARTITION BY patient_id ORDER BY k) AS previous_level FROM levels)
    WHERE level <> previous_level""",
    "levels",
)


@fam.add(
    "fus_severity_weight",
    stmt("SELECT severity_level, severity, count(*) AS n FROM fe GROUP BY ALL", "fe"),
)
def fus_severity_weight(spark, sf):
    return events(spark, sf).groupBy("severity_level", "severity").agg(F.count(F.lit(1)).alias("n"))


@fam.add(
    "fus_modality",
    stmt(
        """SELECT modality, CASE modality WHEN 'video_surgical' THEN 'video' ELSE modality END AS fused, count(*) AS n
        FROM uploads GROUP BY ALL""",
        "uploads",
    ),
)
def fus_modality(spark, sf):
    up = V.uploads(spark, sf)
    return up.groupBy("modality", FU.fusion_modality(F.col("modality")).alias("fused")).agg(F.count(F.lit(1)).alias("n"))


JOINED = """SELECT a.id AS analysis_id, u.patient_id, CASE a.modality WHEN 'video_surgical' THEN 'video' ELSE a.modality END AS modality,
    coalesce(CAST(json_extract_string(a.result, '$.details.instant_s') AS DOUBLE),
      greatest(0.0::DOUBLE, (epoch_us(a.created_at) - epoch_us(p.start_date)) / 1000000.0::DOUBLE)) AS t,
    json_extract_string(a.result, '$.evidence_id') AS evidence_id, json_extract_string(a.result, '$.summary') AS summary, a.score
    FROM analyses a JOIN uploads u ON a.upload_id = u.id JOIN patients p ON p.id = u.patient_id"""
cte("located", JOINED, "analyses", "uploads", "patients")


@fam.add("fus_event_instant", stmt("SELECT analysis_id, t AS instant_s FROM located", "located"))
def fus_event_instant(spark, sf):
    a, u, p = V.analyses(spark, sf), V.uploads(spark, sf), V.patients(spark, sf)
    return (
        a.withColumnRenamed("id", "analysis_id")
        .join(u.select(F.col("id").alias("upload_id"), "patient_id"), "upload_id")
        .join(p.select(F.col("id").alias("patient_id"), "start_date"), "patient_id")
        .select(
            "analysis_id",
            FU.event_instant(
                F.get_json_object("result", "$.details.instant_s").try_cast("double"),
                F.col("created_at"),
                F.col("start_date"),
            ).alias("instant_s"),
        )
    )


@fam.add(
    "fus_fusion_events",
    stmt(
        """SELECT patient_id, modality, t, CASE upper(sev) WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.7::DOUBLE
        WHEN 'MEDIUM' THEN 0.45::DOUBLE WHEN 'LOW' THEN 0.2::DOUBLE WHEN 'INFO' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS severity,
        summary, evidence_id FROM located JOIN (SELECT evidence_id, arg_min(severity, feature || '/' || run_id) AS sev FROM evidence GROUP BY 1)
        USING (evidence_id) WHERE score IS NOT NULL AND score <> 0""",
        "located",
        "evidence",
    ),
)
def fus_fusion_events(spark, sf):
    ev = FU.fusion_events(V.analyses(spark, sf), V.uploads(spark, sf), V.patients(spark, sf), V.evidence(spark, sf))
    return ev.select("patient_id", "modality", "t", "severity", "summary", "evidence_id")


@fam.add(
    "fus_order_events",
    stmt(
        """SELECT patient_id, evidence_id, row_number() OVER (PARTITION BY patient_id ORDER BY t, seq) - 1 AS position FROM fe""",
        "fe",
    ),
)
def fus_order_events(spark, sf):
    from wardwatch.plans.ordered import dense_index

    day = F.floor(F.col("t") / 86400).cast("long")
    ev = dense_index(events(spark, sf), ["patient_id"], ["t", "seq"], day, "position")
    return ev.select("patient_id", "evidence_id", "position")


@fam.add(
    "fus_half_life_decay",
    stmt("SELECT evidence_id, round(pow(2.0::DOUBLE, -t / 86400.0::DOUBLE), 9) AS decay FROM fe", "fe"),
)
def fus_half_life_decay(spark, sf):
    return events(spark, sf).select(
        "evidence_id", F.round(FU.half_life_decay(F.col("t"), HALF), 9).alias("decay")
    )


@fam.add("fus_time_grid", stmt("SELECT patient_id, k, t FROM grid", "grid"))
def fus_time_grid(spark, sf):
    return FU.time_grid(events(spark, sf), STEP)


@fam.add(
    "fus_asof_latest",
    stmt("SELECT patient_id, t, modality, event_t, evidence_id FROM latest WHERE event_t IS NOT NULL", "latest"),
)
def fus_asof_latest(spark, sf):
    grid = FU.latest_per_modality(events(spark, sf), step=STEP)
    each = F.explode(
        F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).alias("e")) for m in FU.WEIGHTS])
    )
    return (
        grid.select("patient_id", "t", each.alias("m"))
        .filter(F.col("m.e").isNotNull())
        .select(
            "patient_id",
            "t",
            F.col("m.modality").alias("modality"),
            F.col("m.e.t").alias("event_t"),
            F.col("m.e.evidence_id").alias("evidence_id"),
        )
    )


@fam.add(
    "fus_risk_score",
    stmt("SELECT patient_id, t, round(score, 6) AS score, contributions, missing, alert_key AS evidence FROM points", "points"),
)
def fus_risk_score(spark, sf):
    from wardwatch.functions.text import fixed

    listed = F.transform(
        F.array_sort(F.map_entries("contributions")), lambda kv: F.concat(kv["key"], F.lit("="), fixed(kv["value"], 6))
    )
    return points(spark, sf).select(
        "patient_id",
        "t",
        F.round("score", 6).alias("score"),
        F.array_join(listed, ",").alias("contributions"),
        F.array_join("missing", ",").alias("missing"),
        FU.alert_key(F.col("events")).alias("evidence"),
    )


@fam.add("fus_hysteresis_level", stmt("SELECT patient_id, t, round(score, 6) AS score, level FROM levels", "levels"))
def fus_hysteresis_level(spark, sf):
    return levelled(spark, sf).select("patient_id", "t", F.round("score", 6).alias("score"), "level")


@fam.add("fus_transitions", stmt("SELECT patient_id, t, previous_level, level, alert_key AS evidence FROM moves", "moves"))
def fus_transitions(spark, sf):
    return FU.transitions(levelled(spark, sf)).select(
        "patient_id", "t", "previous_level", "level", FU.alert_key(F.col("events")).alias("evidence")
    )


@fam.add("fus_alert_triggers", stmt("SELECT patient_id, t, round(score, 6) AS score FROM moves WHERE level = 'red'", "moves"))
def fus_alert_triggers(spark, sf):
    return FU.alert_triggers(levelled(spark, sf)).select("patient_id", "t", F.round("score", 6).alias("score"))


ALERTS = """SELECT patient_id, alert_key, t, level, printf('%.2f', score)::DOUBLE AS score,
    CASE WHEN n_parts = 0 THEN 'elevated risk' WHEN n_parts > 1 THEN said || ' — (contributions: ' || listed || ')' ELSE said END AS reason, payload
    FROM moves WHERE level = 'red' QUALIFY row_number() OVER (PARTITION BY patient_id, alert_key ORDER BY k) = 1"""
cte("alerts", ALERTS, "moves")


def alerts(spark, sf):
    return FU.dedup_alerts(levelled(spark, sf))


@fam.add("fus_dedup_alerts", stmt("SELECT patient_id, alert_key, t, level, score FROM alerts", "alerts"))
def fus_dedup_alerts(spark, sf):
    return alerts(spark, sf).select("patient_id", "alert_key", "t", "level", "score")


@fam.add(
    "fus_dedup_against_stored",
    stmt("SELECT patient_id, alert_key, t, level FROM alerts WHERE t > 3 * 86400", "alerts"),
)
def fus_dedup_against_stored(spark, sf):
    lv = levelled(spark, sf)
    stored = FU.dedup_alerts(lv).filter(F.col("t") <= 3 * 86400)
    return FU.dedup_alerts(lv, stored).select("patient_id", "alert_key", "t", "level")


@fam.add("fus_alert_payload", stmt("SELECT patient_id, alert_key, t, payload FROM alerts", "alerts"))
def fus_alert_payload(spark, sf):
    return alerts(spark, sf).select(
        "patient_id",
        "alert_key",
        "t",
        F.array_join(F.transform("payload", lambda p: F.concat_ws(";", p["modality"], p["summary"], p["link"])), ",").alias(
            "payload"
        ),
    )


@fam.add("fus_clinical_reason", stmt("SELECT patient_id, alert_key, t, reason FROM alerts", "alerts"))
def fus_clinical_reason(spark, sf):
    return alerts(spark, sf).select("patient_id", "alert_key", "t", "reason")


@fam.add(
    "fus_metadata_summary",
    """SELECT event_id, 'type=' || event_type || ', value=' || value || ', k=' || json_extract_string(props, '$.k') AS summary FROM events""",
)
def fus_metadata_summary(spark, sf):
    ev = V.table(spark, sf, "events")
    meta = F.create_map(
        F.lit("type"),
        F.col("event_type"),
        F.lit("value"),
        F.col("value").cast("string"),
        F.lit("k"),
        F.get_json_object("props", "$.k"),
    )
    return ev.select("event_id", FU.metadata_summary(meta).alias("summary"))


@fam.add("fus_current_level", stmt("SELECT patient_id, arg_max(level, k) AS level FROM levels GROUP BY patient_id", "levels"))
def fus_current_level(spark, sf):
    return FU.current_level(levelled(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The whole risk timeline with levels."""
    return fus_hysteresis_level(spark, sf)

