"""Registry queries on customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from registered import fusion as FQ
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import fusion as FU
from wardwatch.operators import registry as RG

fam = Family()
SOMEONE = "605"


def stored_alerts(spark, sf) -> DataFrame:
    """Alerts stored for a customer: orders, red or yellow by priority."""
    o = V.table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("al-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.when(F.col("o_orderpriority") < "3", "red").otherwise("yellow").alias("level"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


cte(
    "stored",
    """SELECT 'al-' || o_orderkey AS id, o_custkey::VARCHAR AS patient_id, CASE WHEN o_orderpriority < '3' THEN 'red' ELSE 'yellow' END AS level, o_orderdate AS created_at
    FROM orders""",
)
DAY = "strftime({0}, '%Y-%m-%d')"


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@fam.add("reg_patients_ordered", stmt(f"SELECT id, name, {DAY.format('start_date')} AS start_date FROM patients", "patients"))
def _patients(spark, sf):
    return RG.patients_ordered(V.patients(spark, sf)).select("id", "name", day("start_date"))


@fam.add("reg_uploads_of", stmt(f"SELECT id, modality, status, {DAY.format('created_at')} AS created_at FROM uploads WHERE patient_id = '605'", "uploads"))
def _uploads(spark, sf):
    return RG.uploads_of(V.uploads(spark, sf), SOMEONE).select("id", "modality", "status", day("created_at"))


cte("latest_analysis", "SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) = 1", "analyses")


@fam.add("reg_latest_analysis_per_upload", stmt("SELECT upload_id, id, modality, score FROM latest_analysis", "latest_analysis"))
def _latest(spark, sf):
    return RG.latest_analysis_per_upload(V.analyses(spark, sf)).select("upload_id", "id", "modality", "score")


@fam.add(
    "reg_analyses_of_patient",
    stmt("SELECT a.id, a.upload_id, a.score FROM analyses a JOIN uploads u ON a.upload_id = u.id WHERE u.patient_id = '605'", "analyses", "uploads"),
)
def _of_patient(spark, sf):
    return RG.analyses_of_patient(V.analyses(spark, sf), V.uploads(spark, sf), SOMEONE).select("id", "upload_id", "score")


@fam.add("reg_alerts", stmt(f"SELECT id, patient_id, level, {DAY.format('created_at')} AS created_at FROM stored", "stored"))
def _alerts(spark, sf):
    return RG.alerts_newest_first(stored_alerts(spark, sf)).select("id", "patient_id", "level", day("created_at"))


@fam.add("reg_alerts_of_patient", stmt("SELECT id, level FROM stored WHERE patient_id = '605'", "stored"))
def _alerts_of(spark, sf):
    return RG.alerts_newest_first(stored_alerts(spark, sf), SOMEONE).select("id", "level")


@fam.add(
    "reg_cascade_delete",
    stmt(
        """SELECT 'patients' AS table_name, id FROM patients WHERE id::BIGINT % 3 <> 0 UNION ALL
        SELECT 'uploads', id FROM uploads WHERE patient_id::BIGINT % 3 <> 0 UNION ALL
        SELECT 'analyses', a.id FROM analyses a LEFT JOIN uploads u ON u.id = a.upload_id WHERE u.id IS NULL OR u.patient_id::BIGINT % 3 <> 0 UNION ALL
        SELECT 'alerts', id FROM stored WHERE patient_id::BIGINT % 3 <> 0""",
        "patients",
        "uploads",
        "analyses",
        "stored",
    ),
)
def _cascade(spark, sf):
    p = V.patients(spark, sf)
    gone = p.filter(F.col("id").cast("long") % 3 == 0).select(F.col("id").alias("patient_id"))
    left = RG.cascade_delete(gone, p, V.uploads(spark, sf), V.analyses(spark, sf), stored_alerts(spark, sf))
    out = None
    for name, df in left.items():
        part = df.select(F.lit(name).alias("table_name"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@fam.add(
    "reg_apply_status_updates",
    stmt(
        """SELECT u.id, coalesce(s.status, u.status) AS status FROM uploads u LEFT JOIN (
        SELECT l_orderkey::VARCHAR AS id, arg_max(CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'error' ELSE 'processing' END,
          (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS status FROM lineitem GROUP BY 1) s USING (id)""",
        "uploads",
    ),
)
def _status(spark, sf):
    li = V.table(spark, sf, "lineitem")
    log = li.select(
        F.col("l_orderkey").cast("string").alias("upload_id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "error").otherwise("processing").alias("status"),
    )
    return RG.apply_status_updates(V.uploads(spark, sf), log).select("id", "status")


@fam.add(
    "reg_filter_alerts",
    stmt("SELECT s.id, s.patient_id, s.level, p.name AS patient_name FROM stored s LEFT JOIN patients p ON p.id = s.patient_id WHERE level = 'red'", "stored", "patients"),
)
def _filter(spark, sf):
    return RG.filter_alerts(stored_alerts(spark, sf), V.patients(spark, sf), level="red").select("id", "patient_id", "level", "patient_name")


@fam.add(
    "reg_modality_panel",
    stmt(
        """SELECT u.patient_id, u.modality, u.id AS upload_id, u.status, a.id AS analysis_id, a.score, coalesce(a.score > 0, false) AS has_finding FROM (
        SELECT * FROM uploads QUALIFY row_number() OVER (PARTITION BY patient_id, modality ORDER BY created_at DESC, id DESC) = 1) u
        LEFT JOIN latest_analysis a ON a.upload_id = u.id""",
        "uploads",
        "latest_analysis",
    ),
)
def _panel(spark, sf):
    return RG.modality_panel(V.uploads(spark, sf), V.analyses(spark, sf))


@fam.add(
    "reg_patient_overview",
    stmt(
        """SELECT id, name, coalesce(level, 'green') AS level FROM patients LEFT JOIN (SELECT patient_id AS id, arg_max(level, k) AS level FROM levels GROUP BY 1) USING (id)""",
        "patients",
        "levels",
    ),
)
def _overview(spark, sf):
    now = FU.current_level(FQ.levelled(spark, sf))
    return RG.patient_overview(V.patients(spark, sf), now).select("id", "name", "level")


@fam.add(
    "reg_analysis_fields",
    stmt(
        """SELECT id, json_extract_string(result, '$.summary') AS summary, json_extract_string(result, '$.evidence_id') AS evidence_id,
        CAST(json_extract_string(result, '$.details.instant_s') AS DOUBLE) AS instant_s FROM analyses""",
        "analyses",
    ),
)
def _fields(spark, sf):
    return RG.analysis_fields(V.analyses(spark, sf))


@fam.add(
    "reg_readable_values",
    """SELECT event_id, CASE WHEN m < 60 THEN m || ' min' ELSE m // 60 || ' h ' || lpad((m % 60)::VARCHAR, 2, '0') || ' min' END AS readable,
      greatest(0, floor((epoch_us(ts) - 1704499200000000) / 86400000000.0)::BIGINT) AS days, floor(value / 100.0::DOUBLE * 100.0::DOUBLE + 0.5)::BIGINT || '%' AS pct
    FROM (SELECT *, greatest(0, floor(value * 60 - 600 + 0.5)::BIGINT) // 60 AS m FROM events)""",
)
def _readable(spark, sf):
    ev = V.table(spark, sf, "events")
    start = F.timestamp_seconds(F.lit(1704499200))
    return ev.select(
        "event_id",
        RG.readable_time(F.col("value") * dbl(60) - dbl(600)).alias("readable"),
        RG.monitoring_days(F.col("ts").cast("timestamp"), start).alias("days"),
        RG.percent(F.col("value") / dbl(100)).alias("pct"),
    )
