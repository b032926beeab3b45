"""Bridge views as common table expressions, with their dependencies."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def stmt(select: str, *names: str) -> str:
    """``select`` preceded by the named views and everything they need."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + select


cte(
    "samples",
    """SELECT user_id::VARCHAR AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    'FHR' AS channel, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS x FROM events""",
)
cte(
    "bedside",
    """SELECT user_id::VARCHAR AS record_id, CASE WHEN event_id % 2 = 0 THEN 'HR' ELSE 'SpO2' END AS channel,
    row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS idx,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE WHEN event_id % 2 = 0 THEN value + 40.0::DOUBLE
         ELSE 100.0::DOUBLE - value / 8.0::DOUBLE END AS x FROM events""",
)
cte(
    "raw_samples",
    """SELECT user_id::VARCHAR AS user_id, user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS record_id,
    CASE event_type WHEN 'click' THEN 'FHR,' WHEN 'view' THEN ' UC' WHEN 'purchase' THEN 'HR,,'
      WHEN 'signup' THEN 'SpO2,' ELSE 'PLETH' END AS channel, value AS x FROM events""",
)
cte(
    "records",
    "SELECT DISTINCT user_id::VARCHAR AS record_id, 1.0::DOUBLE AS fs, 7.0::DOUBLE + (user_id % 10) / 50.0::DOUBLE AS ph FROM events",
)
cte(
    "fusion_events",
    """SELECT user_id::VARCHAR AS patient_id,
    CASE event_type WHEN 'click' THEN 'video' WHEN 'view' THEN 'audio' WHEN 'purchase' THEN 'vitals'
      WHEN 'error' THEN 'prescription' ELSE 'other' END AS modality,
    (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t,
    CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 60 THEN 'HIGH' WHEN value >= 30 THEN 'MEDIUM'
      WHEN value >= 10 THEN 'LOW' ELSE 'INFO' END AS severity_level,
    'value ' || value::VARCHAR AS summary, 'ev-' || event_id::VARCHAR AS evidence_id, event_id AS seq FROM events""",
)
cte(
    "prescriptions",
    """SELECT o_custkey::VARCHAR AS patient_id, lower(p_type) AS drug, l_quantity AS dose, 'mg' AS unit,
    strftime(o_orderdate, '%Y-%m-%d') AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)
cte(
    "catalog",
    """SELECT * FROM (VALUES
    ('standard', 5.0::DOUBLE, 40.0::DOUBLE, 'mg', 'standardine', '', false, 'label', 1),
    ('small', 1.0::DOUBLE, 30.0::DOUBLE, 'mg', 'smalline', '', false, 'label', 1),
    ('medium', 10.0::DOUBLE, 45.0::DOUBLE, 'mg', 'mediumine', 'B1', true, 'register', 2),
    ('large', 5.0::DOUBLE, 35.0::DOUBLE, 'mg', 'largine', 'C1', true, 'register', 2),
    ('promo', 8.0::DOUBLE, 50.0::DOUBLE, 'mg/h', 'promoline', 'A1', true, 'register', 3))
    AS c(name, min_dose, max_dose, c_unit, active_ingredient, control_category, is_controlled, source, criticality)""",
)
cte(
    "segments",
    """SELECT conv_id::VARCHAR AS recording_id, turn AS seg_idx, turn * 10.0::DOUBLE AS start_s, turn * 10.0::DOUBLE + 10.0 AS end_s,
    text, (length(text) % 10) / 10.0::DOUBLE AS no_speech_prob FROM conversations""",
)
cte(
    "acoustic",
    """SELECT l_returnflag AS run_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS recording_id,
    l_tax / 5.0::DOUBLE AS jitter_local, l_discount AS shimmer_local, l_quantity AS hnr_db,
    l_discount * 5.0::DOUBLE AS pause_rate, l_linenumber::DOUBLE AS speaking_rate_wps FROM lineitem""",
)
cte(
    "poses",
    """SELECT label::VARCHAR AS seq_id, (rn // 2)::BIGINT AS frame_idx, (rn % 2)::BIGINT AS pose_idx,
    CASE WHEN vec_id % 11 <> 0 THEN (vec_id % 2)::BIGINT END AS track_id,
    list_transform(range(0, 16), lambda i: {'x': 0.5::DOUBLE + e[4*i+1], 'y': 0.5::DOUBLE + e[4*i+2], 'z': e[4*i+3],
      'vis': least(1.0::DOUBLE, abs(e[4*i+4]) * 8.0::DOUBLE)}) AS lm
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings)""",
)
cte(
    "sequences",
    """SELECT label::VARCHAR AS seq_id, CASE WHEN label % 2 = 0 THEN 'fall' ELSE 'adl' END AS label,
    ((count(*) + 1) // 2)::BIGINT AS n_frames FROM embeddings GROUP BY label""",
)
cte(
    "boxes",
    """SELECT l_orderkey AS image, l_returnflag AS class, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y,
    l_quantity AS w, l_linenumber * 10.0::DOUBLE AS h, l_discount * 10.0::DOUBLE AS confidence, l_linestatus AS status,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_id FROM lineitem""",
)
cte(
    "binary_rows",
    """SELECT source AS detector, quality = 1 AS y_true, n_chars > 1000 AS y_pred, toxic = 1 AS toxic
    FROM labels JOIN documents USING (doc_id)""",
)
cte(
    "patients",
    """SELECT c_custkey::VARCHAR AS id, c_name AS name,
    TIMESTAMP '1995-01-01' + to_days((c_custkey % 100)::INTEGER) AS start_date FROM customer""",
)
MODALITY = """CASE {k} % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video_surgical' WHEN 2 THEN 'audio'
    WHEN 3 THEN 'prescription' ELSE 'vitals' END"""
cte(
    "uploads",
    f"""SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, {MODALITY.format(k='o_orderkey')} AS modality,
    o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE 'received' END AS status FROM orders""",
)
IDENT = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
cte(
    "analyses",
    f"""SELECT {IDENT} AS id, l_orderkey::VARCHAR AS upload_id, {MODALITY.format(k='l_orderkey')} AS modality,
    '{{"summary":"flag ' || l_returnflag || '","evidence_id":' ||
      CASE WHEN l_tax > 0.01 THEN '"ev-' || {IDENT} || '"' ELSE 'null' END || ',"details":{{"line":' || l_linenumber ||
      CASE WHEN l_linenumber = 1 THEN ',"instant_s":' || (l_partkey * 60)::VARCHAR ELSE '' END || '}}}}' AS result,
    l_discount AS score, l_shipdate AS created_at FROM lineitem""",
)
cte(
    "evidence",
    f"""SELECT 'ev-' || {IDENT} AS evidence_id, CASE WHEN l_returnflag = 'A' THEN 'vitals' ELSE 'video' END AS feature,
    'run-' || (l_suppkey % 7)::VARCHAR AS run_id,
    CASE WHEN l_quantity >= 40 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 20 THEN 'medium'
      WHEN l_quantity >= 10 THEN 'LOW' ELSE 'odd' END AS severity FROM lineitem WHERE l_linestatus = 'F'""",
)
cte(
    "doc_lines",
    """SELECT doc_id, (i - 1)::BIGINT AS line_no, parts[i] AS line FROM (
      SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
)
