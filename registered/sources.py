"""Parsers, routing, evidence and report rows on lines built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from registered import fusion as FQ
from registered import quality as QQ
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import fusion as FU
from wardwatch.operators import quality as Q
from wardwatch.session import ensure_checkpoint_dir
from wardwatch.sources import documents as DOC
from wardwatch.sources import evidence as EV
from wardwatch.sources import evidence_log as LOG
from wardwatch.sources import images as IM
from wardwatch.sources import recordings as REC
from wardwatch.sources import signals as SIG

fam = Family()


def day_records(spark, sf) -> DataFrame:
    raw = V.raw_channel_samples(spark, sf)
    ids = raw.select("record_id", F.col("user_id").cast("long").alias("_u")).distinct()
    ph = F.when(F.col("_u") % 7 != 0, dbl(7) + (F.col("_u") % 10) / dbl(50))
    return ids.select("record_id", dbl(1).alias("fs"), ph.alias("ph"))


def cleaned(spark, sf) -> DataFrame:
    return V.raw_channel_samples(spark, sf).withColumn("channel", SIG.clean_channel(F.col("channel")))


cte("channels", "SELECT user_id, record_id, rtrim(trim(channel), ',') AS channel, x FROM raw_samples", "raw_samples")
cte(
    "day_judged",
    """SELECT record_id, CASE WHEN NOT bool_or(channel = 'FHR') THEN 'missing channel FHR' WHEN NOT bool_or(channel = 'UC') THEN 'missing channel UC'
      WHEN any_value(user_id)::BIGINT % 7 = 0 THEN 'missing pH' END AS reason, 7.0::DOUBLE + (any_value(user_id)::BIGINT % 10) / 50.0::DOUBLE AS ph
    FROM channels GROUP BY record_id""",
    "channels",
)


@fam.add("io_split_valid", stmt("SELECT record_id, 1.0::DOUBLE AS fs, ph FROM day_judged WHERE reason IS NULL", "day_judged"))
def _valid(spark, sf):
    return SIG.split_valid_rejects(cleaned(spark, sf), day_records(spark, sf))[0]


@fam.add("io_split_rejects", stmt("SELECT record_id, reason FROM day_judged WHERE reason IS NOT NULL", "day_judged"))
def _rejects(spark, sf):
    return SIG.split_valid_rejects(cleaned(spark, sf), day_records(spark, sf))[1]


OUTCOME = """SELECT o_custkey::VARCHAR AS record_id, CASE WHEN f % 4 = 0 THEN ('7.' || lpad((f % 100)::VARCHAR, 2, '0'))::DOUBLE END AS ph
    FROM (SELECT o_custkey, min(CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey END) AS f FROM orders GROUP BY o_custkey)"""


@fam.add("io_outcome_from_comments", OUTCOME)
def _outcome(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    body = F.concat(F.lit("7."), F.lpad((k % 100).cast("string"), 2, "0"))
    line = (
        F.when(k % 4 == 0, F.concat(F.lit(" pH           "), body))
        .when(k % 4 == 1, F.concat(F.lit("pCO2         "), body))
        .when(k % 4 == 2, F.concat(F.lit("pH_alt       "), body))
        .otherwise(F.lit("pH           unmeasured"))
    )
    lines = o.select(F.col("o_custkey").cast("string").alias("record_id"), k.alias("line_no"), line.alias("line"))
    return SIG.outcome_from_comments(lines)


@fam.add("io_clean_channel_names", stmt("SELECT record_id, channel, count(*) AS n FROM channels GROUP BY ALL", "channels"))
def _clean(spark, sf):
    return cleaned(spark, sf).groupBy("record_id", "channel").agg(F.count(F.lit(1)).alias("n"))


@fam.add(
    "io_route_by_channels",
    stmt(
        """SELECT record_id, CASE WHEN bool_or(channel = 'HR') AND bool_or(channel = 'SpO2') THEN 'inpatient'
        WHEN bool_or(channel = 'FHR') THEN 'ctg' ELSE 'rejected' END AS route FROM channels GROUP BY 1""",
        "channels",
    ),
)
def _route(spark, sf):
    return SIG.route_by_channels(cleaned(spark, sf))


@fam.add(
    "io_beat_annotations",
    """SELECT user_id::VARCHAR AS record_id, count(*) FILTER (event_type <> 'view') AS n_anomalous, count(*) FILTER (event_type <> 'view') > 0 AS has_anomaly
    FROM events GROUP BY 1""",
)
def _beats(spark, sf):
    ev = V.table(spark, sf, "events")
    symbol = F.when(F.col("event_type") == "view", "N").otherwise(F.upper(F.substring("event_type", 1, 1)))
    return SIG.beat_annotations(ev.select(F.col("user_id").cast("string").alias("record_id"), symbol.alias("symbol")))


NAME = """l_suppkey || '_' || l_linenumber || 'b' || (l_partkey % 5) || '_' || CASE WHEN l_returnflag = 'A' THEN 'Al' ELSE 'Pr' END ||
    CASE WHEN l_linenumber = 4 THEN '_sc_extra' ELSE '_mc' END || '_' || 'Dev' || (l_orderkey % 3)"""


def files(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    parts = [
        F.col("l_suppkey").cast("string"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("b"), (F.col("l_partkey") % 5).cast("string")),
        F.when(F.col("l_returnflag") == "A", "Al").otherwise("Pr"),
        F.when(F.col("l_linenumber") == 4, "sc_extra").otherwise("mc"),
        F.concat(F.lit("Dev"), (F.col("l_orderkey") % 3).cast("string")),
    ]
    return li.select(F.concat(F.lit("/data/rec.v1/"), F.concat_ws("_", *parts), F.lit(".wav")).alias("path"))


@fam.add(
    "io_parse_recording_name",
    f"""SELECT '/data/rec.v1/' || n || '.wav' AS path, split_part(n, '_', 1) AS patient_id, split_part(n, '_', 2) AS recording_index,
    split_part(n, '_', 3) AS location, split_part(n, '_', 4) AS mode, split_part(n, '_', 5) AS equipment
    FROM (SELECT {NAME} AS n FROM lineitem) WHERE len(string_split(n, '_')) = 5""",
)
def _names(spark, sf):
    return REC.recording_parts(files(spark, sf))[0]


@fam.add(
    "io_rejected_recording_names",
    f"SELECT '/data/rec.v1/' || n || '.wav' AS path FROM (SELECT {NAME} AS n FROM lineitem) WHERE len(string_split(n, '_')) <> 5",
)
def _bad_names(spark, sf):
    return REC.recording_parts(files(spark, sf))[1]


def cycle_lines(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    start = (F.col("l_partkey") % 50).cast("double")
    crackle = F.when(F.col("l_suppkey") % 4 == 3, "2").otherwise((F.col("l_suppkey") % 2).cast("string"))
    end = F.when(F.col("l_linenumber") == 5, F.lit("end")).otherwise((start + F.col("l_quantity")).cast("string"))
    wheeze = (F.col("l_partkey") % 2).cast("string")
    line = F.when(F.col("l_linenumber") == 6, F.concat_ws("\t", start.cast("string"), end, crackle)).otherwise(
        F.concat(F.lit(" "), F.concat_ws("\t", start.cast("string"), end, crackle, wheeze), F.lit(" "))
    )
    return li.select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        line.alias("line"),
    )


cte(
    "cycles",
    """SELECT l_orderkey::VARCHAR AS record_id, l_partkey * 10 + l_linenumber AS cycle_index, (l_partkey % 50)::DOUBLE AS start_s,
    (l_partkey % 50)::DOUBLE + l_quantity AS end_s, CASE WHEN l_suppkey % 2 = 1 AND l_partkey % 2 = 1 THEN 'both' WHEN l_suppkey % 2 = 1 THEN 'crackle'
      WHEN l_partkey % 2 = 1 THEN 'wheeze' ELSE 'normal' END AS label
    FROM lineitem WHERE l_suppkey % 4 <> 3 AND l_linenumber NOT IN (5, 6)""",
)


@fam.add("io_parse_cycle_lines", stmt("SELECT * FROM cycles", "cycles"))
def _cycles(spark, sf):
    return REC.parse_cycle_lines(cycle_lines(spark, sf))


@fam.add(
    "io_annotated_frames",
    """SELECT image_id, file_name, coalesce(b.boxes, '') AS boxes FROM (SELECT o_orderkey AS image_id, 'img-' || o_orderkey || '.png' AS file_name FROM orders)
    LEFT JOIN (SELECT l_orderkey AS image_id, string_agg(l_returnflag || ':' || (l_partkey % 100)::DOUBLE || ':' || (l_suppkey % 100)::DOUBLE || ':' || l_quantity || ':' || l_linenumber::DOUBLE, ';'
       ORDER BY l_returnflag, (l_partkey % 100), (l_suppkey % 100), l_quantity, l_linenumber) AS boxes
     FROM lineitem GROUP BY 1) b USING (image_id)""",
)
def _coco(spark, sf):
    """Whole tables as annotation files, read back range by range."""
    images = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.concat(F.lit("img-"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name")
    )
    li = V.table(spark, sf, "lineitem")
    code = F.ascii("l_returnflag").cast("long")
    notes = li.select(
        F.col("l_orderkey").alias("image_id"),
        code.alias("category_id"),
        F.array(
            (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity"), F.col("l_linenumber").cast("double")
        ).alias("bbox"),
    )
    names = li.select(code.alias("category_id"), F.col("l_returnflag").alias("class")).distinct()
    folder = f"{ensure_checkpoint_dir(spark)}/coco-{uuid.uuid4().hex}"
    IM.write_coco(images, notes, names, folder, files=None)
    out = IM.annotated_frames(*IM.coco_tables(spark, folder, 1 << 20))
    text = F.transform("boxes", lambda b: F.concat_ws(":", b["class"], *[b[c].cast("string") for c in "xywh"]))
    return out.select("image_id", "file_name", F.array_join(text, ";").alias("boxes"))


FRAME = "CASE vec_id % 3 WHEN 0 THEN 'fall' WHEN 1 THEN 'adl' ELSE 'other' END || '-' || lpad(label::VARCHAR, 2, '0')"


def frame_files(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "embeddings").select("vec_id", "label")
    seq = F.concat(
        F.when(F.col("vec_id") % 3 == 0, "fall").when(F.col("vec_id") % 3 == 1, "adl").otherwise("other"),
        F.lit("-"),
        F.lpad(F.col("label").cast("string"), 2, "0"),
    )
    return e.select(
        F.concat(F.lit("/seqs/"), seq, F.lit("/"), seq, F.lit("-cam0-rgb/"), seq, F.lit("-"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path")
    )


@fam.add(
    "io_frame_index_and_label",
    f"""SELECT '/seqs/' || s || '/' || s || '-cam0-rgb/' || s || '-' || vec_id || '.png' AS path, s AS seq_id, vec_id AS frame_idx, split_part(s, '-', 1) AS label
    FROM (SELECT vec_id, {FRAME} AS s FROM embeddings) WHERE s NOT LIKE 'other%'""",
)
def _frames(spark, sf):
    return IM.frame_index_and_label(frame_files(spark, sf))[0]


@fam.add(
    "io_rejected_sequences",
    f"""SELECT '/seqs/' || s || '/' || s || '-cam0-rgb/' || s || '-' || vec_id || '.png' AS path
    FROM (SELECT vec_id, {FRAME} AS s FROM embeddings) WHERE s LIKE 'other%'""",
)
def _bad_frames(spark, sf):
    return IM.frame_index_and_label(frame_files(spark, sf))[1]


def rx_lines(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    text = lambda c: F.col(c).cast("string")
    dose = F.when(n == 3, "ten mg").when(n == 4, "12").otherwise(F.concat(text("l_quantity"), F.lit(" mg oral")))
    lines = F.array(
        F.lit("Receita médica"),
        F.concat(F.lit("Paciente: P"), text("l_orderkey")),
        F.concat(F.lit("Medicamento: old")),
        F.concat(F.lit(" Medicamento : "), F.when(n == 2, "").otherwise(F.concat(F.lit("drug: "), text("l_returnflag")))),
        F.concat(F.lit("Dose: "), dose),
        F.when(n == 6, "Frequencia: 8/8h").otherwise("Frequência: 8/8h"),
        F.concat(F.lit("Data: "), F.date_format("l_shipdate", "yyyy-MM-dd")),
    )
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(ident.alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))


IDENT = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@fam.add(
    "io_parse_prescription_lines",
    f"""SELECT {IDENT} AS doc_id, 'P' || l_orderkey AS patient_id, 'drug: ' || l_returnflag AS drug, CASE WHEN l_linenumber = 4 THEN 12.0::DOUBLE ELSE l_quantity END AS dose,
    CASE WHEN l_linenumber = 4 THEN '' ELSE 'mg oral' END AS unit, '8/8h' AS frequency, strftime(l_shipdate, '%Y-%m-%d') AS ts
    FROM lineitem WHERE l_linenumber NOT IN (2, 3, 6)""",
)
def _rx_lines(spark, sf):
    return DOC.parse_prescription_lines(rx_lines(spark, sf))[0]


@fam.add(
    "io_prescription_failures",
    f"""SELECT {IDENT} AS doc_id, CASE l_linenumber WHEN 2 THEN 'Medicamento' WHEN 3 THEN 'Dose' ELSE 'Frequência' END AS field,
    CASE l_linenumber WHEN 3 THEN 'dose is not a number: ten' ELSE 'field missing in the text' END AS reason
    FROM lineitem WHERE l_linenumber IN (2, 3, 6)""",
)
def _rx_failures(spark, sf):
    return DOC.parse_prescription_lines(rx_lines(spark, sf))[1]


def findings(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "A", "vitals").otherwise("video").alias("feature"),
        F.concat(F.lit("run-"), (F.col("l_suppkey") % 7).cast("string")).alias("run_id"),
        F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("evidence_id"),
        F.col("l_orderkey").cast("string").alias("source_record_id"),
        F.when(F.col("l_linenumber") < 3, "HIGH").alias("severity"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
    )


cte(
    "evidence_last",
    """SELECT feature, run_id, evidence_id, source_record_id, coalesce(severity, 'MEDIUM') AS severity FROM (
      SELECT CASE WHEN l_returnflag = 'A' THEN 'vitals' ELSE 'video' END AS feature, 'run-' || (l_suppkey % 7) AS run_id, 'e' || l_partkey AS evidence_id,
        l_orderkey::VARCHAR AS source_record_id, CASE WHEN l_linenumber < 3 THEN 'HIGH' END AS severity, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY feature, run_id, evidence_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)


@fam.add(
    "io_evidence_rows",
    stmt(
        """SELECT *, '' AS modality, '' AS event_type, 0.0::DOUBLE AS confidence, '' AS ts, '' AS patient_id, 'positive' AS status,
        'output/' || feature || '/' || run_id || '/' || evidence_id || '.json' AS path FROM evidence_last""",
        "evidence_last",
    ),
)
def _evidence_rows(spark, sf):
    return EV.evidence_rows(findings(spark, sf))


def refs(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(
        F.when(F.col("p_size") % 2 == 0, "vitals").otherwise("video").alias("feature"),
        F.concat(F.lit("run-"), (F.col("p_size") % 7).cast("string")).alias("run_id"),
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("evidence_id"),
    )


cte("refs", "SELECT CASE WHEN p_size % 2 = 0 THEN 'vitals' ELSE 'video' END AS feature, 'run-' || (p_size % 7) AS run_id, 'e' || p_partkey AS evidence_id FROM part")


@fam.add("io_resolve_evidence", stmt("SELECT * FROM refs JOIN evidence_last USING (feature, run_id, evidence_id)", "refs", "evidence_last"))
def _resolve(spark, sf):
    rows = EV.evidence_rows(findings(spark, sf)).select(*EV.KEY, "source_record_id", "severity")
    return EV.resolve_evidence(refs(spark, sf), rows)[0]


@fam.add("io_unresolved_evidence", stmt("SELECT * FROM refs ANTI JOIN evidence_last USING (feature, run_id, evidence_id)", "refs", "evidence_last"))
def _unresolved(spark, sf):
    return EV.resolve_evidence(refs(spark, sf), EV.evidence_rows(findings(spark, sf)))[1]


@fam.add(
    "io_resolve_evidence_by_id",
    stmt(
        """SELECT evidence_id, e.feature, e.run_id, e.source_record_id, e.severity FROM (SELECT evidence_id FROM refs) JOIN (
        SELECT * FROM evidence_last QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY feature || '/' || run_id) = 1) e USING (evidence_id)""",
        "refs",
        "evidence_last",
    ),
)
def _by_id(spark, sf):
    rows = EV.evidence_rows(findings(spark, sf)).select(*EV.KEY, "source_record_id", "severity")
    return EV.resolve_by_id(refs(spark, sf).select("evidence_id"), rows)


def report_events(spark, sf, flag: str, kind: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    return li.select(
        F.col("l_partkey").alias("frame"), F.lit(kind).alias("kind"), F.concat(F.lit("out/"), F.col("l_orderkey").cast("string")).alias("evidence_path")
    )


@fam.add(
    "io_event_report",
    """SELECT '- Frame ' || l_partkey || ' — ' || CASE l_returnflag WHEN 'R' THEN 'fall' ELSE 'bile duct' END || ' — evidence: `out/' || l_orderkey || '`' AS line
    FROM lineitem WHERE l_returnflag IN ('R', 'A')""",
)
def _report(spark, sf):
    return EV.event_report(report_events(spark, sf, "R", "fall"), report_events(spark, sf, "A", "bile duct"))


@fam.add("io_event_report_empty", "SELECT 'No event detected.' AS line FROM lineitem HAVING count(*) FILTER (l_returnflag = 'X') = 0")
def _report_none(spark, sf):
    return EV.event_report(report_events(spark, sf, "X", "fall"), report_events(spark, sf, "X", "bile duct"))


def folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@fam.add(
    "io_write_evidence",
    """SELECT CASE WHEN l_returnflag = 'A' THEN 'vitals' ELSE 'video' END AS feature, 'run-' || (l_suppkey % 7) AS run_id, 'e' || l_partkey AS evidence_id,
    l_orderkey::VARCHAR AS source_record_id, CASE WHEN l_linenumber < 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY feature, run_id, evidence_id
      ORDER BY l_linenumber >= 3 DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)
def _write_evidence(spark, sf):
    path = folder(spark, "evidence")
    early = findings(spark, sf).filter("seq.l_linenumber < 3")  # a first write, which the second must extend
    EV.write_evidence(EV.evidence_rows(early), path)
    rest = findings(spark, sf).filter("seq.l_linenumber >= 3")
    EV.write_evidence(EV.evidence_rows(rest), path)
    schema = "evidence_id string, source_record_id string, severity string, feature string, run_id string"
    return spark.read.schema(schema).json(path).select("feature", "run_id", "evidence_id", "source_record_id", "severity")


@fam.add(
    "io_evidence_log",
    """SELECT CASE WHEN l_returnflag = 'A' THEN 'vitals' ELSE 'video' END AS feature, 'run-' || (l_suppkey % 7) AS run_id, 'e' || l_partkey AS evidence_id,
    l_orderkey::VARCHAR AS source_record_id, CASE WHEN l_linenumber < 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 5 THEN 2 ELSE 3 END AS commit_no FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY feature, run_id, evidence_id ORDER BY l_linenumber >= 5 DESC, l_linenumber >= 3 DESC,
      l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)
def _evidence_log(spark, sf):
    """All findings in three commits, the first two made one before the third."""
    path = folder(spark, "evidence-log")
    n = F.col("seq.l_linenumber")
    for at, part in enumerate([n < 3, (n >= 3) & (n < 5), n >= 5]):
        LOG.append_evidence(EV.evidence_rows(findings(spark, sf).filter(part)), path)
        if at == 1:
            LOG.compact_evidence(spark, path)
    return LOG.read_evidence(spark, path).select("feature", "run_id", "evidence_id", "source_record_id", "severity", F.col("commit_no").cast("int").alias("commit_no"))


@fam.add("io_write_metrics", stmt(f"SELECT detector, {QQ.PRF.format(z='', e='')} FROM confusion", "confusion"))
def _write_metrics(spark, sf):
    path = folder(spark, "metrics")
    EV.write_metrics(Q.binary_metrics(V.binary(spark, sf), "y_true", "y_pred", ["detector"]), path)
    schema = "tp long, fp long, fn long, precision double, recall double, support long, f1 double, detector string"
    return QQ.rounded(spark.read.schema(schema).json(path), "detector")


@fam.add("io_write_transitions", stmt("SELECT patient_id, t, previous_level, level, n_parts::INTEGER AS n_events FROM moves", "moves"))
def _write_transitions(spark, sf):
    path = folder(spark, "transitions")
    EV.write_transitions(FU.transitions(FQ.levelled(spark, sf)), path)
    schema = "patient_id string, t double, previous_level string, level string, events array<struct<modality:string,evidence_id:string>>"
    return spark.read.schema(schema).json(path).select("patient_id", "t", "previous_level", "level", F.size("events").alias("n_events"))
