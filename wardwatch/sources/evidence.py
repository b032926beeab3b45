"""Evidence, metric and transition sinks, and resolution of evidence references."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch.functions.guards import dbl
from wardwatch.plans.materialise import written as materialised

DEFAULTS = {
    "modality": "",
    "event_type": "",
    "severity": "MEDIUM",
    "confidence": 0.0,
    "ts": "",
    "patient_id": "",
    "status": "positive",
}
KEY = ["feature", "run_id", "evidence_id"]


def evidence_rows(findings: DataFrame, written: str = "seq", root: str = "output") -> DataFrame:
    """Complete evidence rows, one per (feature, run, id): the last written wins."""
    full = findings
    for name, value in DEFAULTS.items():
        lit = dbl(value) if isinstance(value, float) else F.lit(value)
        full = full.withColumn(name, F.coalesce(F.col(name), lit) if name in findings.columns else lit)
    body = [c for c in full.columns if c not in (*KEY, written)]
    last = full.groupBy(*KEY).agg(F.max_by(F.struct(*body), written).alias("_b")).select(*KEY, "_b.*")
    path = F.concat(F.lit(root), F.lit("/"), F.concat_ws("/", *KEY), F.lit(".json"))
    return last.withColumn("path", path)


def write_evidence(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Partitioned by feature and run. An id written again replaces the same id of its
    run; other ids of the run, and all other runs, stay. A run has one writer at a time."""
    old = stored_evidence(rows, path, fmt)
    if old is not None:
        runs = rows.select("feature", "run_id").distinct()
        rest = old.join(runs, ["feature", "run_id"], "left_semi").join(rows.select(*KEY), KEY, "left_anti")
        # written aside first: the folders that are read are overwritten next
        rows = materialised(rows.unionByName(rest, allowMissingColumns=True))
    (
        rows.hint("rebalance", "feature", "run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("feature", "run_id")
        .format(fmt)
        .save(path)
    )


def stored_evidence(rows: DataFrame, path: str, fmt: str) -> DataFrame | None:
    """What ``path`` holds, in the types of ``rows``; None where nothing is written yet."""
    reader = rows.sparkSession.read.format(fmt)
    try:
        found = reader.load(path).schema
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if "evidence_id" not in found.names:
        return None
    known = {f.name: f for f in rows.schema}
    return reader.schema(T.StructType([known.get(f.name, f) for f in found])).load(path)


def resolve_evidence(refs: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References that resolve, with the evidence columns, and those that do not."""
    return refs.join(evidence, KEY), refs.join(evidence.select(*KEY), KEY, "left_anti")


def resolve_by_id(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """References by id alone take the first path in sort order."""
    body = [c for c in evidence.columns if c != "evidence_id"]
    first = evidence.groupBy("evidence_id").agg(F.min_by(F.struct(*body), F.concat_ws("/", "feature", "run_id")).alias("_b"))
    return refs.join(first, "evidence_id").select(*refs.columns, "_b.*")


def write_metrics(metrics: DataFrame, path: str, by: str = "detector") -> None:
    metrics.write.mode("overwrite").partitionBy(by).json(path)


def write_transitions(transitions: DataFrame, path: str) -> None:
    """Nested transition log; no transitions still give a readable, empty log."""
    transitions.write.mode("overwrite").json(path)


def event_report(pose_events: DataFrame, object_events: DataFrame) -> DataFrame:
    """Both event lists ``(frame, kind, evidence_path)`` as report lines; one line that
    says so when there is no event at all."""
    both = pose_events.unionByName(object_events)
    lines = both.select(
        F.concat(
            F.lit("- Frame "), F.col("frame").cast("string"), F.lit(" — "), F.col("kind"), F.lit(" — evidence: `"), F.col("evidence_path"), F.lit("`")
        ).alias("line")
    )
    none = both.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit("No event detected.").alias("line"))
    return lines.unionByName(none)
