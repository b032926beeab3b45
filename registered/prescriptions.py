"""Prescription rules on orders, line items and part types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.functions.tables import literal_table
from wardwatch.operators import prescriptions as RX
from wardwatch.plans.materialise import written

fam = Family()
KEY = ["patient_id", "drug", "ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEYSQL = ", ".join(KEY)
ORD = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, dose, l_extendedprice"


def catalog(spark: SparkSession) -> DataFrame:
    return literal_table(spark, V.BRIDGE_CATALOG, RX.CATALOG_SCHEMA)


def with_prev(spark, sf, any_drug: bool = True) -> DataFrame:
    rx = V.prescriptions(spark, sf)
    return RX.previous_any_drug(rx, V.RX_ORDER) if any_drug else RX.previous_same_drug(written(rx, clean=True), V.RX_ORDER)


def evaluated(spark, sf) -> DataFrame:
    return RX.evaluate_prescriptions(with_prev(spark, sf), catalog(spark))


cte(
    "rx",
    f"""SELECT p.*, c.min_dose AS lo, c.max_dose AS hi, c.c_unit, c.active_ingredient, c.control_category, c.is_controlled, c.source, c.criticality AS crit
    FROM prescriptions p LEFT JOIN catalog c ON c.name = p.drug""",
    "prescriptions",
    "catalog",
)
cte(
    "rx_any",
    f"""SELECT r.*, c.criticality AS pcrit FROM (SELECT *, lag(drug) OVER w AS pdrug, lag(dose) OVER w AS pdose, lag(unit) OVER w AS punit
      FROM rx WINDOW w AS (PARTITION BY patient_id ORDER BY {ORD})) r LEFT JOIN catalog c ON c.name = r.pdrug""",
    "rx",
)
cte(
    "rx_same",
    f"SELECT *, drug AS pdrug0, lag(dose) OVER w AS pdose, lag(unit) OVER w AS punit FROM rx WINDOW w AS (PARTITION BY patient_id, drug ORDER BY {ORD})",
    "rx",
)
DOSE_KIND = "CASE WHEN lo IS NULL THEN 'no_reference' WHEN dose < lo OR dose > hi THEN 'dose_out_of_range' ELSE 'normal' END"
DOSE_WHY = """CASE WHEN lo IS NULL THEN 'drug ''' || drug || ''' is not in the catalog' WHEN dose < lo OR dose > hi THEN
    'dose ' || dose || unit || ' outside range [' || lo || ', ' || hi || ']' || c_unit ELSE 'dose within the therapeutic range' END"""
SUB_KIND = """CASE WHEN pdrug IS NULL OR pdrug = drug THEN 'normal' WHEN lo IS NULL THEN 'no_reference'
    WHEN crit - coalesce(pcrit, 0) >= 2 THEN 'critical_substitution' ELSE 'normal' END"""
CAP = "upper({0}[1]) || {0}[2:]"
SUB_WHY = f"""CASE WHEN pdrug IS NULL THEN 'no earlier prescription' WHEN pdrug = drug THEN 'same drug, no substitution'
    WHEN lo IS NULL THEN 'current drug ''' || drug || ''' is not in the catalog'
    WHEN crit - coalesce(pcrit, 0) >= 2 THEN 'Critical escalation: ''' || {CAP.format('pdrug')} || ''' (' ||
      CASE WHEN coalesce(pcrit, 0) > 0 THEN 'level ' || pcrit ELSE 'unknown' END || ') replaced by ''' || {CAP.format('drug')} || ''' (level ' || crit ||
      CASE WHEN crit >= 3 THEN ' - high alert' ELSE '' END || ').' ELSE 'substitution as expected' END"""


def abrupt(kind: bool, other: str = "pdrug <> drug") -> str:
    pick = (lambda k, why: f"'{k}'") if kind else (lambda k, why: why)
    change = """'change of ' || printf('%.0f', abs(dose - pdose) / pdose * 100) || '% from the previous dose (' || pdose || punit || ' -> ' ||
      dose || unit || ')' || CASE WHEN dose > hi THEN ' (above range)' WHEN dose < lo THEN ' (below range)' ELSE '' END"""
    return f"""CASE WHEN pdose IS NULL THEN {pick('normal', "'no earlier prescription'")}
      WHEN {other} THEN {pick('normal', "'different drugs, dose change not comparable'")}
      WHEN dose >= lo AND dose <= hi AND (pdose < lo OR pdose > hi) THEN {pick('normal', "'dose corrected into the therapeutic range'")}
      WHEN pdose = 0 THEN {pick('no_reference', "'previous dose is zero'")}
      WHEN abs(dose - pdose) / pdose > 0.5 THEN {pick('abrupt_change', change)}
      ELSE {pick('normal', "'change as expected'")} END"""


cte(
    "rx_rules",
    f"""SELECT *, {DOSE_KIND} AS k1, {DOSE_WHY} AS w1, {SUB_KIND} AS k2, {SUB_WHY} AS w2, {abrupt(True)} AS k3, {abrupt(False)} AS w3 FROM rx_any""",
    "rx_any",
)


@fam.add("rx_catalog_lookup", stmt(f"SELECT {KEYSQL}, lo AS min_dose, hi AS max_dose, crit AS criticality FROM rx", "rx"))
def _lookup(spark, sf):
    out = RX.catalog_lookup(V.prescriptions(spark, sf), catalog(spark))
    return out.select(*KEY, "range.min_dose", "range.max_dose", "range.criticality")


@fam.add(
    "rx_all_drugs",
    stmt("SELECT name, count(patient_id) AS n FROM catalog LEFT JOIN prescriptions ON drug = name GROUP BY name", "catalog", "prescriptions"),
)
def _all(spark, sf):
    names = RX.all_drugs(catalog(spark))
    uses = V.prescriptions(spark, sf).groupBy(F.lower("drug").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(uses, "name", "left").fillna(0, ["n"])


@fam.add(
    "rx_controlled_substances",
    stmt(
        "SELECT name, count(patient_id) AS n FROM catalog LEFT JOIN prescriptions ON drug = name WHERE is_controlled GROUP BY name",
        "catalog",
        "prescriptions",
    ),
)
def _controlled(spark, sf):
    names = RX.controlled_substances(catalog(spark))
    uses = V.prescriptions(spark, sf).groupBy(F.lower("drug").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(uses, "name", "left").fillna(0, ["n"])


@fam.add("rx_dose_range_check", stmt(f"SELECT {KEYSQL}, {DOSE_KIND} AS kind, {DOSE_WHY} AS reason FROM rx", "rx"))
def _dose(spark, sf):
    out = RX.catalog_lookup(V.prescriptions(spark, sf), catalog(spark)).withColumn("r", RX.dose_range_check())
    return out.select(*KEY, "r.kind", "r.reason")


@fam.add("rx_previous_same_drug", stmt(f"SELECT {KEYSQL}, pdose AS prev_dose FROM rx_same", "rx_same"))
def _same(spark, sf):
    return with_prev(spark, sf, False).select(*KEY, F.col("prev.dose").alias("prev_dose"))


@fam.add("rx_previous_any_drug", stmt(f"SELECT {KEYSQL}, pdrug AS prev_drug, pdose AS prev_dose FROM rx_any", "rx_any"))
def _any(spark, sf):
    return with_prev(spark, sf).select(*KEY, F.col("prev.drug").alias("prev_drug"), F.col("prev.dose").alias("prev_dose"))


@fam.add(
    "rx_abrupt_change_check",
    stmt(f"SELECT {KEYSQL}, {abrupt(True, 'false')} AS kind, {abrupt(False, 'false')} AS reason FROM rx_same", "rx_same"),
)
def _abrupt(spark, sf):
    out = RX.catalog_lookup(with_prev(spark, sf, False), catalog(spark)).withColumn("r", RX.abrupt_change_check())
    return out.select(*KEY, "r.kind", "r.reason")


@fam.add("rx_critical_substitution_check", stmt(f"SELECT {KEYSQL}, k2 AS kind, w2 AS reason FROM rx_rules", "rx_rules"))
def _sub(spark, sf):
    c = catalog(spark)
    out = RX.catalog_lookup(with_prev(spark, sf), c)
    out = RX.catalog_lookup(out, c, F.col("prev.drug"), "prev_range").withColumn("r", RX.critical_substitution_check())
    return out.select(*KEY, "r.kind", "r.reason")


@fam.add(
    "rx_evaluate_prescriptions",
    stmt(
        f"""SELECT {KEYSQL}, 'dose_range' AS rule, k1 AS kind, w1 AS reason FROM rx_rules UNION ALL
        SELECT {KEYSQL}, 'substitution', k2, w2 FROM rx_rules UNION ALL SELECT {KEYSQL}, 'abrupt_change', k3, w3 FROM rx_rules""",
        "rx_rules",
    ),
)
def _eval(spark, sf):
    return RX.rule_rows(evaluated(spark, sf), *KEY)


@fam.add(
    "rx_regulatory_info",
    stmt(
        f"""SELECT {KEYSQL}, coalesce(active_ingredient, '') AS active_ingredient, coalesce(control_category, '') AS control_category,
        coalesce(is_controlled, false) AS is_controlled, coalesce(lo || '–' || hi || ' ' || c_unit, '') AS reference_dose,
        coalesce(source, 'not verified') AS source, crit AS criticality FROM rx""",
        "rx",
    ),
)
def _reg(spark, sf):
    return RX.regulatory_info(V.prescriptions(spark, sf), catalog(spark)).drop("dose", "unit")


@fam.add(
    "rx_severity",
    stmt(
        f"""SELECT {KEYSQL}, CASE WHEN k1 = 'dose_out_of_range' THEN CASE WHEN crit >= 3 THEN 'CRITICAL' ELSE 'HIGH' END
        WHEN k2 = 'critical_substitution' THEN 'HIGH' ELSE 'MEDIUM' END AS severity
        FROM rx_rules WHERE k1 <> 'normal' OR k2 <> 'normal' OR k3 <> 'normal'""",
        "rx_rules",
    ),
)
def _severity(spark, sf):
    ev = evaluated(spark, sf).withColumn("_a", RX.anomalies(F.col("results"))).filter(F.size("_a") > 0)
    return ev.select(*KEY, RX.rx_severity(F.col("_a.kind"), F.col("range.criticality")).alias("severity"))


@fam.add("rx_evidence_id", stmt(f"SELECT {KEYSQL}, patient_id || '-' || drug || '-' || replace(ts || 'T08:00:00', ':', '-') AS evidence_id FROM rx", "rx"))
def _evid(spark, sf):
    at = F.concat(F.col("ts"), F.lit("T08:00:00"))
    return V.prescriptions(spark, sf).select(*KEY, RX.rx_evidence_id(F.col("patient_id"), F.col("drug"), at).alias("evidence_id"))


TRUTH = """SELECT patient_id, drug, ts, CASE WHEN max(dose) > 35 THEN 'dose_out_of_range' WHEN min(l_linenumber) = 1 THEN 'abrupt_change'
    ELSE 'normal' END AS anomaly_type FROM rx GROUP BY 1, 2, 3"""
cte("rx_truth", TRUTH, "rx")
cte(
    "rx_judged",
    f"""SELECT anomaly_type, {DOSE_KIND} AS kd, CASE WHEN pdose IS NOT NULL THEN CASE WHEN abs(dose - pdose) / pdose > 0.5 THEN 'abrupt_change' ELSE 'normal' END END AS ka
    FROM (SELECT * FROM (SELECT s.*, last_value(dose) OVER (PARTITION BY patient_id, drug, ts ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS win FROM rx_same s)
      WHERE dose = win QUALIFY row_number() OVER (PARTITION BY patient_id, drug, ts ORDER BY {ORD}) = 1)
    JOIN rx_truth USING (patient_id, drug, ts)""",
    "rx_same",
    "rx_truth",
)


@fam.add(
    "rx_evaluate",
    stmt(
        """SELECT *, tp + fn AS support, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
          round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (
        SELECT detector, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (
          SELECT 'dose_out_of_range' AS detector, anomaly_type = 'dose_out_of_range' AS t, kd = 'dose_out_of_range' AS p FROM rx_judged WHERE kd <> 'no_reference'
          UNION ALL SELECT 'abrupt_change', anomaly_type = 'abrupt_change', ka = 'abrupt_change' FROM rx_judged WHERE ka IS NOT NULL) GROUP BY 1)""",
        "rx_judged",
    ),
)
def _evaluate(spark, sf):
    rx = written(V.prescriptions(spark, sf), clean=True)  # truth and records both read it
    truth = rx.groupBy("patient_id", "drug", "ts").agg(
        F.when(F.max("dose") > 35, "dose_out_of_range")
        .when(F.min("l_linenumber") == 1, "abrupt_change")
        .otherwise("normal")
        .alias("anomaly_type")
    )
    out = RX.rx_evaluate(truth, rx, catalog(spark), V.RX_ORDER)
    return out.select("detector", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]])


@fam.add(
    "rx_summary",
    stmt(
        f"""SELECT {KEYSQL}, {CAP.format('drug')} || ' ' || printf('%g', dose) || ' ' || unit || ' — ' || CASE WHEN k1 = 'normal' AND k2 = 'normal' AND k3 = 'normal'
          THEN 'no relevant change.' ELSE concat_ws('; ', CASE WHEN k1 <> 'normal' THEN w1 END, CASE WHEN k2 <> 'normal' THEN w2 END, CASE WHEN k3 <> 'normal' THEN w3 END) || '.' END AS summary,
        CASE WHEN k1 = 'normal' AND k2 = 'normal' AND k3 = 'normal' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM rx_rules""",
        "rx_rules",
    ),
)
def _summary(spark, sf):
    return RX.rx_summary(evaluated(spark, sf)).select(*KEY, "summary", "score")
