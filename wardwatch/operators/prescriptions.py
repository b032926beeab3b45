"""Prescription rules over ``(patient_id, drug, dose, unit, ts, …)`` and a catalog.

The catalog is a DataFrame argument; joins to it are plain equi joins that the
optimizer broadcasts while it is small. The earlier prescription comes from a
lag over sampled ranges, so a patient with very many rows spreads over many tasks;
that of the same drug from a lag by key, with ranges for the longest keys alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl
from wardwatch.functions.tables import literal_table
from wardwatch.functions.text import capitalized, fixed, replace_chars
from wardwatch.operators.quality import binary_metrics
from wardwatch.plans.ordered import previous_by_key, previous_in_ranges

ABRUPT_THRESHOLD = 0.5

CATALOG_SCHEMA = (
    "name string, min_dose double, max_dose double, unit string, active_ingredient string, "
    "control_category string, is_controlled boolean, source string, criticality int"
)
_BOOK = "ANVISA — Bulário Eletrônico"
_LISTS = "ANVISA — Listas de Controlo Especial (Port. 344/98)"

# Usual adult dose range, unit, active ingredient, control category and
# criticality of each catalogued drug.
_DRUGS = [
    ("paracetamol", 500.0, 1000.0, "mg", "paracetamol", "", 1),
    ("ibuprofeno", 200.0, 800.0, "mg", "ibuprofeno", "", 1),
    ("dipirona", 500.0, 1000.0, "mg", "dipirona sódica", "", 1),
    ("amoxicilina", 250.0, 875.0, "mg", "amoxicilina", "", 1),
    ("losartana", 25.0, 100.0, "mg", "losartana potássica", "", 1),
    ("metformina", 500.0, 2000.0, "mg", "cloridrato de metformina", "", 1),
    ("omeprazol", 20.0, 40.0, "mg", "omeprazol", "", 1),
    ("enalapril", 5.0, 40.0, "mg", "maleato de enalapril", "", 1),
    ("sinvastatina", 10.0, 80.0, "mg", "sinvastatina", "", 1),
    ("furosemida", 20.0, 80.0, "mg", "furosemida", "", 1),
    ("prednisona", 5.0, 60.0, "mg", "prednisona", "", 1),
    ("azitromicina", 250.0, 500.0, "mg", "azitromicina", "", 1),
    ("cetoprofeno", 50.0, 200.0, "mg", "cetoprofeno", "", 1),
    ("varfarina", 1.0, 10.0, "mg", "varfarina sódica", "", 2),
    ("insulina", 1.0, 100.0, "UI", "insulina humana", "", 2),
    ("digoxina", 0.125, 0.5, "mg", "digoxina", "", 2),
    ("morfina", 10.0, 60.0, "mg", "sulfato de morfina", "A1", 3),
    ("fentanil", 0.012, 0.1, "mg/h", "citrato de fentanila", "A1", 3),
    ("metadona", 5.0, 40.0, "mg", "cloridrato de metadona", "A1", 3),
    ("codeína", 30.0, 120.0, "mg", "fosfato de codeína", "A2", 2),
    ("tramadol", 50.0, 400.0, "mg", "cloridrato de tramadol", "A2", 2),
    ("diazepam", 5.0, 20.0, "mg", "diazepam", "B1", 2),
    ("clonazepam", 0.5, 4.0, "mg", "clonazepam", "B1", 2),
    ("alprazolam", 0.5, 4.0, "mg", "alprazolam", "B1", 2),
    ("midazolam", 7.5, 15.0, "mg", "midazolam", "B1", 2),
    ("metilfenidato", 10.0, 60.0, "mg", "cloridrato de metilfenidato", "B1", 2),
    ("fluoxetina", 20.0, 60.0, "mg", "cloridrato de fluoxetina", "C1", 2),
    ("sertralina", 50.0, 200.0, "mg", "cloridrato de sertralina", "C1", 2),
    ("carbamazepina", 200.0, 1200.0, "mg", "carbamazepina", "C1", 2),
    ("haloperidol", 1.0, 15.0, "mg", "haloperidol", "C1", 2),
    ("risperidona", 1.0, 6.0, "mg", "risperidona", "C1", 2),
]


def default_catalog(spark: SparkSession) -> DataFrame:
    rows = [(n, lo, hi, u, a, c, c != "", _LISTS if c else _BOOK, k) for n, lo, hi, u, a, c, k in _DRUGS]
    return literal_table(spark, rows, CATALOG_SCHEMA)


def catalog_lookup(rx: DataFrame, catalog: DataFrame, drug: Column | None = None, name: str = "range") -> DataFrame:
    """Adds the catalog row as struct ``name``; NULL when the drug is not listed."""
    key = F.lower(drug if drug is not None else F.col("drug"))
    entry = catalog.select(F.lower("name").alias("_key"), F.struct(*catalog.columns).alias(name))
    return rx.join(entry, key == F.col("_key"), "left").drop("_key")


def all_drugs(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.lower("name").alias("name")).orderBy("name")


def controlled_substances(catalog: DataFrame) -> DataFrame:
    return all_drugs(catalog.filter("is_controlled"))


def previous_same_drug(rx: DataFrame, order: Sequence[str], place: str | None = None) -> DataFrame:
    """Adds ``prev(drug, dose, unit)``: the patient's earlier row of this drug; ``place`` as
    in ``previous_by_key``, which reads ``rx`` more than once."""
    return previous_by_key(rx, ["patient_id", "drug"], order, ["drug", "dose", "unit"], place=place)


def previous_any_drug(rx: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Adds ``prev(drug, dose, unit)``: the patient's earlier row of any drug."""
    return previous_in_ranges(rx, ["patient_id"], order, ["drug", "dose", "unit"], parts=parts)


def _result(kind: str, *reason: Column | str) -> Column:
    parts = [F.lit(r) if isinstance(r, str) else r for r in reason]
    return F.struct(F.lit(kind).alias("kind"), F.concat(*parts).alias("reason"))


def _num(c: Column) -> Column:
    return c.cast("string")


def dose_range_check(rng: str = "range") -> Column:
    """Struct (kind, reason) for the dose against the catalog range, bounds allowed."""
    lo, hi, dose = F.col(f"{rng}.min_dose"), F.col(f"{rng}.max_dose"), F.col("dose")
    return (
        F.when(F.col(rng).isNull(), _result("no_reference", "drug '", F.col("drug"), "' is not in the catalog"))
        .when(
            (dose < lo) | (dose > hi),
            _result(
                "dose_out_of_range",
                "dose ", _num(dose), F.col("unit"), " outside range [", _num(lo), ", ", _num(hi), "]", F.col(f"{rng}.unit"),
            ),
        )
        .otherwise(_result("normal", "dose within the therapeutic range"))
    )


def abrupt_change_check(threshold: float = ABRUPT_THRESHOLD, rng: str | None = "range", prev: str = "prev") -> Column:
    """Struct (kind, reason) for the dose against the previous dose of the same drug.

    ``rng`` None ignores the therapeutic range, as the offline evaluation does.
    """
    dose, before = F.col("dose"), F.col(f"{prev}.dose")
    change = F.try_divide(F.abs(dose - before), before)
    if rng is None:
        lo = hi = F.lit(None).cast("double")
    else:
        lo, hi = F.col(f"{rng}.min_dose"), F.col(f"{rng}.max_dose")
    inside = lambda d: F.coalesce((d >= lo) & (d <= hi), F.lit(False))
    outside = F.coalesce((before < lo) | (before > hi), F.lit(False))
    side = F.when(dose > hi, " (above range)").when(dose < lo, " (below range)").otherwise("")
    return (
        F.when(F.col(prev).isNull(), _result("normal", "no earlier prescription"))
        .when(
            F.lower("drug") != F.lower(F.col(f"{prev}.drug")),
            _result("normal", "different drugs, dose change not comparable"),
        )
        .when(inside(dose) & outside, _result("normal", "dose corrected into the therapeutic range"))
        .when(change.isNull(), _result("no_reference", "previous dose is zero"))
        .when(
            change > dbl(threshold),
            _result(
                "abrupt_change",
                "change of ", fixed(change * dbl(100), 0), "% from the previous dose (",
                _num(before), F.col(f"{prev}.unit"), " -> ", _num(dose), F.col("unit"), ")", side,
            ),
        )
        .otherwise(_result("normal", "change as expected"))
    )


def critical_substitution_check(rng: str = "range", prev: str = "prev", prev_rng: str = "prev_range") -> Column:
    """Struct (kind, reason): a switch to a drug at least two criticality levels up."""
    now, before = F.col(f"{rng}.criticality"), F.coalesce(F.col(f"{prev_rng}.criticality"), F.lit(0))
    was = F.when(before > 0, F.concat(F.lit("level "), before.cast("string"))).otherwise("unknown")
    tail = F.when(now >= 3, " - high alert").otherwise("")
    return (
        F.when(F.col(prev).isNull(), _result("normal", "no earlier prescription"))
        .when(F.lower("drug") == F.lower(F.col(f"{prev}.drug")), _result("normal", "same drug, no substitution"))
        .when(F.col(rng).isNull(), _result("no_reference", "current drug '", F.col("drug"), "' is not in the catalog"))
        .when(
            now - before >= 2,
            _result(
                "critical_substitution",
                "Critical escalation: '", capitalized(F.col(f"{prev}.drug")), "' (", was, ") replaced by '",
                capitalized(F.col("drug")), "' (level ", now.cast("string"), tail, ").",
            ),
        )
        .otherwise(_result("normal", "substitution as expected"))
    )


def evaluate_prescriptions(rx_prev: DataFrame, catalog: DataFrame, threshold: float = ABRUPT_THRESHOLD) -> DataFrame:
    """Rows with ``prev`` gain ``range``, ``prev_range`` and ``results``: the three
    rule outcomes in order of severity."""
    joined = catalog_lookup(rx_prev, catalog)
    joined = catalog_lookup(joined, catalog, F.col("prev.drug"), "prev_range")
    rules = {
        "dose_range": dose_range_check(),
        "substitution": critical_substitution_check(),
        "abrupt_change": abrupt_change_check(threshold),
    }
    results = [
        F.struct(F.lit(name).alias("rule"), r["kind"].alias("kind"), r["reason"].alias("reason")) for name, r in rules.items()
    ]
    return joined.withColumn("results", F.array(*results))


def anomalies(results: Column) -> Column:
    return F.filter(results, lambda r: r["kind"] != "normal")


def rule_rows(evaluated: DataFrame, *keep: str) -> DataFrame:
    """One row per rule. The outer form, as before the inner one Spark filters by the size
    of ``results`` and so works out every reason once more."""
    return evaluated.select(*keep, F.inline_outer("results")).filter("rule is not null")


def regulatory_info(rx: DataFrame, catalog: DataFrame) -> DataFrame:
    r = catalog_lookup(rx, catalog)
    reference = F.concat(
        _num(F.col("range.min_dose")), F.lit("–"), _num(F.col("range.max_dose")), F.lit(" "), F.col("range.unit")
    )
    source = F.when(F.col("range.source") != "", F.col("range.source"))
    return r.select(
        *rx.columns,
        F.coalesce("range.active_ingredient", F.lit("")).alias("active_ingredient"),
        F.coalesce("range.control_category", F.lit("")).alias("control_category"),
        F.coalesce("range.is_controlled", F.lit(False)).alias("is_controlled"),
        F.coalesce(reference, F.lit("")).alias("reference_dose"),
        F.coalesce(source, F.lit("not verified")).alias("source"),
        F.col("range.criticality").alias("criticality"),
    )


def rx_severity(kinds: Column, criticality: Column) -> Column:
    return (
        F.when(F.array_contains(kinds, "dose_out_of_range"), F.when(criticality >= 3, "CRITICAL").otherwise("HIGH"))
        .when(F.array_contains(kinds, "critical_substitution"), "HIGH")
        .otherwise("MEDIUM")
    )


def rx_evidence_id(patient: Column, drug: Column, ts: Column) -> Column:
    return replace_chars(F.concat_ws("-", patient, drug, ts), ":", "-")


def _short(dose: Column) -> Column:
    return F.regexp_replace(fixed(dose, 6), r"\.?0+$", "")


def rx_summary(evaluated: DataFrame) -> DataFrame:
    """Adds ``summary`` and ``score``: 1 with any anomaly, else 0."""
    found = anomalies(F.col("results"))
    head = F.concat(capitalized(F.col("drug")), F.lit(" "), _short(F.col("dose")), F.lit(" "), F.col("unit"), F.lit(" — "))
    why = F.concat(F.array_join(F.transform(found, lambda r: r["reason"]), "; "), F.lit("."))
    any_found = F.size(found) > 0
    return evaluated.withColumns(
        {
            "summary": F.concat(head, F.when(any_found, why).otherwise("no relevant change.")),
            "score": F.when(any_found, dbl(1)).otherwise(dbl(0)),
        }
    )


def unreadable_summary(rejects: DataFrame) -> DataFrame:
    """The result row of documents that could not be parsed: no score."""
    return rejects.select(
        "doc_id", F.lit("The document could not be read.").alias("summary"), F.lit(None).cast("double").alias("score")
    )


def rx_evaluate(truth: DataFrame, rx: DataFrame, catalog: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rule quality against labelled prescriptions ``(patient_id, drug, ts, anomaly_type)``.

    Of several records with one key the last arrival counts, at the place of its
    first equal copy. Doses without reference, and changes without an earlier
    record, are left out. ``rx`` is read more than once. An arrival is a number, not the
    columns of the order, and copies meet where the row before was found.
    """
    value = F.struct("dose", "unit")
    placed = previous_same_drug(rx, order, place="_a").select(
        "patient_id", "drug", "ts", value.alias("_v"), "_a", F.struct("prev").alias("_p")
    )
    copies = placed.groupBy("patient_id", "drug", "ts", "_v").agg(
        F.min_by("_p", "_a").alias("_p"), F.max("_a").alias("_a")
    )
    chosen = copies.groupBy("patient_id", "drug", "ts").agg(F.max_by(F.struct("_v", "_p"), "_a").alias("_w"))
    rows = chosen.select(
        "patient_id", "drug", "ts", F.col("_w._v.dose").alias("dose"), F.col("_w._v.unit").alias("unit"), F.col("_w._p.prev").alias("prev")
    )
    judged = catalog_lookup(truth.join(rows, ["patient_id", "drug", "ts"]), catalog).select(
        "anomaly_type",
        dose_range_check()["kind"].alias("_dose"),
        F.when(F.col("prev").isNotNull(), abrupt_change_check(rng=None)["kind"]).alias("_abrupt"),
    )
    kinds = F.array(
        F.when(F.col("_dose") != "no_reference", F.struct(F.lit("dose_out_of_range").alias("detector"), F.col("_dose").alias("kind"))),
        F.when(F.col("_abrupt").isNotNull(), F.struct(F.lit("abrupt_change").alias("detector"), F.col("_abrupt").alias("kind"))),
    )
    flat = judged.select("anomaly_type", F.inline(F.array_compact(kinds)))
    return binary_metrics(flat, F.col("anomaly_type") == F.col("detector"), F.col("kind") == F.col("detector"), ["detector"])
