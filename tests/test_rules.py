"""Prescription rules, document parsing, sources and sinks on hand-made rows."""

import json
import random
from functools import partial

from pyspark.sql import functions as F

from wardwatch.operators import prescriptions as RX
from wardwatch.plans import ordered as O
from wardwatch.sources import documents, evidence, images, recordings, signals

RXROW = "patient_id string, drug string, dose double, unit string, ts string"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, f"2024-01-{i + 1:02d}") for i, r in enumerate(rows)], RXROW)
    prev = RX.previous_any_drug(df, ["ts"], parts=3)
    out = RX.evaluate_prescriptions(prev, RX.default_catalog(spark)).orderBy("ts")
    return [{x.rule: x.kind for x in r.results} for r in out.collect()]


def test_catalog_has_31_drugs(spark):
    c = RX.default_catalog(spark)
    assert c.count() == 31 and RX.controlled_substances(c).count() == 15


def test_dose_bounds_are_inclusive(spark):
    got = judged(spark, [("a", "paracetamol", d, "mg") for d in (500.0, 1000.0, 100.0, 5000.0)] + [("a", "Zzz", 1.0, "mg")])
    assert [g["dose_range"] for g in got] == ["normal", "normal", "dose_out_of_range", "dose_out_of_range", "no_reference"]


def test_abrupt_is_more_than_half(spark):
    assert judged(spark, [("a", "x", 400.0, "mg"), ("a", "X", 600.0, "mg")])[1]["abrupt_change"] == "normal"
    assert judged(spark, [("a", "x", 400.0, "mg"), ("a", "x", 601.0, "mg")])[1]["abrupt_change"] == "abrupt_change"
    assert judged(spark, [("a", "morfina", 350.0, "mg"), ("a", "morfina", 35.0, "mg")])[1]["abrupt_change"] == "normal"
    assert judged(spark, [("a", "losartana", 50.0, "mg"), ("a", "losartana", 100.0, "mg")])[1]["abrupt_change"] == "abrupt_change"


def test_substitution_by_criticality(spark):
    assert judged(spark, [("a", "dipirona", 500.0, "mg"), ("a", "morfina", 10.0, "mg")])[1]["substitution"] == "critical_substitution"
    assert judged(spark, [("a", "tramadol", 50.0, "mg"), ("a", "morfina", 10.0, "mg")])[1]["substitution"] == "normal"
    assert judged(spark, [("a", "unknown", 50.0, "mg"), ("a", "tramadol", 50.0, "mg")])[1]["substitution"] == "critical_substitution"


def evaluated_by_loop(truth, rows, catalog):
    """Counts (tp, fp, fn) of both detectors; rows (patient, drug, dose, unit, ts, seq)."""
    last, counts = {}, {"dose_out_of_range": [0, 0, 0], "abrupt_change": [0, 0, 0]}
    before, prev = {}, {}
    for r in sorted(rows, key=lambda r: r[4:]):
        prev[r] = before.get(r[:2])
        before[r[:2]] = last[r[0], r[1], r[4]] = r
    for key, kind in truth.items():
        r = min((x for x in rows if (x[0], x[1], x[4]) == key and x[2:4] == last[key][2:4]), key=lambda r: r[5])
        found = {}
        if r[1] in catalog:
            found["dose_out_of_range"] = not catalog[r[1]][0] <= r[2] <= catalog[r[1]][1]
        if prev[r]:
            found["abrupt_change"] = abs(r[2] - prev[r][2]) / prev[r][2] > 0.5
        for detector, p in found.items():
            t = kind == detector
            counts[detector] = [a + b for a, b in zip(counts[detector], (t and p, p and not t, t and not p))]
    return counts


def test_evaluation_equals_a_loop_in_few_shuffles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"p{rng.randint(0, 3) * rng.randint(0, 3)}", rng.choice(["ibuprofeno", "varfarina", "unlisted"]), float(rng.choice([5, 10, 300, 500, 900])), rng.choice(["mg", "g"]), f"2024-01-{rng.randint(1, 9):02d}", i) for i in range(500)]
    truth = {(r[0], r[1], r[4]): rng.choice(["normal", "dose_out_of_range", "abrupt_change"]) for r in rows if rng.random() < 0.6}
    want = evaluated_by_loop(truth, rows, {"ibuprofeno": (200.0, 800.0), "varfarina": (1.0, 10.0)})
    rx = spark.createDataFrame(rows, RXROW + ", seq long").repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(*k, v) for k, v in truth.items()], "patient_id string, drug string, ts string, anomaly_type string").localCheckpoint()
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for long in (O.LONG_KEY, 30):
        monkeypatch.setattr(RX, "previous_by_key", partial(O.previous_by_key, long=long))
        got = RX.rx_evaluate(labels, rx, RX.default_catalog(spark), ["ts", "seq"]).collect()
        assert {r.detector: [r.tp, r.fp, r.fn] for r in got} == want
    monkeypatch.undo()
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        plan = RX.rx_evaluate(labels, rx, RX.default_catalog(spark).hint("broadcast"), ["ts", "seq"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 4  # the records by key, both sides of the join, the counts


def test_document_lines(table, as_rows):
    def doc(i, *lines):
        return [(i, n, line) for n, line in enumerate(lines)]

    full = ["Paciente: P1", "Medicamento: old", "Medicamento: dipirona", "Dose: 500 mg oral", "Frequência: 8/8h", "Data: 2024-01-01T10:00:00"]
    lines = doc("ok", *full) + doc("bad", *[x.replace("500", "5f") for x in full]) + doc("none", "nothing here") + doc("empty", full[0], "Medicamento: ", *full[3:])
    good, failed = documents.parse_prescription_lines(table(lines, "doc_id string, line_no long, line string"))
    assert as_rows(good, "doc_id", "drug", "dose", "unit", "ts") == [("ok", "dipirona", 500.0, "mg oral", "2024-01-01T10:00:00")]
    assert as_rows(failed, "doc_id", "field") == [("bad", "Dose"), ("empty", "Medicamento"), ("none", "Paciente")]


def test_outcome_lines(table, as_rows):
    lines = table(
        [("a", 0, "pCO2 5"), ("a", 1, " pH           7.26 "), ("a", 2, "pH 6.0"), ("b", 0, "pH_alt 7"), ("c", 0, "pH none"), ("c", 1, "pH 7")],
        "record_id string, line_no long, line string",
    )
    assert as_rows(signals.outcome_from_comments(lines), "record_id", "ph") == [("a", 7.26), ("b", None), ("c", None)]


def test_cycle_lines_keep_line_numbers(table, as_rows):
    text = ["0.0\t1.0\t0\t0", "bad", "1.0\t2.0\t1\t0", "x\t2\t0\t0", "2\t3\t0\t1", "3\t4\t1\t1", "4\t5\t2\t0"]
    got = recordings.parse_cycle_lines(table([("r", i, t) for i, t in enumerate(text)], "record_id string, line_no long, line string"))
    assert as_rows(got, "cycle_index", "label") == [(0, "normal"), (2, "crackle"), (4, "wheeze"), (5, "both")]


def test_coco_folder(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
        "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}],
        "categories": [{"id": 7, "name": "cystic_duct"}],
    }
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "two.json").write_text(json.dumps({**doc, "categories": [{"id": 7, "name": "other"}]}, indent=1))
    out = images.annotated_frames(*images.coco_tables(spark, str(tmp_path))).collect()
    assert sorted((r.file_name, [b["class"] for b in r.boxes]) for r in out) == [("a.jpg", ["cystic_duct"]), ("a.jpg", ["other"]), ("b.jpg", []), ("b.jpg", [])]


def test_evidence_is_idempotent(spark, tmp_path, table):
    found = table([("vitals", "r1", "e1", "src", 1), ("vitals", "r1", "e1", "newer", 2), ("video", "r2", "e1", "src", 1)], "feature string, run_id string, evidence_id string, source_record_id string, seq long")
    rows = evidence.evidence_rows(found)
    for _ in range(2):
        evidence.write_evidence(rows, str(tmp_path / "out"))
    evidence.write_evidence(rows.filter("feature = 'video'"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r.feature, r.source_record_id, r.severity, r.status) for r in back) == [("video", "src", "MEDIUM", "positive"), ("vitals", "newer", "MEDIUM", "positive")]

    second = table([("vitals", "r1", "e2", "src", 1, 7), ("vitals", "r1", "e1", "last", 1, 8)], "feature string, run_id string, evidence_id string, source_record_id string, seq long, extra long")
    evidence.write_evidence(evidence.evidence_rows(second), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r.run_id, r.evidence_id, r.source_record_id) for r in back) == [("r1", "e1", "last"), ("r1", "e2", "src"), ("r2", "e1", "src")]


def test_metric_and_transition_sinks(spark, tmp_path, table):
    evidence.write_metrics(table([("z", 1.0)], "detector string, f1 double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["f1"] == 1.0
    evidence.write_transitions(table([], "patient_id string, t double"), str(tmp_path / "t"))
    assert spark.read.schema("patient_id string, t double").json(str(tmp_path / "t")).count() == 0


def test_rules_are_worked_out_once(spark):
    df = spark.createDataFrame([("a", "paracetamol", 9.0, "mg", "2024-01-01"), ("a", "morfina", 90.0, "mg", "2024-01-02")], RXROW)
    out = RX.rule_rows(RX.evaluate_prescriptions(RX.previous_any_drug(df, ["ts"]), RX.default_catalog(spark)), "ts")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan  # no filter before the projection that works the rules out too
    assert sorted((r.ts[-1], r.rule) for r in out.collect()) == [(d, r) for d in "12" for r in ("abrupt_change", "dose_range", "substitution")]
    empty = out.sparkSession.createDataFrame([("x", [])], "ts string, results array<struct<rule: string, kind: string, reason: string>>")
    assert RX.rule_rows(empty, "ts").count() == 0
