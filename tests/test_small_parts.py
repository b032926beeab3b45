"""Readers, rejects and empty cases that no registered query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwatch.operators import fusion as FU
from wardwatch.operators import prescriptions as RX
from wardwatch.operators import vitals as VI
from wardwatch.sources import documents as DOC
from wardwatch.sources import evidence as EV
from wardwatch.sources import signals as SIG


def test_samples_and_records_are_read_by_name_and_type(spark, tmp_path):
    samples = spark.createDataFrame([(1.5, "FHR", 3, "r", "x")], "x double, channel string, idx long, record_id string, more string")
    samples.write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in SIG.read_samples(spark, str(tmp_path / "s")).collect()] == [("r", 3, "FHR", 1.5)]
    spark.createDataFrame([("r", 4.0, None)], SIG.RECORDS).write.json(str(tmp_path / "r"))
    assert [tuple(r) for r in SIG.read_records(spark, str(tmp_path / "r"), "json").collect()] == [("r", 4.0, None)]


def test_declared_records_without_samples(spark):
    order = spark.createDataFrame([("a", 0), ("b", 1)], "record_id string, place int")
    samples = spark.createDataFrame([("a", "FHR", 0, 1.0)], "record_id string, channel string, idx long, x double")
    assert [r.record_id for r in VI.missing_records(order, samples).collect()] == ["b"]


def test_text_that_is_no_instant_is_null(spark):
    got = spark.createDataFrame([("2024-01-01T00:00:10",), ("yesterday",), (None,)], "t string").select(FU.iso_instant(F.col("t")).alias("i")).collect()
    assert [r.i is None for r in got] == [False, True, True]


def test_unreadable_documents_have_a_summary_without_score(spark):
    lines = spark.createDataFrame([("d", 0, "Paciente: p"), ("d", 1, "nothing")], "doc_id string, line_no int, line string")
    ok, failed = DOC.parse_prescription_lines(lines)
    assert ok.count() == 0
    assert [tuple(r) for r in RX.unreadable_summary(failed).collect()] == [("d", "The document could not be read.", None)]


def test_report_without_events_says_so(spark):
    none = spark.createDataFrame([], "frame long, kind string, evidence_path string")
    assert [r.line for r in EV.event_report(none, none).collect()] == ["No event detected."]


def test_cycle_lines_are_split_once_and_parsed_as_before(spark, capsys):
    from wardwatch.sources import recordings as REC

    lines = [" 0.5\t1.5\t0\t1 ", "\t0.5\t1.5\t0\t1", "1\tend\t0\t1", "1\t2\t2\t0", "1\t2\t0", "1\t2\t0\t0\t0", "", None, " 1e1\t .5 \t1\t1\r\n"]
    df = REC.parse_cycle_lines(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "record_id string, line_no long, line string"))
    got = {r.cycle_index: (r.start_s, r.end_s, r.label) for r in df.collect()}
    assert got == {0: (0.5, 1.5, "wheeze"), 1: (0.5, 1.5, "wheeze"), 8: (10.0, 0.5, "both")}
    df.explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_shuffles_begin_with_partitions_for_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from wardwatch.bridge import views as V

    spark.range(20000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    keys = (V.INITIAL, V.ADVISORY)
    before = {k: spark.conf.get(k, None) for k in keys}
    monkeypatch.setattr(V, "PARQUET_PER_TASK", 10000)
    try:
        V.table(spark, str(tmp_path), "events")
        assert int(spark.conf.get(V.INITIAL)) > 20
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_prescription_lines_are_shuffled_before_they_are_sorted(spark, capsys):
    from wardwatch.sources import documents as DOC

    rows = [("a", 0, "nothing"), ("b", 0, "Dose: 1 mg"), ("b", 1, " Dose : 2 mg"), ("b", 2, "Paciente: p")]
    good, failed = DOC.parse_prescription_lines(spark.createDataFrame(rows, "doc_id string, line_no int, line string"))
    assert sorted((r.doc_id, r.field) for r in failed.collect()) == [("a", "Paciente"), ("b", "Medicamento")]
    assert good.count() == 0
    failed.explain()
    plan = capsys.readouterr().out
    assert plan.index("partial_max_by") < plan.index("Exchange")  # printed from the last step to the first
