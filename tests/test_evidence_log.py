"""The evidence log: writers beside each other, snapshots, compaction, repeated batches."""

from __future__ import annotations

from pathlib import Path

from wardwatch.sources import evidence_log as LOG

ROWS = "feature string, run_id string, evidence_id string, score double, n int"


def rows_of(spark, rows):
    return spark.createDataFrame([("f", "r", *r) for r in rows], ROWS)


def held(spark, path, upto=None, order=()):
    found = LOG.read_evidence(spark, path, upto, order)
    return {r.evidence_id: r.score for r in found.collect()}


def test_two_writers_of_one_run_keep_both(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert LOG.read_evidence(spark, path) is None
    LOG.append_evidence(rows_of(spark, [("a", 1.0, 1), ("b", 1.0, 1)]), path)
    seen = LOG.commits(path)
    with monkeypatch.context() as m:  # both writers saw the same commits
        m.setattr(LOG, "commits", lambda *a, **k: seen)
        LOG.append_evidence(rows_of(spark, [("c", 2.0, 1)]), path)
        LOG.append_evidence(rows_of(spark, [("d", 2.0, 1)]), path)
    assert held(spark, path) == {"a": 1.0, "b": 1.0, "c": 2.0, "d": 2.0}


def test_replacing_one_id_writes_only_that_id(spark, tmp_path):
    path = str(tmp_path / "log")
    LOG.append_evidence(rows_of(spark, [(f"e{i}", 1.0, i) for i in range(20)]), path)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    LOG.append_evidence(rows_of(spark, [("e3", 5.0, 1), ("e3", 9.0, 2)]), path, order=["n"])
    after = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert all(after[f] == t for f, t in before.items())
    assert spark.read.parquet(*[str(f) for f in after if f not in before]).count() == 1
    assert held(spark, path)["e3"] == 9.0 and held(spark, path, upto=1)["e3"] == 1.0


def test_half_a_write_is_not_seen_and_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    LOG.append_evidence(rows_of(spark, [("a", 1.0, 1)]), path, name="s-0")
    rows_of(spark, [("x", 1.0, 1)]).write.parquet(f"{path}/data/half")  # a writer died before its commit
    LOG.append_evidence(rows_of(spark, [("a", 7.0, 1)]), path, name="s-0")  # the same batch again
    assert held(spark, path) == {"a": 1.0}


def test_compaction_keeps_rows_and_commits_made_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for i in range(4):
        LOG.append_evidence(rows_of(spark, [("same", float(i), 9 - i), (f"own{i}", 1.0, i)]), path, name=f"s-{i}")
    want, by_n = held(spark, path), held(spark, path, order=["n"])
    assert want["same"] == 3.0 and by_n["same"] == 0.0
    seen = LOG.commits(path)
    LOG.append_evidence(rows_of(spark, [("late", 1.0, 1)]), path)
    with monkeypatch.context() as m:
        m.setattr(LOG, "commits", lambda *a, **k: seen)
        assert LOG.compact_evidence(spark, path)
    assert len(LOG.commits(path)) == 2 and held(spark, path) == want | {"late": 1.0}
    LOG.append_evidence(rows_of(spark, [("same", 50.0, 0)]), path, name="s-2")  # replaced, yet still known
    assert held(spark, path) == want | {"late": 1.0}
    assert LOG.compact_evidence(spark, path) and not LOG.compact_evidence(spark, path)
    assert LOG.vacuum_evidence(path) == 6 and LOG.vacuum_evidence(path) == 0
    assert held(spark, path) == want | {"late": 1.0}
