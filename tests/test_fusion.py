import random

import pytest
from pyspark.sql import functions as F

from wardwatch.operators import fusion as FU

EVENTS = "patient_id string, modality string, t double, severity double, summary string, evidence_id string, seq long"


def event(modality, t, severity=1.0, patient="p", seq=0):
    return (patient, modality, float(t), severity, f"{modality} at {t}", f"{modality}-{t}-{seq}", seq)


def step(level, s, y=0.15, r=0.35, h=0.05):
    if level < 2 and s > r + h:
        return 2
    if level == 0:
        return 1 if s > y + h else 0
    if s < y - h:
        return 0
    return 1 if level == 2 and s < r - h else level


def test_level_series(table):
    scores = [0.05, 0.25, 0.18, 0.14, 0.8, 0.35, 0.25, 0.08]
    df = table([("p", k, s) for k, s in enumerate(scores)], "patient_id string, k long, score double")
    for chunk in (2, 3, 100):
        got = [r.level for r in FU.hysteresis_level(df, chunk=chunk).orderBy("k").collect()]
        assert got == ["green", "yellow", "yellow", "yellow", "red", "red", "yellow", "green"]


@pytest.mark.parametrize("chunk", [3, 50])
def test_level_matches_fold(table, chunk):
    rng = random.Random(7)
    rows = [(p, k, rng.choice([0.05, 0.1, 0.12, 0.2, 0.21, 0.3, 0.31, 0.4, 0.41, 0.5])) for p in "abc" for k in range(90)]
    got = {(r.patient_id, r.k): (r.level, r.previous_level) for r in FU.hysteresis_level(table(rows, "patient_id string, k long, score double"), chunk=chunk).collect()}
    for p in "abc":
        level = 0
        for _, k, s in (r for r in rows if r[0] == p):
            before, level = level, step(level, s)
            assert got[p, k] == (FU.LEVELS[level], FU.LEVELS[before])


def test_decay(spark):
    r = spark.range(1).select(*[FU.half_life_decay(F.lit(float(d)), 600.0).alias(f"d{d}") for d in (0, 600, 1200)]).first()
    assert tuple(r) == (1.0, 0.5, 0.25)


def test_grid_ends_one_step_after_last_event(table):
    grid = FU.time_grid(table([event("video", 25)], EVENTS), 10.0)
    assert sorted(r.t for r in grid.collect()) == [0.0, 10.0, 20.0, 30.0]
    assert FU.time_grid(table([], EVENTS), 10.0).count() == 0


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_points_match_loop(table, chunk):
    rng = random.Random(3)
    mods = ["video", "audio", "vitals", "prescription", "other"]
    events = [event(rng.choice(mods), rng.choice([0, 5, 10, rng.random() * 200]), rng.choice([1.0, 0.45, 0.2]), p, i) for p in ("p", "q") for i in range(25)]
    got = {(r.patient_id, r.k): r for r in FU.risk_points(table(events, EVENTS), step=10.0, half_life=40.0, chunk=chunk).collect()}
    n = 0
    for p in ("p", "q"):
        mine = sorted((e for e in events if e[0] == p), key=lambda e: (e[2], e[6]))
        k = 0
        while k * 10.0 <= mine[-1][2] + 10.0:
            t = k * 10.0
            latest = {e[1]: e for e in mine if e[2] <= t}
            parts = {m: w * latest[m][3] * 2 ** (-(t - latest[m][2]) / 40.0) for m, w in FU.WEIGHTS.items() if m in latest}
            r = got[p, k]
            assert r.score == pytest.approx(sum(parts.values()))
            assert set(r.contributions) == set(parts) and r.missing == [m for m in FU.WEIGHTS if m not in parts]
            assert [e.evidence_id for e in r.events] == [latest[m][5] for m in FU.WEIGHTS if m in latest]
            k += 1
            n += 1
    assert n == len(got)


def test_one_alert_for_four_critical_events(table):
    events = table([event(m, 0) for m in FU.WEIGHTS], EVENTS)
    levelled = FU.hysteresis_level(FU.risk_points(events))
    alerts = FU.dedup_alerts(levelled).collect()
    assert [(a.t, a.level, a.score) for a in alerts] == [(0.0, "red", 1.55)]
    assert alerts[0].reason.startswith("[video] video at 0 (now) — ") and alerts[0].reason.endswith("(contributions: audio: 0.30 | prescription: 0.45 | video: 0.40 | vitals: 0.40)")
    assert FU.dedup_alerts(levelled, FU.dedup_alerts(levelled)).count() == 0
