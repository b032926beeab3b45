import random

import pytest
from pyspark.sql import functions as F

from wardwatch.functions.geometry import BODY_33
from wardwatch.operators import boxes as BX
from wardwatch.operators import motion as MO
from wardwatch.operators.tracking import SUMMARY, Tracker, assign_tracks, track_faults, track_segments

POSES = "seq_id string, frame_idx long, pose_idx long, track_id long, landmarks array<struct<x:double,y:double,z:double,vis:double>>"


def pose(frame, hips=(0.5, 0.5), shoulders=(0.5, 0.3), vis=0.9, track=1, seq="s", idx=0):
    marks = [(0.5, 0.5, 0.0, vis)] * 33
    for name, (x, y) in {"left_hip": hips, "right_hip": hips, "left_shoulder": shoulders, "right_shoulder": shoulders}.items():
        marks[BODY_33[name]] = (x, y, 0.0, vis)
    return (seq, frame, idx, track, marks)


def motion_of(table, rows, chunk=100000):
    return MO.frame_motion(MO.track_timelines(MO.pose_scalars(table(rows, POSES))), chunk=chunk)


def sequence(table, n, seq="s", label="fall"):
    return table([(seq, label, n)], "seq_id string, label string, n_frames long")


def test_window_of_two_frames(table):
    t = MO.track_timelines(MO.pose_scalars(table([pose(0, (0.5, 0.2)), pose(1, (0.5, 0.9))], POSES)))
    w = MO.movement_windows(t, sequence(table, 5), 2).collect()
    assert [(r.start_frame, r.end_frame) for r in w] == [(0, 1)]
    assert w[0].amplitude == pytest.approx(0.7) and w[0].velocity == pytest.approx(0.7)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_velocities_over_gaps(table, chunk):
    rows = [pose(f, (0.5, y)) for f, y in [(0, 0.1), (1, 0.2), (7, 0.3), (14, 0.5), (15, 0.6)]] + [pose(16, vis=0.1)]
    got = {r.frame_idx: (r.v_strict, r.v) for r in motion_of(table, rows, chunk).collect()}
    tenth, none = pytest.approx(0.1), None
    assert got == {0: (none, none), 1: (tenth, tenth), 7: (none, tenth), 14: (none, none), 15: (tenth, tenth), 16: (none, none)}


def test_fall_is_found_once(table):
    rows = [pose(f, (0.5, 0.3), (0.5, 0.15)) for f in range(40)]
    rows += [pose(40 + i, (0.5, 0.3 + 0.1 * i), (0.5 - 0.05 * i, 0.3 + 0.1 * i)) for i in range(6)]
    rows += [pose(f, (0.5, 0.9), (0.2, 0.9)) for f in range(46, 140)]
    found = MO.analyze_sequence(motion_of(table, rows), sequence(table, 140), 30.0).collect()
    assert [(r.finding, r.track_id, r.score) for r in found if r.finding == "fall_detected"] == [("fall_detected", 1, 1.0)]
    summary = MO.summarise_findings(MO.analyze_sequence(motion_of(table, rows), sequence(table, 140), 30.0)).first()
    assert summary.summary.startswith("Fall detected") and summary.score == 1.0
    still = [pose(f, (0.5, 0.3), (0.5, 0.15)) for f in range(140)]
    assert MO.analyze_sequence(motion_of(table, still), sequence(table, 140), 30.0).count() == 0


def test_ground_person_without_tracking(table):
    rows = [pose(f, (0.5, 0.4), idx=0, track=None) for f in range(4)] + [pose(f, (0.5, 0.8), idx=1, track=None) for f in range(4)] + [pose(40, track=None)]
    got = {r.frame_idx: r.pose_idx for r in MO.select_ground_person(MO.pose_scalars(table(rows, POSES)), chunk=3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1}


def test_untracked_fall(table):
    rows = [pose(f, (0.5, 0.3 + (0.1 * min(max(f - 20, 0), 5))), (0.3 if f > 20 else 0.5, 0.3), track=None) for f in range(60)]
    first = MO.first_pose_timelines(MO.pose_scalars(table(rows, POSES)))
    stats = MO.timeline_stats(MO.frame_motion(first), sequence(table, 60))
    out = MO.validate_fall_untracked(stats, MO.people_count(stats)).first()
    assert (out.verdict, out.velocity_score) == ("fall", 0.1) and 21 <= out.peak_frame <= 25


BOX = "seq_id string, frame_idx long, box_idx long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("chunk", [5, 100000])
def test_tracks_match_one_tracker(table, chunk):
    rng = random.Random(2)
    rows, f = [], 0
    for _ in range(60):
        f += rng.choice([1, 1, 1, 2, 5, 16, 17, 40])
        for i in range(rng.randint(1, 4)):
            x, y = 60.0 * rng.randint(0, 3) + rng.random() * 8, rng.random() * 8
            rows.append(("s", f, i, x, y, x + 50, y + 90))
    tracked = assign_tracks(table(rows, BOX), chunk, lead=3)
    assert [tuple(r)[1:] for r in track_faults(tracked).collect()] == [(len(rows), 0, 0, 0)]
    got = {(r.frame_idx, r.box_idx): r.track_id for r in tracked.collect()}
    tracker, want = Tracker(), {}
    for frame in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == frame]
        want.update({(frame, r[2]): t for r, t in zip(mine, tracker.step(frame, [r[3:] for r in mine]))})
    assert got == want


@pytest.mark.parametrize("lead", [0, 40])
def test_one_busy_sequence_is_many_tasks(table, lead):
    """No pause anywhere; without a lead-in every cut is unequal and done anew."""
    rng = random.Random(4)
    rows, at = [], [[100.0 * i, 50.0] for i in range(5)]
    for f in range(600):
        order = rng.sample(range(5), 5)
        for i, p in enumerate(order):
            at[p][0] += rng.choice([-3, 0, 3])
            if rng.random() < 0.85:
                rows.append(("s", f, i, at[p][0], at[p][1], at[p][0] + 50, at[p][1] + 90))
    done = track_segments(table(rows, BOX), 40, lead)
    assert done.filter(F.col("kind") == SUMMARY).count() == 15
    got = {(r.frame_idx, r.box_idx): r.track_id for r in assign_tracks(table(rows, BOX), 40, lead).collect()}
    tracker, want = Tracker(), {}
    for frame in range(600):
        mine = sorted(r for r in rows if r[1] == frame)
        want.update({(frame, r[2]): t for r, t in zip(mine, tracker.step(frame, [r[3:] for r in mine]))})
    assert got == want


def test_match_cases(table):
    boxes = "image string, class string, box_id string, x double, y double, w double, h double, confidence double"
    truth = table([("i", "a", "t1", 100.0, 100.0, 50.0, 50.0, None), ("j", "b", "t2", 0.0, 0.0, 9.0, 9.0, None)], boxes)
    near = table([("i", "a", "d1", 102.0, 102.0, 48.0, 48.0, 0.9), ("i", "a", "d2", 500.0, 500.0, 20.0, 20.0, 0.8), ("zz", "a", "d3", 1.0, 1.0, 1.0, 1.0, 0.9)], boxes)
    got = {r["class"]: (r.tp, r.fp, r.fn, r.precision, r.support) for r in BX.match_detections(truth, near, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1, 0, 0.5, 1), "b": (0, 0, 1, None, 1), "c": (0, 0, 0, None, 0)}
    empty = table([("zz",)], "image string")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in BX.match_detections(truth, near, ["a"], annotated=empty).collect()}
    assert got == {"a": (1, 2, 0)}


def box_iou(a, b):
    iw, ih = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, iw) * max(0.0, ih)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def test_greedy_rounds_match_loop(table):
    rng = random.Random(4)
    boxes = "image string, class string, box_id string, x double, y double, w double, h double, confidence double"
    make = lambda p, n: [("hot", "a", f"{p}{i:03d}", rng.random() * 150, rng.random() * 150, 30 + rng.random() * 40, 30 + rng.random() * 40, round(rng.random(), 2)) for i in range(n)]
    truths, dets = make("t", 60), make("d", 90)
    got = {r.det: r.truth for r in BX.greedy_matches(BX.overlapping_pairs(table(dets, boxes), table(truths, boxes), 0.3, 32.0)).collect()}
    free, want = list(truths), {}
    for d in sorted(dets, key=lambda d: (-d[7], d[2])):
        best = max(free, key=lambda t: (box_iou(d[3:7], t[3:7]), [-ord(c) for c in t[2]]), default=None)
        if best and box_iou(d[3:7], best[3:7]) >= 0.3:
            want[d[2]] = best[2]
            free.remove(best)
    assert got == want and len(want) > 10


def test_segments_cut_by_small_batches_equal_one_tracker(spark, table):
    rng = random.Random(4)
    rows = [(s, f, i, 90.0 * i + rng.random() * 9, 0.0, 90.0 * i + 60, 80.0) for s in "ab" for f in sorted(rng.sample(range(400), 150)) for i in range(3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.seq_id, r.frame_idx, r.box_idx): r.track_id for r in assign_tracks(table(rows, BOX), 40, 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for s in "ab":
        tracker = Tracker()
        for f in sorted({r[1] for r in rows if r[0] == s}):
            mine = sorted((r for r in rows if r[0] == s and r[1] == f), key=lambda r: r[2])
            want.update({(s, f, r[2]): t for r, t in zip(mine, tracker.step(f, [r[3:7] for r in mine]), strict=True)})
    assert got == want
