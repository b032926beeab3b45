"""Streams fed in several batches give what the batch operators give."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from wardwatch.operators import fusion as FU
from wardwatch.operators.tracking import Tracker
from wardwatch.session import ensure_checkpoint_dir
from wardwatch.streaming import streams as ST

ORIGIN = pd.Timestamp("2024-01-01")


def feed(spark, tmp_path, batches, schema, build):
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
    ensure_checkpoint_dir(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    out = build(stream)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_risk_in_batches_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    schema = "patient_id string, modality string, t double, seq long, severity double, evidence_id string, ts timestamp"
    rows = []
    for i in range(60):
        t = round(i * 17 + rng.random() * 10, 3)
        rows.append((rng.choice("pq"), rng.choice([*FU.WEIGHTS, "other"]), t, i, rng.choice([1.0, 0.45]), f"e{i}", (ORIGIN + pd.Timedelta(seconds=t)).to_pydatetime()))
    ST.use_rocksdb(spark)
    batches = [rows[i : i + 15] for i in range(0, 60, 15)]
    for b in batches:
        rng.shuffle(b)
    got = feed(spark, tmp_path, batches, schema, lambda s: ST.stream_risk(s.withWatermark("ts", "30 seconds"), int(ORIGIN.value // 10**6), step=20.0, half_life=100.0))
    events = spark.createDataFrame(rows, schema).withColumn("summary", F.lit(""))
    want = FU.hysteresis_level(FU.risk_points(events, step=20.0, half_life=100.0))
    done = max(r[2] for r in rows) - 30
    pick = lambda d: {(r.patient_id, r.k): (round(r.score, 9), r.level, r.previous_level) for r in d.collect()}
    late = {k: v for k, v in pick(want).items() if k[1] * 20.0 <= done}
    assert pick(got) == late and len(late) > 60


T0 = dt.datetime(2024, 1, 1)


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def mixed(rows, near, parts, rng):
    """Rows out of order by up to ``near`` places, in batches."""
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, near))
    size = -(-len(rows) // parts)
    return [[rows[i] for i in order[a : a + size]] for a in range(0, len(rows), size)]


def test_zscore_of_mixed_batches_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "record_id string, start timestamp, mean double, n long"
    rows = [(rng.choice("ab"), minutes(i // 2), None if i % 13 == 5 else float(rng.randint(90, 110)), i) for i in range(160)]
    rows += [("z", minutes(400), 1.0, 1000)]  # moves the watermark past all others
    batches = mixed(rows[:-1], 12, 6, rng) + [rows[-1:]]
    got = feed(spark, tmp_path, batches, schema, lambda s: ST.stream_zscore(s.withWatermark("start", "10 minutes"), 5, 1.5, ["n"], width=120.0))
    got = got.filter("record_id <> 'z'").collect()
    want = {}
    for key in "ab":
        before = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            score = None
            if r[2] is not None and len(before) == 5:
                m = sum(before) / 5
                sd = (sum((x - m) ** 2 for x in before) / 5) ** 0.5
                score = round(abs(r[2] - m) / sd, 9) if sd else (0.0 if r[2] == m else float("inf"))
            want[r[3]] = score
            before = [*before, r[2]][-5:] if r[2] is not None else before
    assert {r.n: None if r.score is None else round(r.score, 9) for r in got} == want
    assert not any(r.late for r in got) and all(r.start == minutes(r.n // 2) for r in got)
    assert {r.flag for r in got} == {None, True, False}


def test_late_rows_go_to_a_side_table_and_idle_keys_are_forgotten(spark, tmp_path):
    schema = "record_id string, start timestamp, mean double"
    # a: five means, then one behind the closed buckets, then a new start after a long pause
    batches = [
        [("a", minutes(i), 100.0 + i) for i in range(5)],
        [("b", minutes(60), 1.0)],
        [("b", minutes(61), 1.0)],
        [("a", minutes(2), 7.0), ("a", minutes(61), 110.0)],
        [("b", minutes(400), 1.0)],
        [("b", minutes(401), 1.0)],
        [("a", minutes(402), 5.0)],
        [("b", minutes(900), 1.0)],
        [("b", minutes(901), 1.0)],
    ]
    build = lambda s: ST.stream_zscore(s.withWatermark("start", "1 minute"), 3, 1.0, width=60.0, ttl=3600.0 * 2)
    got = feed(spark, tmp_path, batches, schema, build)
    a = {(r.start, r.mean): (r.score is not None, r.late) for r in got.filter("record_id = 'a'").collect()}
    assert a[minutes(2), 7.0] == (False, True)
    assert a[minutes(61), 110.0] == (True, False)
    assert a[minutes(402), 5.0] == (False, False)  # state was removed two hours after minute 61
    assert ST.on_time(got).count() == got.count() - 1


def test_tracks_of_mixed_batches_equal_one_tracker(spark, tmp_path):
    rng = random.Random(5)
    schema = "seq_id string, frame_idx long, box_idx string, x1 double, y1 double, x2 double, y2 double, ts timestamp"
    frames = [0, 1, 2, 3, 9, 10, 30, 31, 32, 33, 34, 60]
    rows = [("s", f, str(i), 100.0 * i + f, 0.0, 100.0 * i + f + 60, 90.0, minutes(f)) for f in frames for i in range(2)]
    end = [("t", 500, "0", 0.0, 0.0, 1.0, 1.0, minutes(500))]
    got = feed(spark, tmp_path, [*mixed(rows, 5, 4, rng), end], schema, lambda s: ST.stream_tracks(s.withWatermark("ts", "30 minutes"), width=60.0))
    got = {(r.frame_idx, r.box_idx): r.track_id for r in got.filter("seq_id = 's'").collect()}
    tracker, want = Tracker(), {}
    for f in frames:
        mine = [r for r in rows if r[1] == f]
        want.update({(f, r[2]): t for r, t in zip(mine, tracker.step(f, [r[3:7] for r in mine]), strict=True)})
    assert got == want


def test_prescriptions_of_mixed_batches_see_the_row_before(spark, tmp_path):
    rng = random.Random(6)
    schema = "patient_id string, drug string, dose double, unit string, ts timestamp, seq long"
    rows = [(rng.choice("pq"), rng.choice(["x", "y"]), float(rng.randint(1, 9)), "mg", minutes(i // 3), i) for i in range(60)]
    end = [("w", "x", 1.0, "mg", minutes(300), 999)]
    link = lambda s: ST.in_order(s.withWatermark("ts", "10 minutes"), "patient_id", "ts", ["seq"], "prev_drug string, prev_dose double, prev_unit string", ST.previous_prescription)
    got = feed(spark, tmp_path, [*mixed(rows, 9, 5, rng), end], schema, link).filter("patient_id <> 'w'").collect()
    want = {}
    for p in "pq":
        before = (None, None)
        for r in (r for r in rows if r[0] == p):
            want[r[5]] = before
            before = (r[1], r[2])
    assert {r.seq: (r.prev_drug, r.prev_dose) for r in got} == want


def test_alerts_once_per_watermark(spark, tmp_path):
    schema = "patient_id string, alert_key string, ts timestamp"
    rows = [("p", "k", minutes(0)), ("p", "k", minutes(5)), ("p", "other", minutes(6)), ("q", "k", minutes(6))]
    got = feed(spark, tmp_path, [rows[:2], rows[2:]], schema, ST.stream_alert_dedup)
    assert sorted((r.patient_id, r.alert_key) for r in got.collect()) == [("p", "k"), ("p", "other"), ("q", "k")]


class CountedState:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def handle(self):
        outer = self

        class Cell:
            def __init__(self, name):
                self.name = name

            def _do(self, f):
                outer.calls += 1
                return f(outer.kept)

            get = lambda self: self._do(lambda k: k.get(self.name))
            exists = lambda self: self._do(lambda k: self.name in k)
            update = lambda self, v: self._do(lambda k: k.__setitem__(self.name, v))
            clear = lambda self: self._do(lambda k: [k.pop(x) for x in list(k) if x == self.name or x[0] == self.name])
            getValue = lambda self, a: self._do(lambda k: k.get((self.name, a)))
            containsKey = lambda self, a: self._do(lambda k: (self.name, a) in k)
            updateValue = lambda self, a, v: self._do(lambda k: k.__setitem__((self.name, a), v))
            removeKey = lambda self, a: self._do(lambda k: k.pop((self.name, a), None))
            keys = lambda self: self._do(lambda k: [x[1] for x in k if x[0] == self.name])

        class Handle:
            getMapState = getValueState = staticmethod(lambda name, *schemas: Cell(name))
            registerTimer = staticmethod(outer.timers.append)

        return Handle()


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_calls_grow_with_arrivals_not_with_buckets():
    state = CountedState()
    fold = lambda memory, rows: ([(r["v"],) for r in rows], memory)
    machine = ST.InOrder(["key", "v", "event_us"], ["w"], ["v"], fold, 1_000_000, 10**15)
    machine.init(state.handle())
    places = list(range(1000))
    random.Random(8).shuffle(places)
    part = pd.DataFrame({"key": "a", "v": places, "event_us": [p * 1_000_000 for p in places]})
    list(machine.handleInputRows(("a",), iter([part.iloc[:500]]), At(0)))
    list(machine.handleInputRows(("a",), iter([part.iloc[500:]]), At(0)))  # an earlier bucket is not late yet
    some = pd.concat(machine.handleExpiredTimer(("a",), At(400_000), None))
    rest = pd.concat(machine.handleExpiredTimer(("a",), At(10**7), None))
    assert some["v"].tolist() == list(range(400)) and rest["v"].tolist() == list(range(400, 1000))
    assert not some["late"].any() and not rest["late"].any()
    assert state.calls < 40


def test_zscore_query_gives_every_event(spark, tmp_path):
    from registered import streaming as RS

    rows = [(i, T0 + dt.timedelta(minutes=20 * i), i % 2, "view", float(i * i % 7)) for i in range(40)]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = RS.fam.queries["str_zscore"](spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in got) == list(range(40))
    assert sum(r.score is not None for r in got) == 30
