"""Person tracks from boxes, frame by frame.

Matching is sequential inside a sequence, yet a tracker soon forgets: which boxes it knows
depends on the last frames alone. So a sequence is cut into segments of frames, each
tracked by its own task from an empty start some frames earlier. At every cut the boxes
that the segment before ends with are compared with those the next one starts with. Where
they are equal, both are right if the first is; only segments behind an unequal cut are
tracked again, from the end of the one before. Track numbers are joined by offsets and by
the boxes that pass each cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.plans.materialise import written

# Smallest overlap, centre distance as a share of the box diagonal, and
# how many frames a lost track is kept.
MIN_IOU = 0.4
MAX_CENTER = 0.25
MAX_LOST = 15
SEGMENT, LEAD = 2048, 64
BOX, SUMMARY = 0, 1


def overlap(a, b) -> float:
    """Intersection over union of two corner boxes (x1, y1, x2, y2)."""
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


class Tracker:
    """Tracks of one sequence part: ``tracks`` maps id to (box, last frame seen)."""

    def __init__(self, tracks: dict | None = None, next_id: int = 0):
        self.tracks = tracks or {}
        self.next_id = next_id

    def step(self, frame: int, boxes: list[tuple]) -> list[int]:
        """Ids for the boxes of one frame; frames arrive in order, empty ones may be left out."""
        self.tracks = {t: (b, at) for t, (b, at) in self.tracks.items() if frame - at <= MAX_LOST}
        near = []
        for i, box in enumerate(boxes):
            diagonal = max(((box[2] - box[0]) ** 2 + (box[3] - box[1]) ** 2) ** 0.5, 1.0)
            for track, (old, seen) in self.tracks.items():
                shared = overlap(box, old)
                away = ((box[0] + box[2] - old[0] - old[2]) ** 2 + (box[1] + box[3] - old[1] - old[3]) ** 2) ** 0.5 / 2
                if shared >= MIN_IOU and away <= diagonal * MAX_CENTER:
                    # equal overlaps: the track seen last, then by its box, as any cut of
                    # the sequence knows them; the number only tells equal boxes apart
                    near.append((-shared, i, -seen, old, track))
        ids: dict[int, int] = {}
        taken = set()
        for _, i, _, _, track in sorted(near):
            if i not in ids and track not in taken:
                ids[i] = track
                taken.add(track)
        for i in range(len(boxes)):
            if i not in ids:
                ids[i] = self.next_id
                self.next_id += 1
            self.tracks[ids[i]] = (boxes[i], frame)
        return [ids[i] for i in range(len(boxes))]

    def alive(self, frame: int) -> list[tuple]:
        """(last frame, box, id) of the tracks that a box of ``frame`` could join, in order."""
        return sorted((at, tuple(map(float, box)), t) for t, (box, at) in self.tracks.items() if frame - at <= MAX_LOST)


def _follow(tracker: Tracker, rows: pd.DataFrame) -> list[int]:
    frames, boxes = rows["frame_idx"].tolist(), list(zip(rows["x1"], rows["y1"], rows["x2"], rows["y2"], strict=True))
    ids: list[int] = []
    start = 0
    for end in range(1, len(frames) + 1):
        if end == len(frames) or frames[end] != frames[start]:
            ids += tracker.step(frames[start], boxes[start:end])
            start = end
    return ids


def _segment(known: list[tuple], rows: pd.DataFrame, until: int) -> pd.DataFrame:
    """The rows of one segment with local ids, behind a row that sums it up. ``known`` are
    the tracks at its start, (last frame, box), whose local ids are their places."""
    tracker = Tracker({i: (tuple(box), at) for i, (at, box) in enumerate(known)}, len(known))
    out = rows.assign(kind=BOX, local_id=_follow(tracker, rows), starts=None, ends=None, links=None)
    ends = tracker.alive(until)
    summed = rows.iloc[:1].assign(
        kind=SUMMARY,
        local_id=tracker.next_id,
        starts=json.dumps(known),
        ends=json.dumps([e[:2] for e in ends]),
        links=json.dumps([e[2] for e in ends]),
    )
    return pd.concat([summed, out])


NONE = json.dumps([])


def track_segments(boxes: DataFrame, segment: int, lead: int) -> DataFrame:
    """Every segment tracked: from its lead-in, then, while a cut is unequal, anew."""
    boxes = boxes.select("seq_id", "frame_idx", "box_idx", "x1", "y1", "x2", "y2")
    names = [*boxes.columns, "seg"]
    types = dict(boxes.dtypes) | {"seg": "long"}
    schema = ", ".join([*[f"{c} {types[c]}" for c in names], "kind int, local_id long, starts string, ends string, links string"])
    columns = [*names, "kind", "local_id", "starts", "ends", "links"]
    home = F.floor(F.col("frame_idx") / F.lit(segment)).cast("long")
    spread = boxes.withColumn("seg", F.explode(F.sequence(home, F.floor((F.col("frame_idx") + lead) / F.lit(segment)).cast("long"))))

    def speculate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments one behind the other, each in order of its frames: a task takes any
        number of short segments, and holds one frame of a long one."""
        here, tracker, known, head, frame, held = None, Tracker(), None, None, None, []
        out: list[tuple] = []

        def step() -> None:
            ids = tracker.step(frame, [r[3:7] for r in held])
            if known is not None:
                out.extend((*r, BOX, i, None, None, None) for r, i in zip(held, ids, strict=True))

        def close() -> None:
            if held:
                step()
            if known is not None:
                ends = tracker.alive((here[1] + 1) * segment)
                out.append((*head, SUMMARY, tracker.next_id, json.dumps(known), json.dumps([e[:2] for e in ends]), json.dumps([e[2] for e in ends])))

        for batch in batches:
            for r in zip(*(batch[c].tolist() for c in names), strict=True):
                if (r[0], r[7]) != here:
                    close()
                    here, tracker, known, head, frame, held = (r[0], r[7]), Tracker(), None, None, None, []
                if r[1] != frame:
                    if held:
                        step()
                    frame, held = r[1], []
                    if known is None and frame >= here[1] * segment:
                        known = [e[:2] for e in tracker.alive(here[1] * segment)]
                        tracker, head = Tracker({i: (tuple(box), at) for i, (at, box) in enumerate(known)}, len(known)), r
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    def again(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=columns)
        known = [(at, tuple(box)) for at, box in json.loads(before["known"].iloc[0])]
        rows = rows.sort_values(["frame_idx", "box_idx"], kind="stable")
        return _segment(known, rows[names], (int(key[1]) + 1) * segment)

    dealt = spread.repartition("seq_id", "seg").sortWithinPartitions("seq_id", "seg", "frame_idx", "box_idx")
    first = written(dealt.mapInPandas(speculate, schema))
    redone = None  # segments tracked anew, as they are after the last round
    while True:
        done = first if redone is None else first.join(redone.select("seq_id", "seg").distinct(), ["seq_id", "seg"], "left_anti").unionByName(redone)
        cuts = done.filter(F.col("kind") == SUMMARY)
        ends = cuts.select("seq_id", (F.col("seg") + 1).alias("seg"), F.col("ends").alias("known"))
        unequal = cuts.join(ends, ["seq_id", "seg"], "left").withColumn("known", F.coalesce("known", F.lit(NONE)))
        unequal = written(unequal.filter(F.col("starts") != F.col("known")).select("seq_id", "seg", "known"))
        if unequal.isEmpty():
            return done
        rows = first.filter(F.col("kind") == BOX).select(*names).join(unequal.select("seq_id", "seg"), ["seq_id", "seg"], "left_semi")
        starts = unequal.toDF("seq_at", "seg_at", "known")
        again_done = rows.groupBy("seq_id", "seg").cogroup(starts.groupBy("seq_at", "seg_at")).applyInPandas(again, schema)
        redone = written(again_done if redone is None else redone.join(unequal, ["seq_id", "seg"], "left_anti").unionByName(again_done))


def assign_tracks(boxes: DataFrame, segment: int = SEGMENT, lead: int = LEAD) -> DataFrame:
    """Adds ``track_id`` to boxes ``(seq_id, frame_idx, box_idx, x1, y1, x2, y2)``.

    Ids are those of one tracker that takes all frames of a sequence in order. The redo
    rounds end at the latest when every segment followed the one before it; with a lead-in
    longer than people stay unseen there is hardly ever one.
    """
    segment = max(segment, MAX_LOST + 1)  # a segment without boxes then forgets all tracks
    done = track_segments(boxes, segment, lead)
    cuts = done.filter(F.col("kind") == SUMMARY).select("seq_id", "seg", "starts", "links", F.col("local_id").alias("used"))
    cuts = cuts.repartition("seq_id").sortWithinPartitions("seq_id", "seg")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One short row per segment, streamed in order: the ids that pass its cut, and the
        first id of tracks born in it."""
        seq, last, passing, total = None, None, [], 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.seq_id != seq:
                    seq, last, passing, total = r.seq_id, None, [], 0
                known = len(json.loads(r.starts))
                here = passing if last == r.seg - 1 else []
                born = total
                total += int(r.used) - known
                passing = [here[i] if i < known else born + i - known for i in json.loads(r.links)]
                last = r.seg
                out.append((r.seq_id, r.seg, here, born - known))
            yield pd.DataFrame(out, columns=["seq_id", "seg", "passed", "base"])

    kind = dict(boxes.dtypes)["seq_id"]
    bases = cuts.mapInPandas(numbered, f"seq_id {kind}, seg long, passed array<long>, base long")
    local = F.col("local_id")
    track = F.coalesce(F.get("passed", local.cast("int")), F.col("base") + local)
    rows = done.filter(F.col("kind") == BOX).join(bases, ["seq_id", "seg"])
    return rows.select("seq_id", "frame_idx", "box_idx", "x1", "y1", "x2", "y2", track.alias("track_id"))


def admissible(box: str, old: str) -> Column:
    """Whether struct column ``box`` may continue a track last seen at struct ``old``."""
    f = lambda s, n: F.col(f"{s}.{n}")
    wide, high = (F.least(f(box, b), f(old, b)) - F.greatest(f(box, a), f(old, a)) for a, b in (("x1", "x2"), ("y1", "y2")))
    area = lambda s: (f(s, "x2") - f(s, "x1")) * (f(s, "y2") - f(s, "y1"))
    inter = wide * high
    shared = F.when((wide > 0) & (high > 0), inter / (area(box) + area(old) - inter)).otherwise(0.0)
    square = lambda x: x * x
    diagonal = F.greatest(F.sqrt(square(f(box, "x2") - f(box, "x1")) + square(f(box, "y2") - f(box, "y1"))), F.lit(1.0))
    away = F.sqrt(square(f(box, "x1") + f(box, "x2") - f(old, "x1") - f(old, "x2")) + square(f(box, "y1") + f(box, "y2") - f(old, "y1") - f(old, "y2"))) / 2
    return (shared >= MIN_IOU) & (away <= diagonal * MAX_CENTER)


def track_faults(tracked: DataFrame) -> DataFrame:
    """What must never happen, counted per sequence: an id twice in a frame, a step of a
    track that is not admissible, and a new track where a free one was admissible."""
    box = F.struct("x1", "y1", "x2", "y2")
    rows = tracked.select("seq_id", "track_id", "frame_idx", box.alias("box"))
    twice = rows.groupBy("seq_id", "frame_idx", "track_id").count().filter("count > 1").groupBy("seq_id").agg(F.count(F.lit(1)).alias("twice"))
    order = Window.partitionBy("seq_id", "track_id").orderBy("frame_idx")
    steps = rows.select("*", F.lag("box").over(order).alias("old"), F.lag("frame_idx").over(order).alias("seen"), F.lead("frame_idx").over(order).alias("next"))
    broken = steps.filter(F.col("old").isNotNull()).filter(~(admissible("box", "old") & (F.col("frame_idx") - F.col("seen") <= MAX_LOST)))
    broken = broken.groupBy("seq_id").agg(F.count(F.lit(1)).alias("broken"))
    until = F.least(F.col("frame_idx") + MAX_LOST, F.coalesce(F.col("next") - 1, F.col("frame_idx") + MAX_LOST))
    # a lost box waits MAX_LOST frames at most, so in two blocks of frames at most
    block = lambda c: F.floor(c / F.lit(MAX_LOST + 1)).cast("long")
    since = F.col("frame_idx") + 1
    free = steps.filter(until > F.col("frame_idx")).select("seq_id", since.alias("_from"), until.alias("_to"), F.col("box").alias("left"))
    free = free.withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to")))))
    born = steps.filter(F.col("old").isNull()).select("seq_id", "frame_idx", "box", block(F.col("frame_idx")).alias("_block"))
    met = born.join(free, ["seq_id", "_block"]).filter((F.col("frame_idx") >= F.col("_from")) & (F.col("frame_idx") <= F.col("_to")))
    missed = met.filter(admissible("box", "left")).groupBy("seq_id").agg(F.count(F.lit(1)).alias("missed"))
    out = tracked.groupBy("seq_id").agg(F.count(F.lit(1)).alias("boxes"))
    for found in (twice, broken, missed):
        out = out.join(found, "seq_id", "left")
    return out.na.fill(0, ["twice", "broken", "missed"])
