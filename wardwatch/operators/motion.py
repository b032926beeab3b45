"""Movement analysis on pose tables ``(seq_id, frame_idx, pose_idx, track_id, landmarks)``.

Landmarks are reduced to a few numbers per pose right after the scan, and every
later step works on those. A timeline is one (seq_id, track_id); frames without a
row count as "no person", and ``sequences(seq_id, n_frames)`` gives its length.
Steps that look along a timeline are cut into frame chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.geometry import BODY_33, LIMBS, VISIBLE, Body
from wardwatch.functions.guards import count_where, dbl
from wardwatch.functions.text import exact_round, fixed
from wardwatch.operators.quality import binary_metrics
from wardwatch.operators.vitals import window_numbers
from wardwatch.plans.joins import interval_join
from wardwatch.plans.materialise import written
from wardwatch.plans.ordered import DEFAULT_CHUNK, chunk_window, core_rows, dense_index, with_halo
from wardwatch.plans.quantiles import exact_quantile
from wardwatch.plans.runs import mark_runs, runs

TRACK = ("seq_id", "track_id")


@dataclass(frozen=True)
class MotionLimits:
    """Frame counts and thresholds; the defaults are the calibrated fixed values."""

    last: int = 90
    last_min: int = 10
    recumbent_y: float = 0.45
    first: int = 30
    first_min: int = 5
    first_extended: int = 90
    initial_y: float = 0.65
    role_min: int = 10
    standing_last: int = 30
    standing_y: float = 0.35
    max_gap: int = 5
    velocity_floor: float = 0.01
    streak_floor: float = 0.02
    min_coverage: float = 0.05
    min_frames: int = 120
    block: int = 30
    block_shift: float = 0.03
    changes_per_minute: float = 30.0
    exit_window: int = 60
    exit_min: int = 5
    exit_dy: float = 0.10
    exit_dx: float = 0.05
    fall_window: int = 30
    fall_stride: int = 15
    fall_amplitude: float = 0.55
    fall_persistence: int = 1
    default_torso: float = 0.14
    min_torso: float = 0.08
    velocity_cap: float = 1.5
    descent_cap: float = 10.0
    tilt_single: float = 25.0
    tilt_multi: float = 35.0
    descent_single: float = 0.20
    descent_multi: float = 0.30
    velocity_single: float = 0.02
    velocity_multi: float = 0.04
    slide_net: float = 0.15
    slide_dx: float = 0.05
    slide_dx_min: int = 5
    slide_v: float = 0.05
    static_range: float = 0.10
    static_min: int = 10
    full_score_velocity: float = 0.40


LIMITS = MotionLimits()


def pose_scalars(poses: DataFrame, joints: Mapping[str, int] = BODY_33) -> DataFrame:
    """The numbers later steps need, per pose."""
    b = Body(joints)
    hips = ["left_hip", "right_hip"]
    return poses.select(
        "seq_id",
        "frame_idx",
        "pose_idx",
        "track_id",
        b.mean("vis").alias("mean_vis"),
        b.mean("y").alias("mean_y"),
        b.hip_center("y").alias("hy"),
        b.body_center("x").alias("cx"),
        b.body_center("y").alias("cy"),
        b.mid(hips, "x").alias("mx"),
        b.mid(hips, "y").alias("my"),
        F.abs(b.at("left_hip", "y") - b.at("right_hip", "y")).alias("asymmetry"),
        F.when(b.at("left_hip", "vis") >= dbl(VISIBLE), b.at("left_hip", "y")).alias("lhy"),
        F.when(b.at("right_hip", "vis") >= dbl(VISIBLE), b.at("right_hip", "y")).alias("rhy"),
        b.torso_height().alias("torso"),
        b.trunk_tilt().alias("tilt"),
        *[b.joint_angle(*triple).alias(name) for name, triple in LIMBS.items()],
    )


def track_timelines(scalars: DataFrame) -> DataFrame:
    """One row per track and frame; of several poses the last one counts. Untracked
    poses belong to no timeline."""
    body = [c for c in scalars.columns if c not in ("seq_id", "track_id", "frame_idx")]
    return (
        scalars.filter(F.col("track_id").isNotNull())
        .groupBy(*TRACK, "frame_idx")
        .agg(F.max_by(F.struct(*body), "pose_idx").alias("_p"))
        .select(*TRACK, "frame_idx", "_p.*")
    )


def with_length(rows: DataFrame, sequences: DataFrame, pos: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``n_frames``. Sequences are listed once per chunk of their frames and joined
    by (sequence, chunk), so a long sequence spreads over many tasks, here and after."""
    last = F.floor((F.col("n_frames") - 1) / chunk).cast("long")
    lengths = sequences.filter("n_frames > 0").select(
        "seq_id", "n_frames", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_at")
    )
    return rows.withColumn("_at", F.floor(F.col(pos) / chunk).cast("long")).join(lengths, ["seq_id", "_at"]).drop("_at")


def movement_windows(
    timelines: DataFrame, sequences: DataFrame, size: int, stride: int | None = None
) -> DataFrame:
    """Amplitude, velocity and asymmetry of the hip midpoint per window of frames.

    Windows start at every stride below the sequence length, the last may be short;
    windows without a person do not appear. ``end_frame`` is inclusive. A window
    holds at most ``size`` points, so the pairwise maximum is bounded.
    """
    stride = size if stride is None else stride
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    placed = timelines.select(*TRACK, "frame_idx", "mx", "my", "asymmetry").withColumn(
        "k", F.explode(window_numbers(F.col("frame_idx"), size, stride))
    )
    grouped = placed.groupBy(*TRACK, "k").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", "mx", "my"))).alias("_p"), F.avg("asymmetry").alias("asymmetry")
    )
    p, n = F.col("_p"), F.size("_p")

    def dist(a: Column, b: Column) -> Column:
        dx, dy = a["mx"] - b["mx"], a["my"] - b["my"]
        return F.sqrt(dx * dx + dy * dy)

    widest = F.array_max(F.transform(p, lambda a: F.array_max(F.transform(p, lambda b: dist(a, b)))))
    steps = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), dist)
    mean_step = F.aggregate(steps, dbl(0), lambda s, d: s + d) / (n - 1)
    start = F.col("k") * stride
    return with_length(grouped.withColumn("_start", start), sequences, "_start").select(
        *TRACK,
        "k",
        F.col("_start").alias("start_frame"),
        (F.least(F.col("_start") + size, F.col("n_frames")) - 1).alias("end_frame"),
        F.when(n > 1, widest).otherwise(dbl(0)).alias("amplitude"),
        F.when(n > 1, mean_step).otherwise(dbl(0)).alias("velocity"),
        "asymmetry",
    )


def frame_motion(timelines: DataFrame, max_gap: int = LIMITS.max_gap, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``v_strict`` (hip descent from the frame before), ``v`` (hip descent across
    gaps of at most ``max_gap`` frames) and ``dx`` (sideways step of the body centre
    from the frame before). NULL where there is no such earlier frame."""
    rows = with_halo(timelines, "frame_idx", chunk, before=max_gap + 1)
    earlier = chunk_window(TRACK, "frame_idx").rowsBetween(-(max_gap + 1), -1)
    hip = F.last(F.when(F.col("hy").isNotNull(), F.struct("frame_idx", "hy")), ignorenulls=True).over(earlier)
    body = F.last(F.when(F.col("cx").isNotNull(), F.struct("frame_idx", "cx")), ignorenulls=True).over(earlier)
    rows = core_rows(rows.withColumns({"_h": hip, "_b": body}))
    drop, gap = F.col("hy") - F.col("_h.hy"), F.col("frame_idx") - F.col("_h.frame_idx")
    side = F.when(F.col("frame_idx") - F.col("_b.frame_idx") == 1, F.abs(F.col("cx") - F.col("_b.cx")))
    return rows.withColumns(
        {"v_strict": F.when(gap == 1, drop), "v": F.when(gap - 1 <= max_gap, drop), "dx": side}
    ).drop("_h", "_b")


def max_streak_above(motion: DataFrame, value: Column, threshold: float, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Longest run of consecutive frames with ``value`` above the threshold, per track."""
    longest = (
        runs(motion.select(*TRACK, "frame_idx", value.alias("_x")), TRACK, "frame_idx", F.col("_x") > dbl(threshold), chunk)
        .groupBy(*TRACK)
        .agg(F.max("run_len").alias("streak"))
    )
    return motion.select(*TRACK).distinct().join(longest, list(TRACK), "left").fillna(0, ["streak"])


def timeline_stats(
    motion: DataFrame, sequences: DataFrame, fps: float = 30.0, lim: MotionLimits = LIMITS, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Everything the person-level rules need, in one aggregate per track.

    Velocities are scaled to thirtieths of a second before thresholds apply.
    """
    scale = max(fps, 1.0) / 30.0
    rows = with_length(motion, sequences, "frame_idx", chunk)
    f, n, cy = F.col("frame_idx"), F.col("n_frames"), F.col("cy")
    v = F.col("v") * dbl(scale)
    early = F.when(n > lim.exit_window, (f >= n - lim.exit_window) & (f < n - lim.exit_window // 2)).otherwise(
        f < lim.exit_window // 2
    )
    stats = rows.groupBy(*TRACK).agg(
        F.max("n_frames").alias("n_frames"),
        F.count(F.lit(1)).alias("n_valid"),
        *_mean("last", f >= n - lim.last, cy),
        *_mean("first", f < lim.first, cy),
        *_mean("extended", f < lim.first_extended, cy),
        *_mean("standing", f >= n - lim.standing_last, cy),
        *_mean("early", early, cy),
        *_mean("late", f >= n - lim.exit_window // 2, cy),
        F.coalesce(F.sum(F.when(f > n - lim.exit_window, F.col("dx"))), dbl(0)).alias("exit_dx"),
        F.coalesce(F.max(F.when(v > dbl(lim.velocity_floor), v)), dbl(0)).alias("max_v"),
        F.coalesce(F.sum(F.when(v > 0, v)), dbl(0)).alias("descent"),
        F.max_by("frame_idx", F.when(v.isNotNull(), F.struct(v, -f))).alias("peak_frame"),
        F.coalesce(F.avg(F.when(F.col("torso") > dbl(0.01), F.col("torso"))), dbl(lim.default_torso)).alias("torso_norm"),
        F.coalesce(F.max("tilt"), dbl(0)).alias("max_tilt"),
        F.when(F.count("dx") >= lim.slide_dx_min, F.max("dx")).otherwise(dbl(0)).alias("max_dx"),
        F.coalesce(
            F.max_by("cy", F.when(cy.isNotNull(), f)) - F.min_by("cy", F.when(cy.isNotNull(), f)), dbl(0)
        ).alias("net_descent"),
        (F.count("lhy") + F.count("rhy")).alias("n_hip"),
        (F.greatest(F.max("lhy"), F.max("rhy")) - F.least(F.min("lhy"), F.min("rhy"))).alias("hip_range"),
        F.avg("hy").alias("mean_hip_y"),
    )
    streaks = runs(
        motion.select(*TRACK, "frame_idx", v.alias("_v")), TRACK, "frame_idx", F.col("_v") > dbl(lim.streak_floor), chunk
    ).groupBy(*TRACK).agg(F.max("run_len").alias("streak"))
    out = stats.join(streaks, list(TRACK), "left").fillna(0, ["streak"])
    recumbent = (F.col("last_n") >= lim.last_min) & (F.col("last_y") > dbl(lim.recumbent_y))
    initially = F.when(F.col("first_n") >= lim.first_min, F.col("first_y") > dbl(lim.initial_y)).when(
        F.col("extended_n") >= lim.first_min, F.col("extended_y") > dbl(lim.initial_y)
    )
    return out.withColumns(
        {"recumbent": F.coalesce(recumbent, F.lit(False)), "initially_recumbent": F.coalesce(initially, F.lit(False))}
    ).withColumn("role", _role(lim))


def _mean(name: str, cond: Column, y: Column) -> list[Column]:
    inside = F.when(cond, y)
    return [F.avg(inside).alias(f"{name}_y"), F.count(inside).alias(f"{name}_n")]


def _role(lim: MotionLimits) -> Column:
    standing = (F.col("standing_n") >= lim.role_min) & (F.col("standing_y") < dbl(lim.standing_y))
    return (
        F.when(F.col("n_valid") < lim.role_min, "unknown")
        .when(F.col("recumbent"), "recumbent")
        .when(F.coalesce(standing, F.lit(False)), "standing")
        .otherwise("transitioning")
    )


def pose_at(scalars: DataFrame, wanted: DataFrame) -> DataFrame:
    """First pose of the asked ``(seq_id, frame_idx, track_id)``; NULL columns if absent."""
    body = [c for c in scalars.columns if c not in (*TRACK, "frame_idx")]
    first = scalars.groupBy(*TRACK, "frame_idx").agg(F.min_by(F.struct(*body), "pose_idx").alias("_p"))
    return wanted.join(first, [*TRACK, "frame_idx"], "left").select(*wanted.columns, "_p.*")


def dominant_track(assigned: DataFrame, start: Column, end: Column) -> DataFrame:
    """Most frequent track in [start, end) per sequence; ties go to the first seen."""
    inside = assigned.filter((F.col("frame_idx") >= start) & (F.col("frame_idx") < end) & F.col("track_id").isNotNull())
    counts = inside.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"), F.min("frame_idx").alias("_f"))
    return counts.groupBy("seq_id").agg(F.max_by("track_id", F.struct(F.col("_n"), -F.col("_f"))).alias("track_id"))


def select_ground_person(
    scalars: DataFrame, opening: int = 60, around: int = 5, min_vis: float = VISIBLE, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """The person nearest the floor per frame.

    Faint poses are dropped, then frames with no two usable neighbouring frames
    nearby. Without tracking the lowest pose is taken. With tracking the dominant
    track (lowest on average among the winners of the opening frames) is taken where
    present, else the lowest pose.
    """
    tracked = scalars.groupBy("seq_id").agg(F.bool_or(F.col("track_id").isNotNull()).alias("_tracked"))
    usable = scalars.filter(F.col("mean_vis") >= dbl(min_vis))
    frames = with_halo(usable.select("seq_id", "frame_idx").distinct(), "frame_idx", chunk, before=around + 1, after=around)
    w = chunk_window(["seq_id"], "frame_idx")
    frames = frames.withColumn("_pair", (F.col("frame_idx") - F.lag("frame_idx").over(w)) == 1)
    near = F.max(F.coalesce("_pair", F.lit(False))).over(w.rangeBetween(-(around - 1), around))
    kept = core_rows(frames.withColumn("_ok", near)).filter("_ok").select("seq_id", "frame_idx")
    good = usable.join(kept, ["seq_id", "frame_idx"], "left_semi")
    lowest = F.max_by(F.struct("pose_idx", "track_id", "mean_y"), F.struct(F.col("mean_y"), -F.col("pose_idx")))
    winners = good.filter(F.col("frame_idx") < opening).groupBy("seq_id", "frame_idx").agg(lowest.alias("_w"))
    means = (
        winners.filter(F.col("_w.track_id").isNotNull())
        .groupBy("seq_id", F.col("_w.track_id").alias("track_id"))
        .agg(F.avg("_w.mean_y").alias("_y"), F.min("frame_idx").alias("_f"))
    )
    dominant = means.groupBy("seq_id").agg(F.max_by("track_id", F.struct(F.col("_y"), -F.col("_f"))).alias("_dominant"))
    context = tracked.join(dominant, "seq_id", "left")
    own = F.col("_tracked") & F.col("track_id").eqNullSafe(F.col("_dominant"))
    chosen = (
        good.join(context, "seq_id")
        .groupBy("seq_id", "frame_idx")
        .agg(
            lowest.alias("_low"),
            F.min(F.when(own, F.struct("pose_idx", "track_id", "mean_y"))).alias("_own"),
        )
    )
    return chosen.select("seq_id", "frame_idx", F.coalesce("_own", "_low").alias("_c")).select(
        "seq_id", "frame_idx", "_c.pose_idx", "_c.track_id", "_c.mean_y"
    )


def fall_with_persistence(
    windows: DataFrame, timelines: DataFrame, threshold: float, persistence: int, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Verdict per track: ``fall`` at the first run of enough consecutive windows above
    the amplitude threshold, with the frame where that run starts."""
    placed = dense_index(
        windows.select(*TRACK, "k", "start_frame", "amplitude"), TRACK, ["k"], F.floor(F.col("k") / chunk).cast("long"), "_i"
    )
    found = runs(placed, TRACK, "_i", F.col("amplitude") > dbl(threshold), chunk, [F.min("start_frame").alias("_s")])
    first = found.filter(F.col("run_len") >= persistence).groupBy(*TRACK).agg(F.min("_s").alias("fall_frame"))
    seen = windows.select(*TRACK).distinct().withColumn("_seen", F.lit(True))
    out = timelines.select(*TRACK).distinct().join(seen, list(TRACK), "left").join(first, list(TRACK), "left")
    verdict = F.when(F.col("_seen").isNull(), "insufficient_data").when(F.col("fall_frame").isNotNull(), "fall").otherwise("adl")
    return out.select(*TRACK, verdict.alias("verdict"), "fall_frame")


def fall_any(windows: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Verdict per sequence: ``fall`` if any window is above the threshold."""
    hit = windows.groupBy("seq_id").agg(F.bool_or(F.col("amplitude") > dbl(threshold)).alias("_h"))
    verdict = F.when(F.col("_h").isNull(), "insufficient_data").when(F.col("_h"), "fall").otherwise("adl")
    return sequences.join(hit, "seq_id", "left").select("seq_id", verdict.alias("verdict"))


def _persistent(
    rows: DataFrame, keys: Sequence[str], cond: Column, worst, persistence: int, whole_run: bool, chunk: int
) -> DataFrame:
    """Unbroken runs of at least ``persistence`` frames with their worst value, taken
    over the first ``persistence`` frames (when the finding is raised) or the run."""
    marked = mark_runs(rows, keys, "frame_idx", cond, chunk)
    inside = F.lit(True) if whole_run else F.col("frame_idx") < F.col("run_start") + persistence
    out = marked.groupBy(*keys, "run_start").agg(
        F.count(F.lit(1)).alias("_n"), worst(F.when(inside, F.col("_a"))).alias("worst")
    )
    n = F.col("_n") if whole_run else F.lit(persistence)
    return out.filter(F.col("_n") >= persistence).withColumn("n_frames_seen", n.cast("long"))


def postural_deviations(
    timelines: DataFrame,
    targets: Sequence[tuple[str, float, float]],
    persistence: int,
    fps: float,
    whole_run: bool = False,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Joints bent below their minimum for long enough; ``targets`` are (limb, minimum
    angle, target angle)."""
    each = F.array(
        *[F.struct(F.lit(j).alias("joint"), F.col(j).alias("_a"), dbl(lo).alias("_lo"), dbl(t).alias("_t")) for j, lo, t in targets]
    )
    rows = timelines.select(*TRACK, "frame_idx", F.inline(each))
    found = _persistent(rows, [*TRACK, "joint", "_lo", "_t"], F.col("_a") < F.col("_lo"), F.min, persistence, whole_run, chunk)
    score = F.greatest(dbl(0), F.least(dbl(1), dbl(1) - F.col("worst") / F.col("_t")))
    return found.select(
        *TRACK,
        F.lit("postural_deviation").alias("finding"),
        "joint",
        exact_round(F.col("worst"), 1).alias("measured"),
        F.col("_lo").alias("expected"),
        exact_round(F.col("n_frames_seen") / dbl(max(fps, 1.0)), 1).alias("duration_s"),
        F.col("run_start").alias("frame_idx"),
        exact_round(score, 3).alias("score"),
    )


def tilt_findings(
    timelines: DataFrame, max_angle: float, persistence: int, fps: float, whole_run: bool = False, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Trunk tilted beyond the maximum for long enough."""
    rows = timelines.select(*TRACK, "frame_idx", F.col("tilt").alias("_a"))
    found = _persistent(rows, TRACK, F.col("_a") > dbl(max_angle), F.max, persistence, whole_run, chunk)
    return found.select(
        *TRACK,
        F.lit("trunk_tilt").alias("finding"),
        F.lit(None).cast("string").alias("joint"),
        exact_round(F.col("worst"), 1).alias("measured"),
        dbl(max_angle).alias("expected"),
        exact_round(F.col("n_frames_seen") / dbl(max(fps, 1.0)), 1).alias("duration_s"),
        F.col("run_start").alias("frame_idx"),
        exact_round(F.least(dbl(1), F.col("worst") / dbl(2.0 * max_angle)), 3).alias("score"),
    )


def seizure_finding(
    timelines: DataFrame,
    sequences: DataFrame,
    fps: float,
    window: int = 60,
    min_std: float = 0.05,
    persistence: int = 30,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Sustained trembling of the limbs: at most one finding per track.

    Every frame of the sequence counts, so absent frames are filled in first, chunk
    by chunk. The spread of the angle steps is taken over the last ``window`` frames.
    """
    limbs = list(LIMBS)
    tracks = timelines.select(*TRACK).distinct().join(sequences.select("seq_id", "n_frames"), "seq_id")
    last = F.floor((F.col("n_frames") - 1) / chunk).cast("long")
    cuts = tracks.filter(F.col("n_frames") >= window).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    until = F.least(F.col("n_frames") - 1, F.col("_c") * chunk + (chunk - 1))
    slots = cuts.select(*TRACK, F.explode(F.sequence(F.col("_c") * chunk, until)).alias("frame_idx"))
    dense = slots.join(timelines.select(*TRACK, "frame_idx", *limbs), [*TRACK, "frame_idx"], "left")
    rows = with_halo(dense, "frame_idx", chunk, before=window)
    w = chunk_window(TRACK, "frame_idx")
    rows = rows.withColumns({f"_s_{j}": F.abs(F.col(j) - F.lag(j).over(w)) for j in limbs})
    spread = w.rowsBetween(-(window - 2), 0)
    rows = core_rows(rows.withColumns({f"_d_{j}": F.stddev_pop(f"_s_{j}").over(spread) for j in limbs}))
    total, n = dbl(0), F.lit(0)
    for j in limbs:
        total = total + F.coalesce(f"_d_{j}", dbl(0))
        n = n + F.when(F.col(f"_d_{j}").isNotNull(), 1).otherwise(0)
    rows = rows.filter(F.col("frame_idx") >= window - 1).select(
        *TRACK, "frame_idx", F.coalesce(F.try_divide(total, n.cast("double")), dbl(0)).alias("_a")
    )
    found = _persistent(rows, TRACK, F.col("_a") > dbl(min_std), F.max, persistence, False, chunk)
    first = found.groupBy(*TRACK).agg(F.min_by(F.struct("run_start", "worst"), "run_start").alias("_f"))
    return first.select(
        *TRACK,
        F.lit("seizure").alias("finding"),
        F.lit(None).cast("string").alias("joint"),
        exact_round(F.col("_f.worst"), 4).alias("measured"),
        dbl(min_std).alias("expected"),
        exact_round(dbl(persistence / max(fps, 1.0)), 1).alias("duration_s"),
        F.col("_f.run_start").alias("frame_idx"),
        exact_round(F.least(dbl(1), F.col("_f.worst") / dbl(min_std * 2)), 3).alias("score"),
    )


def agitation_finding(
    timelines: DataFrame, sequences: DataFrame, fps: float, lim: MotionLimits = LIMITS, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Frequent changes of mean height between neighbouring blocks of frames."""
    block = F.floor(F.col("frame_idx") / lim.block).cast("long")
    means = (
        timelines.filter(F.col("cy").isNotNull())
        .groupBy(*TRACK, block.alias("block"))
        .agg(F.avg("cy").alias("_y"))
    )
    rows = with_halo(means, "block", chunk, before=1)
    before = F.lag(F.struct("block", "_y")).over(chunk_window(TRACK, "block"))
    rows = core_rows(rows.withColumn("_b", before))
    moved = (F.col("block") - F.col("_b.block") == 1) & (F.abs(F.col("_y") - F.col("_b._y")) > dbl(lim.block_shift))
    changes = rows.groupBy(*TRACK).agg(count_where(moved).alias("_n"))
    seconds = F.col("n_frames") / dbl(max(fps, 1.0))
    rate = F.col("_n") / (seconds / dbl(60))
    out = changes.join(sequences.select("seq_id", "n_frames"), "seq_id").filter(F.col("n_frames") >= lim.min_frames)
    return out.filter(rate > dbl(lim.changes_per_minute)).select(
        *TRACK,
        F.lit("agitation").alias("finding"),
        F.lit(None).cast("string").alias("joint"),
        exact_round(rate, 1).alias("measured"),
        dbl(lim.changes_per_minute).alias("expected"),
        exact_round(seconds, 1).alias("duration_s"),
        F.lit(0).cast("long").alias("frame_idx"),
        exact_round(F.least(dbl(1), rate / dbl(lim.changes_per_minute * 2)), 3).alias("score"),
    )


def bed_exit_finding(stats: DataFrame, fps: float, lim: MotionLimits = LIMITS) -> DataFrame:
    """A lying person who rises and moves sideways in the last frames."""
    dy = F.col("late_y") - F.col("early_y")
    enough = (F.col("early_n") >= lim.exit_min) & (F.col("late_n") >= lim.exit_min)
    hit = (
        (F.col("n_frames") >= lim.min_frames)
        & F.col("recumbent")
        & enough
        & (dy < dbl(-lim.exit_dy))
        & (F.col("exit_dx") > dbl(lim.exit_dx))
    )
    return stats.filter(hit).select(
        *TRACK,
        F.lit("bed_exit").alias("finding"),
        F.lit(None).cast("string").alias("joint"),
        exact_round(F.abs(dy), 3).alias("measured"),
        dbl(lim.exit_dy).alias("expected"),
        exact_round(dbl(lim.exit_window / max(fps, 1.0)), 1).alias("duration_s"),
        F.greatest(F.lit(0).cast("long"), F.col("n_frames") - lim.exit_window).alias("frame_idx"),
        exact_round(F.least(dbl(1), F.abs(dy) / dbl(lim.exit_dy * 2)), 3).alias("score"),
    )


def people_count(stats: DataFrame, lim: MotionLimits = LIMITS) -> DataFrame:
    """Tracks that cover enough of their sequence, per sequence."""
    real = F.col("n_valid") / F.col("n_frames") >= dbl(lim.min_coverage)
    return stats.groupBy("seq_id").agg(count_where(real).alias("n_people"))


def validate_fall(stats: DataFrame, people: DataFrame, lim: MotionLimits = LIMITS) -> DataFrame:
    """Dynamic check per sequence: the track with the strongest descent, and whether it
    is a fall. Descents are in torso heights; a sideways slide counts as well. Several
    people in view raise the limits."""
    many = F.col("n_people") > 1
    pick = lambda one, more: F.when(many, dbl(more)).otherwise(dbl(one))
    norm = F.greatest(F.col("torso_norm"), dbl(lim.min_torso))
    v = F.least(F.col("max_v") / norm, dbl(lim.velocity_cap))
    total = F.least(F.col("descent") / norm, dbl(lim.descent_cap))
    judged = stats.join(people, "seq_id").withColumns(
        {
            "_v": v,
            "_drop": (v >= pick(lim.velocity_single, lim.velocity_multi))
            & (total >= pick(lim.descent_single, lim.descent_multi))
            & (F.col("max_tilt") >= pick(lim.tilt_single, lim.tilt_multi)),
        }
    )
    slide = (
        (F.col("streak") >= 2)
        & (F.col("net_descent") >= dbl(lim.slide_net))
        & (F.col("max_dx") > dbl(lim.slide_dx))
        & (F.col("_v") > dbl(lim.slide_v))
    )
    score = F.when(~F.col("initially_recumbent"), F.when(F.col("_drop"), F.col("_v")).when(slide, (F.col("max_dx") + F.col("_v")) / dbl(2)))
    judged = judged.withColumn("_score", score)
    best = F.max_by(
        F.struct("track_id", "peak_frame", "_score", F.col("_drop").alias("dropped"), "max_tilt"),
        F.when(F.col("_score").isNotNull(), F.struct(F.col("_score"), -F.col("track_id"))),
    )
    out = judged.groupBy("seq_id").agg(best.alias("_b"), F.max("n_people").alias("n_people"))
    top = F.coalesce("_b._score", dbl(0))
    fell = top >= pick(lim.velocity_single, lim.velocity_multi)
    return out.select(
        "seq_id",
        F.when(fell, "fall").otherwise("adl").alias("verdict"),
        exact_round(top, 3).alias("velocity_score"),
        F.when(fell, F.col("_b.track_id")).alias("track_id"),
        F.when(fell, F.col("_b.peak_frame")).alias("peak_frame"),
        F.when(fell, F.when(F.col("_b.dropped"), "drop").otherwise("slide")).alias("manner"),
    )


def validate_fall_untracked(first_pose_stats: DataFrame, people: DataFrame, lim: MotionLimits = LIMITS) -> DataFrame:
    """The same check for sequences without tracking, on the timeline of each frame's
    first pose, without torso normalisation and slide path."""
    many = F.col("n_people") > 1
    pick = lambda one, more: F.when(many, dbl(more)).otherwise(dbl(one))
    fell = (
        ~F.col("initially_recumbent")
        & (F.col("max_v") >= pick(lim.velocity_single, lim.velocity_multi))
        & (F.col("descent") >= pick(lim.descent_single, lim.descent_multi))
        & (F.col("max_tilt") >= pick(lim.tilt_single, lim.tilt_multi))
    )
    return first_pose_stats.join(people, "seq_id").select(
        "seq_id",
        F.when(fell, "fall").otherwise("adl").alias("verdict"),
        exact_round(F.when(fell, F.col("max_v")).otherwise(dbl(0)), 3).alias("velocity_score"),
        F.when(fell, F.col("peak_frame")).alias("peak_frame"),
    )


def first_pose_timelines(scalars: DataFrame) -> DataFrame:
    """Timeline of each frame's first pose, for sequences in which nobody is tracked."""
    untracked = (
        scalars.groupBy("seq_id").agg(F.bool_or(F.col("track_id").isNotNull()).alias("_t")).filter(~F.col("_t")).select("seq_id")
    )
    body = [c for c in scalars.columns if c not in ("seq_id", "track_id", "frame_idx")]
    first = scalars.join(untracked, "seq_id", "left_semi").groupBy("seq_id", "frame_idx").agg(
        F.min_by(F.struct(*body), "pose_idx").alias("_p")
    )
    return first.select("seq_id", F.lit(-1).cast("long").alias("track_id"), "frame_idx", "_p.*")


def analyze_sequence(
    motion: DataFrame, sequences: DataFrame, fps: float = 30.0, lim: MotionLimits = LIMITS, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """All findings per sequence: one validated fall, and agitation and bed exit of
    lying people. Tracks that hardly appear are left out.

    The per-pose numbers and the per-track statistics are written once, because the
    window, streak, block and fall rules all read them.
    """
    motion, sequences = written(motion), written(sequences)
    stats = written(timeline_stats(motion, sequences, fps, lim, chunk))
    people = people_count(stats, lim)
    real = stats.filter(F.col("n_valid") / F.col("n_frames") >= dbl(lim.min_coverage))
    windows = movement_windows(motion, sequences, lim.fall_window, lim.fall_stride)
    staged = fall_with_persistence(windows, motion, lim.fall_amplitude, lim.fall_persistence, chunk)
    joined = real.join(staged, list(TRACK))
    by_amplitude = F.col("verdict") == "fall"
    by_descent = (
        (F.col("streak") >= 2)
        & (F.col("max_v") >= dbl(lim.velocity_multi))
        & (F.col("descent") >= dbl(lim.descent_multi))
        & (F.col("net_descent") >= dbl(lim.slide_net))
        & F.col("recumbent")
    )
    static = (F.col("n_hip") >= lim.static_min) & (F.col("hip_range") < dbl(lim.static_range))
    fires = ~F.col("initially_recumbent") & (by_amplitude | by_descent) & ~F.coalesce(static, F.lit(False))
    triggered = joined.filter(fires).groupBy("seq_id").agg(F.bool_or(by_amplitude).alias("_amplitude"))
    fall = validate_fall(stats, people, lim).filter("verdict = 'fall'").join(triggered, "seq_id")
    falls = fall.select(
        "seq_id",
        "track_id",
        F.lit("fall_detected").alias("finding"),
        F.lit(None).cast("string").alias("joint"),
        F.col("velocity_score").alias("measured"),
        dbl(0.10).alias("expected"),
        dbl(0).alias("duration_s"),
        F.coalesce("peak_frame", F.lit(0)).alias("frame_idx"),
        exact_round(F.least(dbl(1), F.col("velocity_score") / dbl(lim.full_score_velocity)), 3).alias("score"),
    )
    lying = real.filter(F.col("role") == "recumbent")
    restless = agitation_finding(motion, sequences, fps, lim, chunk).join(lying.select(*TRACK), list(TRACK), "left_semi")
    return falls.unionByName(restless).unionByName(bed_exit_finding(lying, fps, lim))


def summarise_findings(findings: DataFrame) -> DataFrame:
    """One row per sequence: worst angle and summed duration per joint, one tilt line,
    best score; a fall contributes at least 0.80."""
    kind = F.col("finding")
    joints = (
        findings.filter(kind == "postural_deviation")
        .groupBy("seq_id", F.coalesce("joint", F.lit("unknown")).alias("joint"))
        .agg(
            F.min_by(F.struct("measured", "expected", "score"), F.struct("measured", "frame_idx")).alias("_w"),
            F.sum("duration_s").alias("_d"),
        )
        .withColumn("_n", F.greatest(F.lit(1).cast("long"), F.floor(F.round(F.col("_d") * 30, 6)).cast("long")))
        .select(
            "seq_id",
            F.concat(
                F.lit("Limited flexion of "), F.col("joint"), F.lit(" (smallest angle "), fixed(F.col("_w.measured"), 0),
                F.lit("°, expected above "), fixed(F.col("_w.expected"), 0), F.lit("°) in "), F.col("_n").cast("string"), F.lit(" frames"),
            ).alias("_line"),
            F.col("_w.score").alias("_score"),
            F.concat(F.lit("2"), F.col("joint")).alias("_at"),
        )
    )
    single = F.max_by(F.struct("measured", "duration_s", "score"), F.struct("measured", -F.col("frame_idx")))
    others = findings.filter(kind != "postural_deviation").groupBy("seq_id", "finding").agg(
        single.alias("_w"), F.max("score").alias("_m")
    )
    text = (
        F.when(kind == "fall_detected", "Fall detected")
        .when(kind == "trunk_tilt", "Sustained trunk tilt during the exercise")
        .when(kind == "agitation", F.concat(F.lit("Agitation ("), fixed(F.col("_w.measured"), 0), F.lit(" changes/min)")))
        .when(kind == "seizure", F.concat(F.lit("Seizure (std="), fixed(F.col("_w.measured"), 4), F.lit(")")))
        .otherwise(F.concat(F.lit("Bed exit (rise="), fixed(F.col("_w.measured"), 3), F.lit(")")))
    )
    rank = F.when(kind == "fall_detected", "0").when(kind == "trunk_tilt", "3").otherwise(F.concat(F.lit("1"), kind))
    rest = others.select(
        "seq_id",
        text.alias("_line"),
        F.when(kind == "fall_detected", F.greatest(F.col("_m"), dbl(0.80))).when(kind == "trunk_tilt", F.col("_w.score")).otherwise(F.col("_m")).alias("_score"),
        rank.alias("_at"),
    )
    lines = joints.unionByName(rest).groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("_l"), exact_round(F.max("_score"), 3).alias("score")
    )
    return lines.select("seq_id", F.concat(F.array_join("_l._line", " | "), F.lit(".")).alias("summary"), "score")


def physio_findings(timelines: DataFrame, sequences: DataFrame, fps: float = 30.0, min_angles: int = 10) -> DataFrame:
    """Left-right asymmetry, small range of motion and limited flexion of the limbs."""
    stats = timelines.groupBy(*TRACK).agg(
        *[g(j).alias(f"{j}_{tag}") for j in LIMBS for tag, g in [("lo", F.min), ("hi", F.max), ("avg", F.avg), ("n", F.count)]]
    )
    f = max(fps, 1.0)
    made = []
    for part in ["knee", "elbow"]:
        left, right = f"{part}_left", f"{part}_right"
        both = (F.col(f"{left}_n") >= min_angles) & (F.col(f"{right}_n") >= min_angles)
        gap = F.abs(F.col(f"{left}_avg") - F.col(f"{right}_avg"))
        made.append(_physio(both & (gap > 20), "asymmetric_movement", f"{left}/{right}", gap, 20.0, F.col(f"{left}_n") / dbl(f), F.least(dbl(1), gap / dbl(60))))
        for name in [left, right]:
            rom, low, n = F.col(f"{name}_hi") - F.col(f"{name}_lo"), F.col(f"{name}_lo"), F.col(f"{name}_n") / dbl(f)
            slack = F.greatest(dbl(0), F.least(dbl(1), dbl(1) - rom / dbl(30)))
            made.append(_physio(both & (rom < 30), "reduced_range_of_motion", name, rom, 30.0, n, slack))
            made.append(_physio(both & (low > 90), "limited_flexion", name, low, 90.0, n, F.least(dbl(1), (low - dbl(90)) / dbl(90))))
    listed = F.array_compact(F.array(*made))
    out = stats.join(sequences.select("seq_id", "n_frames"), "seq_id")
    return out.select(*TRACK, F.floor(F.col("n_frames") / 2).cast("long").alias("frame_idx"), F.inline(listed))


def _physio(cond: Column, kind: str, joint: str, measured: Column, expected: float, duration: Column, score: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(kind).alias("finding"),
            F.lit(joint).alias("joint"),
            exact_round(measured, 1).alias("measured"),
            dbl(expected).alias("expected"),
            exact_round(duration, 1).alias("duration_s"),
            exact_round(score, 3).alias("score"),
        ),
    )


def main_person(timelines: DataFrame) -> DataFrame:
    """Track with the lowest mean hip position in the image, per sequence."""
    means = timelines.groupBy(*TRACK).agg(F.coalesce(F.avg("hy"), dbl(0)).alias("_y"))
    return means.groupBy("seq_id").agg(F.max_by("track_id", F.struct(F.col("_y"), -F.col("track_id"))).alias("track_id"))


def evidence_frame(findings: DataFrame, scalars: DataFrame, reach: int = 60) -> DataFrame:
    """Frame to show for a finding ``(finding_id, seq_id, track_id, peak_frame)``: the
    lowest pose of its track within ``reach`` frames of the peak, the first on ties;
    otherwise the first pose of the peak frame."""
    spans = findings.select(
        "finding_id", "seq_id", F.col("track_id").alias("_t"), F.col("peak_frame").alias("_from"), (F.col("peak_frame") + reach).alias("_to")
    )
    tracked = track_timelines(scalars).select("seq_id", "track_id", "frame_idx", "pose_idx", "mean_y")
    near = interval_join(tracked, spans, ["seq_id"], "frame_idx", "_from", "_to", reach).filter(F.col("track_id") == F.col("_t"))
    best = near.groupBy("finding_id").agg(
        F.max_by(F.struct("frame_idx", "pose_idx"), F.struct(F.col("mean_y"), -F.col("frame_idx"))).alias("_b")
    )
    first = scalars.groupBy("seq_id", F.col("frame_idx").alias("peak_frame")).agg(F.min("pose_idx").alias("_first"))
    out = findings.join(best, "finding_id", "left").join(first, ["seq_id", "peak_frame"], "left")
    return out.select(
        "finding_id",
        "seq_id",
        F.coalesce("_b.frame_idx", F.when(F.col("_first").isNotNull(), F.col("peak_frame"))).alias("frame_idx"),
        F.coalesce("_b.pose_idx", "_first").alias("pose_idx"),
    )


def fall_metrics(verdicts: DataFrame, sequences: DataFrame) -> DataFrame:
    judged = verdicts.filter("verdict <> 'insufficient_data'").join(sequences.select("seq_id", "label"), "seq_id")
    return binary_metrics(judged, F.col("label") == "fall", F.col("verdict") == "fall")


def track_diagnostics(
    motion: DataFrame, sequences: DataFrame, fps: float = 30.0, lim: MotionLimits = LIMITS, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Per track: coverage, torso, hip height, velocities raw, scaled and normalised,
    tilt, recumbency flags, streak and displacement. Tracks under 3 frames are dropped."""
    scale = fps / 30.0
    motion, sequences = written(motion), written(sequences)
    base = timeline_stats(motion, sequences, fps, lim, chunk).select(*TRACK, "n_frames", "n_valid", "recumbent", "initially_recumbent")
    f, hy, v = F.col("frame_idx"), F.col("hy"), F.col("v")
    extra = motion.groupBy(*TRACK).agg(
        F.coalesce(F.avg("torso"), dbl(0)).alias("_torso"),
        F.min_by("hy", F.when(hy.isNotNull(), f)).alias("hip_y_first"),
        F.max_by("hy", F.when(hy.isNotNull(), f)).alias("hip_y_last"),
        F.coalesce(F.max("hy") - F.min("hy"), dbl(0)).alias("hip_y_amplitude"),
        F.coalesce(F.max("v"), dbl(0)).alias("v_max_raw"),
        F.coalesce(F.avg("v"), dbl(0)).alias("v_mean"),
        F.coalesce(F.max("tilt"), dbl(0)).alias("tilt_max"),
        F.count("tilt").alias("_n_tilt"),
        F.coalesce(F.sum(F.when(v > 0, v)), dbl(0)).alias("descent"),
    )
    # the streak is over the velocities that exist, so frames without one do not break it
    listed = dense_index(
        motion.filter(v.isNotNull()).select(*TRACK, "frame_idx", "v"), TRACK, ["frame_idx"], F.floor(f / chunk).cast("long"), "_i"
    )
    streak = runs(listed, TRACK, "_i", F.col("v") > dbl(lim.streak_floor), chunk).groupBy(*TRACK).agg(F.max("run_len").alias("streak"))
    p90 = nth_smallest(motion.select(*TRACK, "tilt"), TRACK, "tilt", 0.9)
    out = base.filter(F.col("n_valid") >= 3).join(extra, list(TRACK)).join(streak, list(TRACK), "left").join(p90, list(TRACK), "left")
    return out.select(
        *TRACK,
        "n_valid",
        exact_round(F.col("n_valid") / F.greatest("n_frames", F.lit(1)) * dbl(100), 1).alias("coverage_pct"),
        exact_round(F.col("_torso"), 4).alias("torso_mean"),
        *[exact_round(F.col(c), 4).alias(c) for c in ["hip_y_first", "hip_y_last", "hip_y_amplitude", "v_max_raw"]],
        exact_round(F.col("v_max_raw") * dbl(scale), 4).alias("v_max_scaled"),
        exact_round(F.col("v_max_raw") / F.greatest(F.col("_torso"), dbl(0.01)), 4).alias("v_max_norm"),
        exact_round(F.col("v_mean"), 4).alias("v_mean"),
        exact_round(F.col("tilt_max"), 1).alias("tilt_max"),
        exact_round(F.when(F.col("_n_tilt") >= 10, F.col("nth")).otherwise(dbl(0)), 1).alias("tilt_p90"),
        "recumbent",
        "initially_recumbent",
        F.coalesce("streak", F.lit(0)).alias("streak"),
        exact_round(F.col("descent"), 4).alias("descent"),
        exact_round(F.col("descent") * dbl(scale), 4).alias("descent_scaled"),
    )


def nth_smallest(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Element ``int(share * n)`` of the sorted values of each key, as ``nth``."""
    return exact_quantile(df, keys, value, share, nth=True).withColumnRenamed("quantile", "nth")


# Smallest person box in pixels and as a share of the frame.
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MIN_SHARE, MIN_CONFIDENCE = 30.0, 50.0, 1500.0, 0.01, 0.35


def filter_person_boxes(boxes: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    area = F.col("w") * F.col("h")
    return boxes.filter(
        (F.col("w") >= dbl(MIN_WIDTH))
        & (F.col("h") >= dbl(MIN_HEIGHT))
        & (area >= dbl(MIN_AREA))
        & (area >= dbl(frame_w * frame_h * MIN_SHARE))
        & (F.col("confidence") >= dbl(MIN_CONFIDENCE))
    )


def subsample_frames(frames: DataFrame, max_frames: int) -> DataFrame:
    """Every n-th frame, n = total // max; the result may exceed the maximum."""
    totals = frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / max_frames).cast("long"))
    return frames.join(totals, "seq_id").filter(F.col("frame_idx") % step == 0).drop("_n")
