"""Movement operators on the bridge poses (16 landmarks, two people per frame).

The sequences are short, so the frame limits are scaled down; the defaults of the
library are the calibrated ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import motion as MO

fam = Family()
LIM = MO.MotionLimits(
    last=12, last_min=3, recumbent_y=0.5, first=8, first_min=3, first_extended=15, initial_y=0.52, role_min=3,
    standing_last=6, standing_y=0.49, min_frames=10, block=4, block_shift=0.03, changes_per_minute=30.0,
    exit_window=12, exit_min=2, exit_dy=0.02, exit_dx=0.01, fall_window=6, fall_stride=3, fall_amplitude=0.3,
    fall_persistence=2, static_min=3, slide_dx_min=2,
)
FPS = 15.0
TARGETS = [("knee_left", 60.0, 120.0), ("knee_right", 60.0, 120.0), ("elbow_left", 75.0, 150.0), ("elbow_right", 75.0, 150.0)]
J = V.JOINTS
T = "seq_id, track_id"


def scalars(spark, sf) -> DataFrame:
    return MO.pose_scalars(V.poses(spark, sf), J)


def timelines(spark, sf) -> DataFrame:
    return MO.track_timelines(scalars(spark, sf))


def motion(spark, sf) -> DataFrame:
    return MO.frame_motion(timelines(spark, sf), LIM.max_gap)


def windows(spark, sf) -> DataFrame:
    return MO.movement_windows(timelines(spark, sf), V.sequences(spark, sf), 6, 3)


def stats(spark, sf) -> DataFrame:
    return MO.timeline_stats(motion(spark, sf), V.sequences(spark, sf), FPS, LIM)


# SQL of the same things ---------------------------------------------------------
def p(joint: str, field: str) -> str:
    return f"lm[{J[joint] + 1}].{field}"


def seen(*names: str) -> str:
    return " AND ".join(f"{p(n, 'vis')} >= 0.4::DOUBLE" for n in names)


def mid(field: str, *names: str) -> str:
    return f"(({' + '.join(p(n, field) for n in names)}) / {float(len(names))}::DOUBLE)"


HIPS, SHOULDERS = ("left_hip", "right_hip"), ("left_shoulder", "right_shoulder")
UPPER = ("nose", *SHOULDERS)
CLAMP = "degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {0}))))"


def center(field: str) -> str:
    return f"CASE WHEN {seen(*HIPS)} THEN {mid(field, *HIPS)} WHEN {seen(*UPPER)} THEN {mid(field, *UPPER)} END"


def angle(a: str, b: str, c: str) -> str:
    ux, uy = f"({p(a, 'x')} - {p(b, 'x')})", f"({p(a, 'y')} - {p(b, 'y')})"
    wx, wy = f"({p(c, 'x')} - {p(b, 'x')})", f"({p(c, 'y')} - {p(b, 'y')})"
    size = f"(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({wx} * {wx} + {wy} * {wy}))"
    return f"CASE WHEN {seen(a, b, c)} AND {size} <> 0 THEN {CLAMP.format(f'({ux} * {wx} + {uy} * {wy}) / {size}')} END"


TDX, TDY = f"({mid('x', *HIPS)} - {mid('x', *SHOULDERS)})", f"({mid('y', *HIPS)} - {mid('y', *SHOULDERS)})"
TSIZE = f"sqrt({TDX} * {TDX} + {TDY} * {TDY})"
cte(
    "pf",
    f"""SELECT seq_id, frame_idx, pose_idx, track_id, list_avg(list_transform(lm, lambda q: q.vis)) AS mean_vis, list_avg(list_transform(lm, lambda q: q.y)) AS mean_y,
    CASE WHEN {seen(*HIPS)} THEN {mid('y', *HIPS)} END AS hy, {center('x')} AS cx, {center('y')} AS cy, {mid('x', *HIPS)} AS mx, {mid('y', *HIPS)} AS my,
    abs({p('left_hip', 'y')} - {p('right_hip', 'y')}) AS asymmetry, CASE WHEN {seen('left_hip')} THEN {p('left_hip', 'y')} END AS lhy,
    CASE WHEN {seen('right_hip')} THEN {p('right_hip', 'y')} END AS rhy, CASE WHEN {seen(*SHOULDERS, *HIPS)} THEN abs({TDY}) END AS torso,
    CASE WHEN {seen(*SHOULDERS, *HIPS)} AND {TSIZE} <> 0 THEN {CLAMP.format(f'{TDY} / {TSIZE}')} END AS tilt,
    {', '.join(f'{angle(*t)} AS {n}' for n, t in MO.LIMBS.items())} FROM poses""",
    "poses",
)
cte("tl", "SELECT * FROM pf WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id, track_id, frame_idx ORDER BY pose_idx DESC) = 1", "pf")
cte(
    "mo",
    """SELECT tl.*, CASE WHEN hg = 1 THEN hd END AS v_strict, CASE WHEN hg - 1 <= 5 THEN hd END AS v, CASE WHEN bg = 1 THEN bd END AS dx FROM tl
    LEFT JOIN (SELECT seq_id, track_id, frame_idx, hy - lag(hy) OVER w AS hd, frame_idx - lag(frame_idx) OVER w AS hg FROM tl WHERE hy IS NOT NULL
      WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_idx)) h USING (seq_id, track_id, frame_idx)
    LEFT JOIN (SELECT seq_id, track_id, frame_idx, abs(cx - lag(cx) OVER w) AS bd, frame_idx - lag(frame_idx) OVER w AS bg FROM tl WHERE cx IS NOT NULL
      WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_idx)) b USING (seq_id, track_id, frame_idx)""",
    "tl",
)
cte(
    "mw",
    """SELECT seq_id, track_id, k, k * 3 AS start_frame, least(k * 3 + 6, max(n_frames)) - 1 AS end_frame, avg(asymmetry) AS asymmetry,
    list({'x': mx, 'y': my} ORDER BY frame_idx) AS pts FROM tl JOIN sequences USING (seq_id) JOIN (SELECT unnest(range(0, 100000)) AS k) ON frame_idx >= k * 3 AND frame_idx < k * 3 + 6
    GROUP BY seq_id, track_id, k""",
    "tl",
    "sequences",
)
cte(
    "mwin",
    """SELECT seq_id, track_id, k, start_frame, end_frame, asymmetry,
    list_max(list_transform(pts, lambda a: list_max(list_transform(pts, lambda b: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))))) AS amplitude,
    CASE WHEN len(pts) > 1 THEN list_avg(list_transform(range(1, len(pts)), lambda i: sqrt((pts[i].x - pts[i + 1].x) * (pts[i].x - pts[i + 1].x) + (pts[i].y - pts[i + 1].y) * (pts[i].y - pts[i + 1].y)))) ELSE 0.0 END AS velocity FROM mw""",
    "mw",
)


def mean(name: str, cond: str) -> str:
    return f"avg(cy) FILTER ({cond}) AS {name}_y, count(cy) FILTER ({cond}) AS {name}_n"


cte(
    "streaks",
    """SELECT seq_id, track_id, max(n) AS streak FROM (SELECT seq_id, track_id, g, count(*) AS n FROM (
      SELECT seq_id, track_id, frame_idx - row_number() OVER (PARTITION BY seq_id, track_id ORDER BY frame_idx) AS g FROM mo WHERE v * 0.5 > 0.02::DOUBLE) GROUP BY ALL) GROUP BY 1, 2""",
    "mo",
)
cte(
    "st0",
    f"""SELECT seq_id, track_id, max(n_frames) AS n_frames, count(*) AS n_valid, {mean('last', 'frame_idx >= n_frames - 12')}, {mean('first', 'frame_idx < 8')},
    {mean('extended', 'frame_idx < 15')}, {mean('standing', 'frame_idx >= n_frames - 6')},
    {mean('early', 'CASE WHEN n_frames > 12 THEN frame_idx >= n_frames - 12 AND frame_idx < n_frames - 6 ELSE frame_idx < 6 END')}, {mean('late', 'frame_idx >= n_frames - 6')},
    coalesce(sum(dx) FILTER (frame_idx > n_frames - 12), 0.0) AS exit_dx, coalesce(max(v * 0.5) FILTER (v * 0.5 > 0.01::DOUBLE), 0.0) AS max_v,
    coalesce(sum(v * 0.5) FILTER (v > 0), 0.0) AS descent, arg_max(frame_idx, (v, -frame_idx)) FILTER (v IS NOT NULL) AS peak_frame,
    coalesce(avg(torso) FILTER (torso > 0.01::DOUBLE), 0.14) AS torso_norm, coalesce(max(tilt), 0.0) AS max_tilt,
    CASE WHEN count(dx) >= 2 THEN max(dx) ELSE 0.0 END AS max_dx,
    coalesce(arg_max(cy, frame_idx) FILTER (cy IS NOT NULL) - arg_min(cy, frame_idx) FILTER (cy IS NOT NULL), 0.0) AS net_descent,
    count(lhy) + count(rhy) AS n_hip, greatest(max(lhy), max(rhy)) - least(min(lhy), min(rhy)) AS hip_range, avg(hy) AS mean_hip_y
    FROM mo JOIN sequences USING (seq_id) GROUP BY seq_id, track_id""",
    "mo",
    "sequences",
)
cte(
    "st",
    """SELECT *, CASE WHEN n_valid < 3 THEN 'unknown' WHEN recumbent THEN 'recumbent' WHEN standing_n >= 3 AND standing_y < 0.49::DOUBLE THEN 'standing' ELSE 'transitioning' END AS role FROM (
    SELECT st0.*, coalesce(streak, 0) AS streak, coalesce(last_n >= 3 AND last_y > 0.5::DOUBLE, false) AS recumbent,
      CASE WHEN first_n >= 3 THEN first_y > 0.52::DOUBLE WHEN extended_n >= 3 THEN extended_y > 0.52::DOUBLE ELSE false END AS initially_recumbent
    FROM st0 LEFT JOIN streaks USING (seq_id, track_id))""",
    "st0",
    "streaks",
)


RAW: dict[str, tuple[str, tuple[str, ...]]] = {}


def both(name: str, sql: str, *needs: str):
    RAW[name] = (sql, needs)
    return fam.add(name, stmt(sql, *needs))


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@both("mot_body_center", "SELECT seq_id, frame_idx, pose_idx, round(cx, 6) AS cx, round(cy, 6) AS cy FROM pf", "pf")
def _center(spark, sf):
    return scalars(spark, sf).select("seq_id", "frame_idx", "pose_idx", r("cx"), r("cy"))


@both("mot_hip_mid", "SELECT seq_id, frame_idx, pose_idx, round(mx, 6) AS mx, round(my, 6) AS my, round(asymmetry, 6) AS asymmetry FROM pf", "pf")
def _hip(spark, sf):
    return scalars(spark, sf).select("seq_id", "frame_idx", "pose_idx", r("mx"), r("my"), r("asymmetry"))


@both(
    "mot_movement_windows",
    f"SELECT {T}, start_frame, end_frame, round(amplitude, 6) AS amplitude, round(velocity, 6) AS velocity, round(asymmetry, 6) AS asymmetry FROM mwin",
    "mwin",
)
def _windows(spark, sf):
    return windows(spark, sf).select("seq_id", "track_id", "start_frame", "end_frame", r("amplitude"), r("velocity"), r("asymmetry"))


LIMB_SQL = ", ".join(f"round({n}, 4) AS {n}" for n in MO.LIMBS)


@both("mot_joint_angles", f"SELECT seq_id, frame_idx, pose_idx, {LIMB_SQL} FROM pf", "pf")
def _angles(spark, sf):
    return scalars(spark, sf).select("seq_id", "frame_idx", "pose_idx", *[r(n, 4) for n in MO.LIMBS])


@both("mot_trunk_tilt", "SELECT seq_id, frame_idx, pose_idx, round(tilt, 4) AS tilt FROM pf", "pf")
def _tilt(spark, sf):
    return scalars(spark, sf).select("seq_id", "frame_idx", "pose_idx", r("tilt", 4))


@both("mot_torso_height", "SELECT seq_id, frame_idx, pose_idx, round(torso, 6) AS torso FROM pf", "pf")
def _torso(spark, sf):
    return scalars(spark, sf).select("seq_id", "frame_idx", "pose_idx", r("torso"))


@both("mot_vertical_velocity_strict", f"SELECT {T}, frame_idx, round(v_strict, 6) AS v_strict FROM mo", "mo")
def _vs(spark, sf):
    return motion(spark, sf).select("seq_id", "track_id", "frame_idx", r("v_strict"))


@both("mot_vertical_velocity_robust", f"SELECT {T}, frame_idx, round(v, 6) AS v FROM mo", "mo")
def _v(spark, sf):
    return motion(spark, sf).select("seq_id", "track_id", "frame_idx", r("v"))


@both("mot_lateral_displacement", f"SELECT {T}, frame_idx, round(dx, 6) AS dx FROM mo", "mo")
def _dx(spark, sf):
    return motion(spark, sf).select("seq_id", "track_id", "frame_idx", r("dx"))


@both("mot_descent", f"SELECT {T}, round(descent, 6) AS descent, round(max_v, 6) AS max_v FROM st", "st")
def _descent(spark, sf):
    return stats(spark, sf).select("seq_id", "track_id", r("descent"), r("max_v"))


@both("mot_max_streak_above", f"SELECT DISTINCT {T}, coalesce(streak, 0) AS streak FROM tl LEFT JOIN streaks USING (seq_id, track_id)", "tl", "streaks")
def _streak(spark, sf):
    return MO.max_streak_above(motion(spark, sf), F.col("v") * dbl(0.5), 0.02)


@both("mot_track_timelines", f"SELECT {T}, frame_idx, pose_idx, round(mean_y, 6) AS mean_y FROM tl", "tl")
def _timelines(spark, sf):
    return timelines(spark, sf).select("seq_id", "track_id", "frame_idx", "pose_idx", r("mean_y"))


@both(
    "mot_pose_at",
    f"""SELECT w.seq_id, w.frame_idx, w.track_id, f.pose_idx, round(f.mean_y, 6) AS mean_y FROM (SELECT DISTINCT seq_id, frame_idx, t AS track_id FROM pf, (VALUES (0), (1)) AS x(t)) w
    LEFT JOIN (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY {T}, frame_idx ORDER BY pose_idx) = 1) f ON f.seq_id = w.seq_id AND f.frame_idx = w.frame_idx AND f.track_id = w.track_id""",
    "pf",
)
def _pose_at(spark, sf):
    s = scalars(spark, sf)
    wanted = s.select("seq_id", "frame_idx").distinct().withColumn("track_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return MO.pose_at(s, wanted).select("seq_id", "frame_idx", "track_id", "pose_idx", r("mean_y"))


@both(
    "mot_dominant_track",
    """SELECT seq_id, arg_max(track_id, (n, -f)) AS track_id FROM (SELECT seq_id, track_id, count(*) AS n, min(frame_idx) AS f FROM pf
    WHERE frame_idx >= 3 AND frame_idx < 15 AND pose_idx = 0 AND track_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "pf",
)
def _dominant(spark, sf):
    first = scalars(spark, sf).filter("pose_idx = 0").select("seq_id", "frame_idx", "track_id")
    return MO.dominant_track(first, F.lit(3), F.lit(15))


cte(
    "ground",
    """WITH us AS (SELECT * FROM pf WHERE mean_vis >= 0.55::DOUBLE), fr AS (SELECT DISTINCT seq_id, frame_idx FROM us),
    pr AS (SELECT a.seq_id, a.frame_idx FROM fr a JOIN fr b ON a.seq_id = b.seq_id AND b.frame_idx = a.frame_idx - 1),
    keep AS (SELECT DISTINCT f.seq_id, f.frame_idx FROM fr f JOIN pr ON pr.seq_id = f.seq_id AND pr.frame_idx BETWEEN f.frame_idx - 4 AND f.frame_idx + 5),
    good AS (SELECT us.* FROM us JOIN keep USING (seq_id, frame_idx)),
    dom AS (SELECT seq_id, arg_max(track_id, (y, -f)) AS dom FROM (SELECT seq_id, track_id, avg(mean_y) AS y, min(frame_idx) AS f FROM (
        SELECT * FROM good WHERE frame_idx < 60 QUALIFY row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY mean_y DESC, pose_idx) = 1)
      WHERE track_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT seq_id, frame_idx, pose_idx, track_id, mean_y FROM good LEFT JOIN dom USING (seq_id)
    QUALIFY row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY track_id IS NOT DISTINCT FROM dom DESC, CASE WHEN track_id IS NOT DISTINCT FROM dom THEN pose_idx END, mean_y DESC, pose_idx) = 1""",
    "pf",
)


@both("mot_select_ground_person", "SELECT seq_id, frame_idx, pose_idx, track_id, round(mean_y, 6) AS mean_y FROM ground", "ground")
def _ground(spark, sf):
    return MO.select_ground_person(scalars(spark, sf), min_vis=0.55).withColumn("mean_y", F.round("mean_y", 6))


@both("mot_is_recumbent", f"SELECT {T}, recumbent FROM st", "st")
def _recumbent(spark, sf):
    return stats(spark, sf).select("seq_id", "track_id", "recumbent")


@both("mot_was_initially_recumbent", f"SELECT {T}, initially_recumbent FROM st", "st")
def _initially(spark, sf):
    return stats(spark, sf).select("seq_id", "track_id", "initially_recumbent")


@both("mot_person_role", f"SELECT {T}, role FROM st", "st")
def _role(spark, sf):
    return stats(spark, sf).select("seq_id", "track_id", "role")


cte(
    "staged",
    """SELECT t.seq_id, t.track_id, CASE WHEN w.seq_id IS NULL THEN 'insufficient_data' WHEN f.fall_frame IS NOT NULL THEN 'fall' ELSE 'adl' END AS verdict, fall_frame
    FROM (SELECT DISTINCT seq_id, track_id FROM tl) t LEFT JOIN (SELECT DISTINCT seq_id, track_id FROM mwin) w USING (seq_id, track_id)
    LEFT JOIN (SELECT seq_id, track_id, min(s) AS fall_frame FROM (SELECT seq_id, track_id, g, min(start_frame) AS s, count(*) AS n FROM (
        SELECT *, i - row_number() OVER (PARTITION BY seq_id, track_id ORDER BY i) AS g FROM (
          SELECT *, row_number() OVER (PARTITION BY seq_id, track_id ORDER BY k) AS i FROM mwin) WHERE amplitude > 0.3::DOUBLE) GROUP BY seq_id, track_id, g) WHERE n >= 2 GROUP BY 1, 2) f USING (seq_id, track_id)""",
    "tl",
    "mwin",
)


@both("mot_fall_with_persistence", f"SELECT {T}, verdict, fall_frame FROM staged", "staged")
def _persist(spark, sf):
    return MO.fall_with_persistence(windows(spark, sf), timelines(spark, sf), 0.3, 2)


cte(
    "anyfall",
    """SELECT seq_id, label, CASE WHEN h IS NULL THEN 'insufficient_data' WHEN h THEN 'fall' ELSE 'adl' END AS verdict FROM sequences
    LEFT JOIN (SELECT seq_id, bool_or(amplitude > 0.5::DOUBLE) AS h FROM mwin GROUP BY 1) USING (seq_id)""",
    "sequences",
    "mwin",
)


@both("mot_fall_any", "SELECT seq_id, verdict FROM anyfall", "anyfall")
def _any(spark, sf):
    return MO.fall_any(windows(spark, sf), V.sequences(spark, sf), 0.5)


def persistent_sql(src: str, keys: str, worst: str, n: int) -> str:
    return f"""SELECT {keys}, run_start, {worst}(a) FILTER (frame_idx < run_start + {n}) AS worst FROM (
      SELECT *, min(frame_idx) OVER (PARTITION BY {keys}, g) AS run_start FROM (
        SELECT *, frame_idx - row_number() OVER (PARTITION BY {keys} ORDER BY frame_idx) AS g FROM ({src}))) GROUP BY {keys}, run_start HAVING count(*) >= {n}"""


DEVIANT = " UNION ALL ".join(f"SELECT {T}, frame_idx, '{j}' AS joint, {j} AS a, {lo}::DOUBLE AS lo, {t}::DOUBLE AS tgt FROM tl WHERE {j} < {lo}" for j, lo, t in TARGETS)


@both(
    "mot_postural_deviations",
    f"""SELECT {T}, 'postural_deviation' AS finding, joint, printf('%.1f', worst)::DOUBLE AS measured, lo AS expected, printf('%.1f', 2 / 15.0)::DOUBLE AS duration_s, run_start AS frame_idx,
    printf('%.3f', greatest(0.0, least(1.0, 1.0 - worst / tgt)))::DOUBLE AS score FROM ({persistent_sql(DEVIANT, T + ', joint, lo, tgt', 'min', 2)})""",
    "tl",
)
def _deviations(spark, sf):
    return MO.postural_deviations(timelines(spark, sf), TARGETS, 2, FPS)


@both(
    "mot_tilt_findings",
    f"""SELECT {T}, 'trunk_tilt' AS finding, NULL::VARCHAR AS joint, printf('%.1f', worst)::DOUBLE AS measured, 60.0::DOUBLE AS expected, printf('%.1f', 2 / 15.0)::DOUBLE AS duration_s, run_start AS frame_idx,
    printf('%.3f', least(1.0, worst / 120.0))::DOUBLE AS score FROM ({persistent_sql(f'SELECT {T}, frame_idx, tilt AS a FROM tl WHERE tilt > 60', T, 'max', 2)})""",
    "tl",
)
def _tilts(spark, sf):
    return MO.tilt_findings(timelines(spark, sf), 60.0, 2, FPS)


STEPS = ", ".join(f"abs({j} - lag({j}) OVER w) AS s_{j}" for j in MO.LIMBS)
SPREAD = ", ".join(f"stddev_pop(s_{j}) OVER z AS d_{j}" for j in MO.LIMBS)
DSUM = " + ".join(f"coalesce(d_{j}, 0)" for j in MO.LIMBS)
DCNT = " + ".join(f"(d_{j} IS NOT NULL)::INT" for j in MO.LIMBS)
SEIZE = f"""SELECT {T}, frame_idx, coalesce(({DSUM}) / nullif({DCNT}, 0)::DOUBLE, 0.0) AS a FROM (
    SELECT {T}, frame_idx, {SPREAD} FROM (SELECT {T}, frame_idx, {STEPS} FROM (
      SELECT g.seq_id, g.track_id, g.frame_idx, {', '.join(MO.LIMBS)} FROM (
        SELECT seq_id, track_id, unnest(range(0, n_frames)) AS frame_idx FROM (SELECT DISTINCT seq_id, track_id FROM tl) JOIN sequences USING (seq_id) WHERE n_frames >= 8) g
      LEFT JOIN tl USING (seq_id, track_id, frame_idx)) WINDOW w AS (PARTITION BY {T} ORDER BY frame_idx))
    WINDOW z AS (PARTITION BY {T} ORDER BY frame_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE frame_idx >= 7"""


@both(
    "mot_seizure_finding",
    f"""SELECT {T}, 'seizure' AS finding, NULL::VARCHAR AS joint, printf('%.4f', worst)::DOUBLE AS measured, 0.05::DOUBLE AS expected, printf('%.1f', 3 / 15.0)::DOUBLE AS duration_s, run_start AS frame_idx,
    printf('%.3f', least(1.0, worst / 0.1))::DOUBLE AS score FROM ({persistent_sql(f'SELECT * FROM ({SEIZE}) WHERE a > 0.05', T, 'max', 3)})
    QUALIFY row_number() OVER (PARTITION BY {T} ORDER BY run_start) = 1""",
    "tl",
    "sequences",
)
def _seizure(spark, sf):
    return MO.seizure_finding(timelines(spark, sf), V.sequences(spark, sf), FPS, window=8, min_std=0.05, persistence=3)


cte(
    "restless",
    f"""SELECT {T}, n_frames, n / (n_frames / 15.0::DOUBLE / 60.0::DOUBLE) AS rate FROM (
      SELECT {T}, count(*) FILTER (b - pb = 1 AND abs(y - py) > 0.03::DOUBLE) AS n FROM (
        SELECT *, lag(b) OVER w AS pb, lag(y) OVER w AS py FROM (SELECT {T}, frame_idx // 4 AS b, avg(cy) AS y FROM tl WHERE cy IS NOT NULL GROUP BY ALL)
        WINDOW w AS (PARTITION BY {T} ORDER BY b)) GROUP BY {T}) JOIN sequences USING (seq_id) WHERE n_frames >= 10""",
    "tl",
    "sequences",
)
AGIT = f"""SELECT {T}, 'agitation' AS finding, NULL::VARCHAR AS joint, printf('%.1f', rate)::DOUBLE AS measured, 30.0::DOUBLE AS expected,
    printf('%.1f', n_frames / 15.0::DOUBLE)::DOUBLE AS duration_s, 0::BIGINT AS frame_idx, printf('%.3f', least(1.0, rate / 60.0))::DOUBLE AS score FROM restless WHERE rate > 30"""


@both("mot_agitation_finding", AGIT, "restless")
def _agitation(spark, sf):
    return MO.agitation_finding(timelines(spark, sf), V.sequences(spark, sf), FPS, LIM)


EXIT = f"""SELECT {T}, 'bed_exit' AS finding, NULL::VARCHAR AS joint, printf('%.3f', abs(late_y - early_y))::DOUBLE AS measured, 0.02::DOUBLE AS expected, printf('%.1f', 12 / 15.0)::DOUBLE AS duration_s,
    greatest(0, n_frames - 12) AS frame_idx, printf('%.3f', least(1.0, abs(late_y - early_y) / 0.04))::DOUBLE AS score FROM st
    WHERE n_frames >= 10 AND recumbent AND early_n >= 2 AND late_n >= 2 AND late_y - early_y < -0.02::DOUBLE AND exit_dx > 0.01::DOUBLE"""


@both("mot_bed_exit_finding", EXIT, "st")
def _exit(spark, sf):
    return MO.bed_exit_finding(stats(spark, sf), FPS, LIM)


cte(
    "vf",
    """SELECT seq_id, CASE WHEN top >= lim THEN 'fall' ELSE 'adl' END AS verdict, printf('%.3f', top)::DOUBLE AS velocity_score,
      CASE WHEN top >= lim THEN b.track_id END AS track_id, CASE WHEN top >= lim THEN b.peak_frame END AS peak_frame,
      CASE WHEN top >= lim THEN CASE WHEN b.dropped THEN 'drop' ELSE 'slide' END END AS manner FROM (
    SELECT seq_id, coalesce(max(score), 0.0) AS top, max(vlim) AS lim, arg_max({'track_id': track_id, 'peak_frame': peak_frame, 'dropped': dropped}, (score, -track_id)) FILTER (score IS NOT NULL) AS b FROM (
      SELECT *, CASE WHEN initially_recumbent THEN NULL WHEN dropped THEN nv WHEN streak >= 2 AND net_descent >= 0.15::DOUBLE AND max_dx > 0.05::DOUBLE AND nv > 0.05::DOUBLE THEN (max_dx + nv) / 2 END AS score FROM (
        SELECT *, nv >= vlim AND nd >= CASE WHEN n_people > 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AND max_tilt >= CASE WHEN n_people > 1 THEN 35 ELSE 25 END AS dropped FROM (
          SELECT *, least(max_v / greatest(torso_norm, 0.08::DOUBLE), 1.5) AS nv, least(descent / greatest(torso_norm, 0.08::DOUBLE), 10.0) AS nd, CASE WHEN n_people > 1 THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END AS vlim
          FROM st JOIN (SELECT seq_id, count(*) FILTER (n_valid / n_frames::DOUBLE >= 0.05::DOUBLE) AS n_people FROM st GROUP BY 1) USING (seq_id)))) GROUP BY seq_id)""",
    "st",
)


@both("mot_validate_fall", "SELECT * FROM vf", "vf")
def _validate(spark, sf):
    s = stats(spark, sf)
    return MO.validate_fall(s, MO.people_count(s, LIM), LIM)


@fam.add("mot_validate_fall_untracked")
def _validate_untracked(spark, sf):
    nobody = MO.pose_scalars(V.poses(spark, sf).withColumn("track_id", F.lit(None).cast("long")), J)
    s = MO.timeline_stats(MO.frame_motion(MO.first_pose_timelines(nobody), LIM.max_gap), V.sequences(spark, sf), FPS, LIM)
    return MO.validate_fall_untracked(s, MO.people_count(s, LIM), LIM)


@both("mot_net_descent", f"SELECT {T}, round(net_descent, 6) AS net_descent FROM st", "st")
def _net(spark, sf):
    return stats(spark, sf).select("seq_id", "track_id", r("net_descent"))


cte(
    "found",
    f"""SELECT seq_id, vf.track_id, 'fall_detected' AS finding, NULL::VARCHAR AS joint, velocity_score AS measured, 0.1::DOUBLE AS expected, 0.0::DOUBLE AS duration_s, coalesce(peak_frame, 0) AS frame_idx,
      printf('%.3f', least(1.0, velocity_score / 0.4))::DOUBLE AS score FROM vf JOIN (SELECT DISTINCT seq_id FROM st JOIN staged USING (seq_id, track_id)
      WHERE n_valid / n_frames::DOUBLE >= 0.05::DOUBLE AND NOT initially_recumbent AND NOT coalesce(n_hip >= 3 AND hip_range < 0.1::DOUBLE, false) AND (staged.verdict = 'fall' OR (streak >= 2 AND max_v >= 0.04::DOUBLE AND descent >= 0.3::DOUBLE AND net_descent >= 0.15::DOUBLE AND recumbent)))
      USING (seq_id) WHERE vf.verdict = 'fall'
    UNION ALL SELECT a.* FROM ({AGIT}) a JOIN st USING (seq_id, track_id) WHERE n_valid / n_frames::DOUBLE >= 0.05::DOUBLE AND role = 'recumbent'
    UNION ALL SELECT a.* FROM ({EXIT}) a JOIN st USING (seq_id, track_id) WHERE n_valid / n_frames::DOUBLE >= 0.05::DOUBLE AND role = 'recumbent'""",
    "vf",
    "st",
    "staged",
    "restless",
)


def found(spark, sf) -> DataFrame:
    return MO.analyze_sequence(motion(spark, sf), V.sequences(spark, sf), FPS, LIM)


@both("mot_analyze_sequence", "SELECT * FROM found", "found")
def _analyze(spark, sf):
    return found(spark, sf)


cte("devs", RAW["mot_postural_deviations"][0], *RAW["mot_postural_deviations"][1])
cte("tilts", RAW["mot_tilt_findings"][0], *RAW["mot_tilt_findings"][1])


@both(
    "mot_summarise_findings",
    """SELECT seq_id, string_agg(line, ' | ' ORDER BY rk, line) || '.' AS summary, printf('%.3f', max(score))::DOUBLE AS score FROM (
      SELECT seq_id, '2' || joint AS rk, 'Limited flexion of ' || joint || ' (smallest angle ' || printf('%.0f', w.m) || '°, expected above ' || printf('%.0f', w.e) || '°) in ' || n || ' frames' AS line, w.s AS score FROM (
        SELECT seq_id, joint, arg_min({'m': measured, 'e': expected, 's': score}, (measured, frame_idx)) AS w, greatest(1, floor(round(sum(duration_s) * 30, 6))::BIGINT) AS n FROM devs GROUP BY 1, 2)
      UNION ALL
      SELECT seq_id, CASE finding WHEN 'fall_detected' THEN '0' WHEN 'trunk_tilt' THEN '3' ELSE '1' || finding END, CASE finding WHEN 'fall_detected' THEN 'Fall detected'
        WHEN 'trunk_tilt' THEN 'Sustained trunk tilt during the exercise' WHEN 'agitation' THEN 'Agitation (' || printf('%.0f', w.m) || ' changes/min)' ELSE 'Bed exit (rise=' || printf('%.3f', w.m) || ')' END,
        CASE finding WHEN 'fall_detected' THEN greatest(top, 0.8::DOUBLE) WHEN 'trunk_tilt' THEN w.s ELSE top END FROM (
        SELECT seq_id, finding, arg_max({'m': measured, 's': score}, (measured, -frame_idx)) AS w, max(score) AS top FROM (SELECT * FROM found UNION ALL BY NAME SELECT * FROM tilts) GROUP BY 1, 2)) GROUP BY seq_id""",
    "found",
    "devs",
    "tilts",
)
def _summarise(spark, sf):
    t = timelines(spark, sf)
    everything = found(spark, sf).unionByName(MO.postural_deviations(t, TARGETS, 2, FPS)).unionByName(MO.tilt_findings(t, 60.0, 2, FPS))
    return MO.summarise_findings(everything)


def physio_sql() -> str:
    agg = ", ".join(f"min({j}) AS {j}_lo, max({j}) AS {j}_hi, avg({j}) AS {j}_avg, count({j}) AS {j}_n" for j in MO.LIMBS)
    parts = []
    for part in ["knee", "elbow"]:
        a, b = f"{part}_left", f"{part}_right"
        ok = f"{a}_n >= 3 AND {b}_n >= 3"
        gap = f"abs({a}_avg - {b}_avg)"
        row = "SELECT seq_id, track_id, '{0}' AS finding, '{1}' AS joint, printf('%.1f', {2})::DOUBLE AS measured, {3}::DOUBLE AS expected, printf('%.1f', {4} / 15.0::DOUBLE)::DOUBLE AS duration_s, n_frames // 2 AS frame_idx, printf('%.3f', {5})::DOUBLE AS score FROM ps WHERE {6}"
        parts.append(row.format("asymmetric_movement", f"{a}/{b}", gap, 20.0, f"{a}_n", f"least(1.0, {gap} / 60.0)", f"{ok} AND {gap} > 20"))
        for n in [a, b]:
            rom = f"({n}_hi - {n}_lo)"
            parts.append(row.format("reduced_range_of_motion", n, rom, 30.0, f"{n}_n", f"greatest(0.0, least(1.0, 1.0 - {rom} / 30.0))", f"{ok} AND {rom} < 30"))
            parts.append(row.format("limited_flexion", n, f"{n}_lo", 90.0, f"{n}_n", f"least(1.0, ({n}_lo - 90.0) / 90.0)", f"{ok} AND {n}_lo > 90"))
    cte("ps", f"SELECT seq_id, track_id, max(n_frames) AS n_frames, {agg} FROM tl JOIN sequences USING (seq_id) GROUP BY seq_id, track_id", "tl", "sequences")
    return " UNION ALL ".join(parts)


@both("mot_physio_findings", physio_sql(), "ps")
def _physio(spark, sf):
    return MO.physio_findings(timelines(spark, sf), V.sequences(spark, sf), FPS, min_angles=3)


@both(
    "mot_main_person",
    "SELECT seq_id, arg_max(track_id, (coalesce(mean_hip_y, 0.0), -track_id)) AS track_id FROM st GROUP BY 1",
    "st",
)
def _main(spark, sf):
    return MO.main_person(timelines(spark, sf))


def peaks(spark, sf) -> DataFrame:
    t = timelines(spark, sf)
    ident = F.concat_ws("-", "seq_id", "track_id", "frame_idx")
    lost = F.when(F.col("frame_idx") % 8 == 0, F.col("track_id")).otherwise(F.lit(7).cast("long"))
    return t.select(ident.alias("finding_id"), "seq_id", lost.alias("track_id"), F.col("frame_idx").alias("peak_frame"))


@both(
    "mot_evidence_frame",
    """WITH fd AS (SELECT concat_ws('-', seq_id, track_id, frame_idx) AS finding_id, seq_id, CASE WHEN frame_idx % 8 = 0 THEN track_id ELSE 7 END AS t, frame_idx AS pk FROM tl),
    nr AS (SELECT finding_id, frame_idx, pose_idx FROM fd JOIN tl ON tl.seq_id = fd.seq_id AND tl.track_id = t AND frame_idx >= pk AND frame_idx < pk + 6
      QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY mean_y DESC, frame_idx) = 1)
    SELECT fd.finding_id, fd.seq_id, coalesce(nr.frame_idx, CASE WHEN f.p IS NOT NULL THEN pk END) AS frame_idx, coalesce(nr.pose_idx, f.p) AS pose_idx FROM fd LEFT JOIN nr USING (finding_id)
    LEFT JOIN (SELECT seq_id, frame_idx, min(pose_idx) AS p FROM pf GROUP BY 1, 2) f ON f.seq_id = fd.seq_id AND f.frame_idx = pk""",
    "tl",
)
def _evidence(spark, sf):
    return MO.evidence_frame(peaks(spark, sf), scalars(spark, sf), reach=6)


fam.sql["mot_evidence_frame"] = fam.sql["mot_evidence_frame"].replace("\nWITH fd AS", ",\nfd AS", 1)


@both(
    "mot_fall_metrics",
    """SELECT tp, fp, fn, tp + fn AS support, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (
    SELECT count(*) FILTER (label = 'fall' AND verdict = 'fall') AS tp, count(*) FILTER (label <> 'fall' AND verdict = 'fall') AS fp, count(*) FILTER (label = 'fall' AND verdict <> 'fall') AS fn
    FROM anyfall WHERE verdict <> 'insufficient_data')""",
    "anyfall",
)
def _metrics(spark, sf):
    seqs = V.sequences(spark, sf)
    out = MO.fall_metrics(MO.fall_any(windows(spark, sf), seqs, 0.5), seqs)
    return out.select("tp", "fp", "fn", "support", r("precision"), r("recall"), r("f1"))


def fx(e: str, n: int, name: str) -> str:
    return f"printf('%.{n}f', {e})::DOUBLE AS {name}"


@both(
    "mot_track_diagnostics",
    f"""SELECT {T}, n_valid, {fx('n_valid / n_frames::DOUBLE * 100', 1, 'coverage_pct')}, {fx('tm', 4, 'torso_mean')}, {fx('h0', 4, 'hip_y_first')}, {fx('h1', 4, 'hip_y_last')}, {fx('ha', 4, 'hip_y_amplitude')},
    {fx('vm', 4, 'v_max_raw')}, {fx('vm * 0.5', 4, 'v_max_scaled')}, {fx('vm / greatest(tm, 0.01::DOUBLE)', 4, 'v_max_norm')}, {fx('va', 4, 'v_mean')}, {fx('max_tilt', 1, 'tilt_max')},
    {fx('CASE WHEN len(tilts) >= 10 THEN tilts[floor(len(tilts) * 0.9)::BIGINT + 1] ELSE 0.0 END', 1, 'tilt_p90')}, recumbent, initially_recumbent, coalesce(s2.streak, 0) AS streak,
    {fx('ds', 4, 'descent')}, {fx('ds * 0.5', 4, 'descent_scaled')} FROM st JOIN (
      SELECT {T}, coalesce(avg(torso), 0.0) AS tm, arg_min(hy, frame_idx) FILTER (hy IS NOT NULL) AS h0, arg_max(hy, frame_idx) FILTER (hy IS NOT NULL) AS h1, coalesce(max(hy) - min(hy), 0.0) AS ha,
        coalesce(max(v), 0.0) AS vm, coalesce(avg(v), 0.0) AS va, coalesce(list(tilt ORDER BY tilt) FILTER (tilt IS NOT NULL), []) AS tilts, coalesce(sum(v) FILTER (v > 0), 0.0) AS ds FROM mo GROUP BY 1, 2) x USING (seq_id, track_id)
    LEFT JOIN (SELECT {T}, max(n) AS streak FROM (SELECT {T}, g, count(*) AS n FROM (
      SELECT *, i - row_number() OVER (PARTITION BY {T} ORDER BY i) AS g FROM (SELECT {T}, v, row_number() OVER (PARTITION BY {T} ORDER BY frame_idx) AS i FROM mo WHERE v IS NOT NULL) WHERE v > 0.02::DOUBLE) GROUP BY ALL) GROUP BY 1, 2) s2 USING (seq_id, track_id)
    WHERE n_valid >= 3""",
    "st",
    "mo",
)
def _diagnostics(spark, sf):
    return MO.track_diagnostics(motion(spark, sf), V.sequences(spark, sf), FPS, LIM)


@both(
    "mot_filter_person_boxes",
    """SELECT image, box_id, w, h, confidence FROM boxes WHERE w >= 30 AND h >= 50 AND w * h >= 1500 AND w * h >= 400.0 * 500.0 * 0.01 AND confidence >= 0.35""",
    "boxes",
)
def _person_boxes(spark, sf):
    return MO.filter_person_boxes(V.boxes(spark, sf), 400.0, 500.0).select("image", "box_id", "w", "h", "confidence")


@both(
    "mot_subsample_frames",
    """SELECT seq_id, frame_idx FROM (SELECT DISTINCT seq_id, frame_idx FROM pf) JOIN (SELECT seq_id, count(DISTINCT frame_idx) AS n FROM pf GROUP BY 1) USING (seq_id)
    WHERE frame_idx % greatest(1, n // 9) = 0""",
    "pf",
)
def _subsample(spark, sf):
    frames = V.poses(spark, sf).select("seq_id", "frame_idx").distinct()
    return MO.subsample_frames(frames, 9)
