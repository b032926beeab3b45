"""Boxes, scene labels and tracks on line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import boxes as BX
from wardwatch.operators import tracking as TR
from wardwatch.plans.materialise import written

fam = Family()
CRIT = ["R", "A"]


def truths(spark, sf) -> DataFrame:
    return V.boxes(spark, sf).filter("status = 'F'")


def detections(spark, sf) -> DataFrame:
    return V.boxes(spark, sf).filter("status = 'O'")


cte(
    "pairs",
    """SELECT image, class, det, truth, inter / (dw * dh + gw * gh - inter) AS iou, confidence FROM (
      SELECT d.image, d.class, d.box_id AS det, g.box_id AS truth, d.confidence, d.w AS dw, d.h AS dh, g.w AS gw, g.h AS gh,
        greatest(0.0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x)) * greatest(0.0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y)) AS inter
      FROM boxes d JOIN boxes g ON d.image = g.image AND d.class = g.class AND d.status = 'O' AND g.status = 'F')""",
    "boxes",
)


@fam.add("box_iou", stmt("SELECT image, class, det, truth, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1::DOUBLE", "pairs"))
def _iou(spark, sf):
    out = BX.overlapping_pairs(detections(spark, sf), truths(spark, sf), 0.1)
    return out.select("image", "class", "det", "truth", F.round("iou", 6).alias("iou"))


cte("dets", "SELECT image, class, box_id AS det, row_number() OVER (PARTITION BY image, class ORDER BY confidence DESC, box_id) AS rk FROM boxes WHERE status = 'O'", "boxes")
cte("near", "SELECT image, class, det, truth, iou FROM pairs WHERE iou >= 0.5::DOUBLE", "pairs")
cte(
    "walk",
    """SELECT DISTINCT image, class, 0::BIGINT AS rk, []::VARCHAR[] AS taken FROM near UNION ALL
    SELECT w.image, w.class, w.rk + 1, list_concat(w.taken, coalesce([arg_min(g.truth, (-g.iou, g.truth)) FILTER (g.truth IS NOT NULL AND NOT list_contains(w.taken, g.truth))], []))
    FROM walk w JOIN dets d ON d.image = w.image AND d.class = w.class AND d.rk = w.rk + 1 LEFT JOIN near g ON g.image = d.image AND g.class = d.class AND g.det = d.det
    GROUP BY w.image, w.class, w.rk, w.taken""",
    "dets",
    "near",
)
MATCH = """SELECT class, tp, fp, fn, tp + fn AS support, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
    round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (
    SELECT class, coalesce(m, 0)::BIGINT AS tp, coalesce(nd, 0) - coalesce(m, 0)::BIGINT AS fp, coalesce(ng, 0) - coalesce(m, 0)::BIGINT AS fn FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS c(class)
    LEFT JOIN (SELECT class, count(*) AS nd FROM boxes WHERE status = 'O' AND image IN (SELECT image FROM boxes WHERE status = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority < '3') GROUP BY 1) USING (class)
    LEFT JOIN (SELECT class, count(*) AS ng FROM boxes WHERE status = 'F' GROUP BY 1) USING (class)
    LEFT JOIN (SELECT class, sum(n) AS m FROM (SELECT image, class, max(len(list_filter(taken, lambda t: t IS NOT NULL))) AS n FROM walk GROUP BY 1, 2) GROUP BY 1) USING (class))"""


@fam.add("box_match_detections", stmt(MATCH, "boxes", "walk").replace("WITH ", "WITH RECURSIVE ", 1))
def _match(spark, sf):
    urgent = V.table(spark, sf, "orders").filter("o_orderpriority < '3'").select(F.col("o_orderkey").alias("image"))
    out = BX.match_detections(truths(spark, sf), detections(spark, sf), ["A", "N", "R", "X"], annotated=urgent)
    return out.select("class", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]])


@fam.add(
    "box_critical_detections",
    stmt(
        """SELECT image, string_agg(class || ':' || confidence || ':' || x, ';' ORDER BY class, confidence, x, y, w, h) AS detections FROM boxes
        WHERE status = 'O' AND class IN ('R', 'A') GROUP BY image""",
        "boxes",
    ),
)
def _critical(spark, sf):
    out = BX.critical_detections(detections(spark, sf), CRIT)
    text = F.transform("detections", lambda d: F.concat_ws(":", d["class"], d["confidence"].cast("string"), d["x"].cast("string")))
    return out.select("image", F.array_join(text, ";").alias("detections"))


def video_rows(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 50).alias("video"), (F.col("l_partkey") % 300).alias("frame_idx"), F.col("l_returnflag").alias("class")
    )


cte("vrows", "SELECT l_suppkey % 50 AS video, l_partkey % 300 AS frame_idx, l_returnflag AS class FROM lineitem")


@fam.add("box_sample_keyframes", stmt("SELECT video, frame_idx, class FROM vrows WHERE frame_idx % 20 = 0", "vrows"))
def _keyframes(spark, sf):
    return BX.sample_keyframes(video_rows(spark, sf), 10.0)


@fam.add(
    "box_best_keyframe",
    stmt(
        """SELECT video, frame_idx AS keyframe, n AS n_detections, classes, printf('%.1f', frame_idx / 10.0::DOUBLE)::DOUBLE AS instant_s FROM (
        SELECT video, frame_idx, count(*) AS n, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM vrows WHERE class IN ('R', 'A') GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, frame_idx) = 1""",
        "vrows",
    ),
)
def _best(spark, sf):
    return BX.best_keyframe(video_rows(spark, sf), 10.0, CRIT)[0].withColumn("classes", F.array_join("classes", ","))


@fam.add("box_keyframe_index", stmt("SELECT DISTINCT video, class, frame_idx FROM vrows WHERE class IN ('R', 'A')", "vrows"))
def _index(spark, sf):
    return BX.best_keyframe(video_rows(spark, sf), 10.0, CRIT)[1]


NAMES = ["Bed", "Hospital", "Nurse", "Sitting", "Tree", "Scalpel", "Monitor", "Patient", "Bedroom", "Walking", "Car"]


def scene_labels(spark, sf) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(n) for n in NAMES])
    return li.select(
        F.col("l_orderkey").alias("image"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"),
        F.get(names, (F.col("l_partkey") % len(NAMES)).cast("int")).alias("name"),
        (dbl(1) - F.col("l_discount") * dbl(5)).alias("confidence"),
        F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("Tools"), F.lit("Medical"))).otherwise(F.array(F.lit("Home"))).alias("categories"),
    )


KIND = "CASE WHEN name IN ('Bed', 'Monitor') THEN 'object' WHEN name IN ('Hospital', 'Bedroom') THEN 'environment' WHEN name IN ('Nurse', 'Patient') THEN 'person' WHEN name IN ('Sitting', 'Walking') THEN 'action' WHEN med THEN 'object' END"
cte(
    "scene",
    f"""SELECT * FROM (SELECT *, {KIND} AS kind FROM (SELECT l_orderkey AS image, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {NAMES!r}[l_partkey % 11 + 1] AS name,
      1.0::DOUBLE - l_discount * 5.0::DOUBLE AS confidence, l_suppkey % 3 = 0 AS med FROM lineitem)) WHERE confidence >= 0.7::DOUBLE AND kind IS NOT NULL""",
)
SORT = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@fam.add("box_filter_scene_labels", stmt("SELECT image, l_partkey, l_suppkey, name, round(confidence, 6) AS confidence, kind FROM scene", "scene"))
def _scene(spark, sf):
    out = BX.filter_scene_labels(scene_labels(spark, sf), BX.scene_dictionary(spark))
    return out.select("image", "position.l_partkey", "position.l_suppkey", "name", F.round("confidence", 6).alias("confidence"), "kind")


@fam.add(
    "box_scene_context",
    stmt(
        f"""SELECT image, coalesce(arg_min(name, ({SORT})) FILTER (kind = 'environment'), 'Undetermined') AS environment,
        coalesce(string_agg(name, ',' ORDER BY {SORT}) FILTER (kind = 'person'), '') AS people, arg_min(name, ({SORT})) FILTER (kind = 'action') AS action,
        coalesce(string_agg(name, ',' ORDER BY {SORT}) FILTER (kind = 'object'), '') AS objects FROM scene GROUP BY image""",
        "scene",
    ),
)
def _context(spark, sf):
    out = BX.scene_context(BX.filter_scene_labels(scene_labels(spark, sf), BX.scene_dictionary(spark)))
    return out.select("image", "environment", F.array_join("people", ",").alias("people"), "action", F.array_join("objects", ",").alias("objects"))


def person_boxes(spark, sf) -> DataFrame:
    """Boxes that wander: position drifts with the part number, frame by order."""
    li = V.table(spark, sf, "lineitem")
    x = (F.col("l_suppkey") % 4) * dbl(60) + (F.col("l_partkey") % 7).cast("double")
    y = (F.col("l_linenumber") % 2) * dbl(90) + (F.col("l_orderkey") % 5).cast("double")
    return li.select(
        F.concat_ws("-", "l_returnflag", F.col("l_suppkey") % 20).alias("seq_id"),
        F.col("l_orderkey").alias("frame_idx"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("box_idx"),
        x.alias("x1"),
        y.alias("y1"),
        (x + dbl(50) + F.col("l_quantity") / dbl(10)).alias("x2"),
        (y + dbl(80)).alias("y2"),
    )


@fam.add("mot_assign_tracks")
def _tracks(spark, sf):
    return TR.assign_tracks(person_boxes(spark, sf)).select("seq_id", "frame_idx", "box_idx", "track_id")


@fam.add(
    "mot_track_faults",
    """SELECT l_returnflag || '-' || (l_suppkey % 20) AS seq_id, count(*) AS boxes, 0::BIGINT AS twice, 0::BIGINT AS broken, 0::BIGINT AS missed FROM lineitem GROUP BY 1""",
)
def _faults(spark, sf):
    """Ids are unique in a frame, every step is admissible, no free admissible track is passed over."""
    return TR.track_faults(written(TR.assign_tracks(person_boxes(spark, sf))))
