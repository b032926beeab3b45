"""Detections, truth boxes and scene labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.functions.geometry import iou
from wardwatch.functions.guards import dbl
from wardwatch.functions.tables import literal_table
from wardwatch.functions.text import exact_round
from wardwatch.operators.quality import metrics_of_counts
from wardwatch.plans.materialise import written

IOU_LIMIT = 0.5
CELL = 64.0

# Structures whose detection is critical during surgery.
CRITICAL = ["cystic_artery", "cystic_duct", "cystic_plate"]

# Scene labels of clinical interest and what they stand for.
SCENE = {
    "Wheelchair": "object",
    "Cane": "object",
    "Stretcher": "object",
    "Stethoscope": "object",
    "Monitor": "object",
    "Thermometer": "object",
    "X-Ray": "object",
    "Ct Scan": "object",
    "Ultrasound": "object",
    "First Aid": "object",
    "Bed": "object",
    "Infant Bed": "object",
    "Shower": "object",
    "Toilet": "object",
    "Handrail": "object",
    "Guard Rail": "object",
    "Elevator": "object",
    "Hospital": "environment",
    "Clinic": "environment",
    "Operating Theatre": "environment",
    "Waiting Room": "environment",
    "Pharmacy": "environment",
    "Bedroom": "environment",
    "Bathroom": "environment",
    "Corridor": "environment",
    "Hallway": "environment",
    "Reception": "environment",
    "Doctor": "person",
    "Nurse": "person",
    "Patient": "person",
    "Person": "person",
    "Sitting": "action",
    "Standing": "action",
    "Walking": "action",
}
SCENE_CONFIDENCE = 0.70


def _cells(box: str, cell: float) -> Column:
    """Grid cells a box touches."""
    lo = lambda n: F.floor(F.col(f"{box}.{n}") / dbl(cell)).cast("long")
    hi = lambda n, s: F.floor((F.col(f"{box}.{n}") + F.col(f"{box}.{s}")) / dbl(cell)).cast("long")
    return F.flatten(
        F.transform(
            F.sequence(lo("x"), hi("x", "w")),
            lambda i: F.transform(F.sequence(lo("y"), hi("y", "h")), lambda j: F.struct(i.alias("cx"), j.alias("cy"))),
        )
    )


def overlapping_pairs(
    detections: DataFrame, truths: DataFrame, limit: float = IOU_LIMIT, cell: float = CELL
) -> DataFrame:
    """Detection and truth boxes of one image and class with overlap of at least ``limit``.

    Both sides are listed under the grid cells they touch, and a pair is tested only
    in the cell of the corner where their intersection begins, so distant boxes of a
    crowded image never meet and no pair is tested twice.
    """
    box = F.struct("x", "y", "w", "h")
    d = detections.select("image", "class", F.col("box_id").alias("det"), "confidence", box.alias("_d"))
    g = truths.select("image", "class", F.col("box_id").alias("truth"), box.alias("_g"))
    d = d.select("*", F.inline(_cells("_d", cell)))
    g = g.select("*", F.inline(_cells("_g", cell)))
    pairs = d.join(g, ["image", "class", "cx", "cy"])
    corner = lambda n: F.floor(F.greatest(F.col(f"_d.{n}"), F.col(f"_g.{n}")) / dbl(cell)).cast("long")
    pairs = pairs.filter((corner("x") == F.col("cx")) & (corner("y") == F.col("cy"))).withColumn("iou", iou("_d", "_g"))
    kept = pairs.filter((F.col("iou") >= dbl(limit)) & (F.col("iou") > 0))
    return kept.select("image", "class", "det", "confidence", "truth", "iou")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Detections by falling confidence each take their best free truth box.

    Done in rounds over the sparse pair table instead of image by image: a detection
    whose best truth is wanted by no free detection before it takes that truth, and
    both leave the table. Every round settles at least the strongest detection left,
    in each image and class at once. The table is checkpointed between rounds.
    """
    group = ["image", "class"]
    order = F.struct(-F.col("confidence"), F.col("det"))
    left = written(pairs)
    done = None
    while True:
        best = left.groupBy(*group, "det").agg(
            F.min_by(F.struct("truth", "iou", "confidence"), F.struct(-F.col("iou"), F.col("truth"))).alias("_b")
        ).select(*group, "det", F.col("_b.truth").alias("truth"), F.col("_b.iou").alias("iou"), F.col("_b.confidence").alias("confidence"))
        first = left.groupBy(*group, "truth").agg(F.min_by("det", order).alias("det"))
        settled = written(best.join(first, [*group, "truth", "det"]))
        done = settled if done is None else done.unionByName(settled)
        rest = left.join(settled.select(*group, "det"), [*group, "det"], "left_anti").join(
            settled.select(*group, "truth"), [*group, "truth"], "left_anti"
        )
        left = written(rest)
        if left.isEmpty():
            return done.select(*group, "det", "truth", "iou", "confidence")


def match_detections(
    truths: DataFrame, detections: DataFrame, classes: Sequence[str] | None = None, limit: float = IOU_LIMIT, cell: float = CELL, annotated: DataFrame | None = None
) -> DataFrame:
    """Quality per class from greedy matching. Images count as annotated if they are in
    ``annotated`` (image), which names those annotated as empty, or have a truth row;
    detections elsewhere are ignored. Asked classes without rows have support 0."""
    images = truths.select("image")
    images = (images if annotated is None else images.union(annotated.select("image"))).distinct()
    usable = detections.join(images, "image", "left_semi")
    matched = greedy_matches(overlapping_pairs(usable, truths, limit, cell)).groupBy("class").agg(F.count(F.lit(1)).alias("tp"))
    n_det = usable.groupBy("class").agg(F.count(F.lit(1)).alias("_d"))
    n_truth = truths.groupBy("class").agg(F.count(F.lit(1)).alias("_g"))
    counts = n_truth.join(n_det, "class", "full").join(matched, "class", "left")
    if classes is not None:
        asked = literal_table(truths.sparkSession, [(c,) for c in classes], "class string")
        counts = asked.join(counts, "class", "left")
    counts = counts.fillna(0, ["_g", "_d", "tp"]).select("class", "tp", (F.col("_d") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"))
    return metrics_of_counts(counts, ["class"])


def critical_detections(detections: DataFrame, critical: Sequence[str] = tuple(CRITICAL)) -> DataFrame:
    """Images with critical structures, and those detections."""
    return (
        detections.filter(F.col("class").isin(list(critical)))
        .groupBy("image")
        .agg(F.array_sort(F.collect_list(F.struct("class", "confidence", "x", "y", "w", "h"))).alias("detections"))
    )


def sample_keyframes(frames: DataFrame, fps: float, every_s: float = 2.0) -> DataFrame:
    return frames.filter(F.col("frame_idx") % max(1, int(fps * every_s)) == 0)


def best_keyframe(
    detections: DataFrame, fps: float, critical: Sequence[str] = tuple(CRITICAL), key: str = "video"
) -> tuple[DataFrame, DataFrame]:
    """The keyframe with most critical detections (the earliest on ties) with its
    classes, and the index of keyframes per class. Rows are ``(video, frame_idx, class)``."""
    per = (
        detections.filter(F.col("class").isin(list(critical)))
        .groupBy(key, "frame_idx", "class")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    frames = per.groupBy(key, "frame_idx").agg(F.sum("_c").alias("_n"), F.array_sort(F.collect_list("class")).alias("classes"))
    best = frames.groupBy(key).agg(
        F.max_by(F.struct("frame_idx", "_n", "classes"), F.struct(F.col("_n"), -F.col("frame_idx"))).alias("_b")
    )
    index = per.select(key, "class", "frame_idx")
    return (
        best.select(
            key,
            F.col("_b.frame_idx").alias("keyframe"),
            F.col("_b._n").alias("n_detections"),
            F.col("_b.classes").alias("classes"),
            exact_round(F.col("_b.frame_idx") / dbl(fps), 1).alias("instant_s"),
        ),
        index,
    )


def scene_dictionary(spark: SparkSession) -> DataFrame:
    rows = list(SCENE.items())
    return literal_table(spark, rows, "name string, kind string")


def filter_scene_labels(labels: DataFrame, dictionary: DataFrame, confidence: float = SCENE_CONFIDENCE) -> DataFrame:
    """Confident labels ``(image, position, name, confidence, categories)`` that are in
    the dictionary or in the Medical category; the latter are objects."""
    sure = labels.filter(F.col("confidence") >= dbl(confidence))
    known = sure.join(dictionary, "name", "left")
    medical = F.exists("categories", lambda c: c == "Medical")
    kept = known.filter(F.col("kind").isNotNull() | medical)
    return kept.withColumn("kind", F.coalesce("kind", F.lit("object")))


def scene_context(filtered: DataFrame) -> DataFrame:
    """Per image: first environment, people, first action and the remaining objects."""

    def named(kind: str, field: str = "name") -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("position", field))))
        return F.transform(rows, lambda r: r[field])

    def first(kind: str) -> Column:
        return F.min_by("name", F.when(F.col("kind") == kind, F.col("position")))

    return filtered.groupBy("image").agg(
        F.coalesce(first("environment"), F.lit("Undetermined")).alias("environment"),
        named("person").alias("people"),
        first("action").alias("action"),
        named("object").alias("objects"),
    )

