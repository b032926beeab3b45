"""Image annotations and frame file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.sources.json_arrays import array_objects, plan_ranges, write_array_files
from wardwatch.sources.recordings import stem

IMAGE = "id bigint, file_name string"
ANNOTATION = "image_id bigint, category_id bigint, bbox array<double>"
CATEGORY = "id bigint, name string"
ROWS_PER_FILE = 1_000_000


def coco_tables(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a folder of annotation files; ids count
    within their file. Files are read in ranges of ``range_bytes``, however large."""
    plan = plan_ranges(spark, path, range_bytes)
    images = array_objects(spark, plan, "images", IMAGE).drop("at").withColumnRenamed("id", "image_id")
    annotations = array_objects(spark, plan, "annotations", ANNOTATION).drop("at")
    categories = array_objects(spark, plan, "categories", CATEGORY).drop("at").withColumnsRenamed({"id": "category_id", "name": "class"})
    return images, annotations, categories


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, folder: str, files: int | None = 1) -> list[str]:
    """Annotation files of ``images (image_id, file_name)``, ``annotations (image_id,
    category_id, bbox)`` and ``categories (category_id, class)``; an image and its
    annotations share a file, categories are in each. A file is written by one task;
    with ``files`` None there are enough for about ``ROWS_PER_FILE`` rows in each, four at least."""
    if files is None:
        files = max(4, -(-(images.count() + annotations.count()) // ROWS_PER_FILE))
    return write_array_files(
        {
            "images": images.select("image_id", F.col("image_id").alias("id"), "file_name"),
            "categories": categories.select(F.col("category_id").alias("id"), F.col("class").alias("name")),
            "annotations": annotations.select("image_id", "category_id", "bbox"),
        },
        folder,
        "image_id",
        files,
    )


def annotated_frames(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per image with its boxes; an image without annotation keeps an empty
    list. The class name comes from the category id only."""
    scope = [c for c in ["source"] if c in images.columns]
    boxes = (
        annotations.join(categories, [*scope, "category_id"])
        .groupBy(*scope, "image_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "class",
                        F.get("bbox", 0).alias("x"),
                        F.get("bbox", 1).alias("y"),
                        F.get("bbox", 2).alias("w"),
                        F.get("bbox", 3).alias("h"),
                    )
                )
            ).alias("boxes")
        )
    )
    empty = F.array().cast("array<struct<class:string,x:double,y:double,w:double,h:double>>")
    return images.join(boxes, [*scope, "image_id"], "left").withColumn("boxes", F.coalesce("boxes", empty))


def frame_index_and_label(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Frame number and sequence label of ``<sequence>/<camera folder>/<name>-<digits>.png``.

    The number is the trailing digits of the name; a sequence that starts with
    neither ``fall-`` nor ``adl-`` is rejected.
    """
    folder = F.regexp_extract(F.col(path), r"([^/]+)/[^/]+/[^/]+$", 1)
    digits = F.regexp_extract(stem(F.col(path)), r"(\d+)$", 1)
    judged = files.select(
        "*",
        folder.alias("seq_id"),
        digits.try_cast("long").alias("frame_idx"),
        F.when(F.startswith(folder, F.lit("fall-")), "fall").when(F.startswith(folder, F.lit("adl-")), "adl").alias("label"),
    )
    return judged.filter(F.col("label").isNotNull()), judged.filter(F.col("label").isNull()).select(*files.columns)
