"""Bridge views. All read parquet lazily, so only the used columns are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl
from wardwatch.plans.ordered import dense_index

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds

# joint name -> landmark position in the 16-landmark bridge poses
JOINTS = {
    "nose": 0,
    "left_shoulder": 1,
    "right_shoulder": 2,
    "left_elbow": 3,
    "right_elbow": 4,
    "left_wrist": 5,
    "right_wrist": 6,
    "left_hip": 7,
    "right_hip": 8,
    "left_knee": 9,
    "right_knee": 10,
    "left_ankle": 11,
    "right_ankle": 12,
}

TERMS = ["la", "que", "ing", "of the", "entre"]
POSITIVE = ["the", "le", "die", "el"]
NEGATIVE = ["of", "ou", "und", "la"]


PARQUET_PER_TASK = 4 << 20  # some hundred thousand rows of the tables at hand
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_measured: dict[tuple[str, str], int] = {}


def scale_shuffles(spark: SparkSession, path: str) -> None:
    """Lets shuffles begin with a partition for each ``PARQUET_PER_TASK`` bytes of the files,
    so that what a task sorts does not grow with the input; adaptive execution joins small ones."""
    at = (spark.sparkContext.applicationId, path)
    if at not in _measured:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        _measured[at] = files.agg(F.sum("length")).first()[0] or 0  # lengths alone, no content
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(-(-_measured[at] // PARQUET_PER_TASK), int(spark.conf.get(INITIAL, None) or 0))
    if wanted > fixed:
        spark.conf.set(INITIAL, str(wanted))
        if spark.conf.get(ADVISORY, None) is None:  # compressed; a sorted task takes many times that
            spark.conf.set(ADVISORY, "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as Parquet gives it; its splits follow spark.sql.files.*."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    scale_shuffles(spark, f"{sf_dir}/{name}.parquet")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.floor(micros("ts") / F.lit(86400000000)).cast("long")
    return dense_index(ev, ["user_id"], ["ts", "event_id"], day)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel at 1 Hz per user; 'error' events are signal loss (zero)."""
    return indexed_events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("record_id"),
        "idx",
        F.lit("FHR").alias("channel"),
        F.when(F.col("event_type") == "error", dbl(0)).otherwise(F.col("value")).alias("x"),
    )


def bedside_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rate and saturation per user, split by parity of the event id."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    two = ev.select(
        F.col("user_id").cast("string").alias("record_id"),
        F.when(F.col("event_id") % 2 == 0, "HR").otherwise("SpO2").alias("channel"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "error", dbl(0))
        .when(F.col("event_id") % 2 == 0, F.col("value") + dbl(40))
        .otherwise(dbl(100) - F.col("value") / dbl(8))
        .alias("x"),
    )
    day = F.floor(micros("ts") / F.lit(86400000000)).cast("long")
    return dense_index(two, ["record_id", "channel"], ["ts", "event_id"], day).drop("ts", "event_id")


def raw_channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel names as a device writes them: padded, with trailing commas."""
    names = F.create_map(
        *[F.lit(v) for kv in {"click": "FHR,", "view": " UC", "purchase": "HR,,", "signup": "SpO2,", "error": "PLETH"}.items() for v in kv]
    )
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("record_id"),
        F.try_element_at(names, F.col("event_type")).alias("channel"),
        F.col("value").alias("x"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    return ids.select(
        F.col("user_id").cast("string").alias("record_id"),
        dbl(1).alias("fs"),
        (dbl(7) + (F.col("user_id") % 10) / dbl(50)).alias("ph"),
    )


def fusion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    v = F.col("value")
    level = (
        F.when(v >= 100, "CRITICAL").when(v >= 60, "HIGH").when(v >= 30, "MEDIUM").when(v >= 10, "LOW").otherwise("INFO")
    )
    t = F.col("event_type")
    modality = (
        F.when(t == "click", "video")
        .when(t == "view", "audio")
        .when(t == "purchase", "vitals")
        .when(t == "error", "prescription")
        .otherwise("other")
    )
    return ev.select(
        F.col("user_id").cast("string").alias("patient_id"),
        modality.alias("modality"),
        ((micros("ts") - F.lit(EPOCH_US)) / dbl(1e6)).alias("t"),
        level.alias("severity_level"),
        F.concat(F.lit("value "), v.cast("string")).alias("summary"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("evidence_id"),
        F.col("event_id").alias("seq"),
    )


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").cast("string").alias("patient_id"),
            F.lower("p_type").alias("drug"),
            F.col("l_quantity").alias("dose"),
            F.lit("mg").alias("unit"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
        )
    )


RX_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dose", "l_extendedprice"]

BRIDGE_CATALOG = [
    # name, min_dose, max_dose, unit, active_ingredient, control_category, is_controlled, source, criticality
    ("standard", 5.0, 40.0, "mg", "standardine", "", False, "label", 1),
    ("small", 1.0, 30.0, "mg", "smalline", "", False, "label", 1),
    ("medium", 10.0, 45.0, "mg", "mediumine", "B1", True, "register", 2),
    ("large", 5.0, 35.0, "mg", "largine", "C1", True, "register", 2),
    ("promo", 8.0, 50.0, "mg/h", "promoline", "A1", True, "register", 3),
]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("recording_id"),
        F.col("turn").alias("seg_idx"),
        (F.col("turn") * dbl(10)).alias("start_s"),
        (F.col("turn") * dbl(10) + dbl(10)).alias("end_s"),
        "text",
        ((F.length("text") % 10) / dbl(10)).alias("no_speech_prob"),
    )


def acoustic(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("run_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("recording_id"),
        (F.col("l_tax") / dbl(5)).alias("jitter_local"),
        F.col("l_discount").alias("shimmer_local"),
        F.col("l_quantity").alias("hnr_db"),
        (F.col("l_discount") * dbl(5)).alias("pause_rate"),
        F.col("l_linenumber").cast("double").alias("speaking_rate_wps"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two people per frame; one sequence per label; every eleventh pose is untracked."""
    e = table(spark, sf_dir, "embeddings")
    rows = dense_index(e, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 100000).cast("long"), "rn")
    v = F.transform("embedding", lambda f: f.cast("double"))
    landmark = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.struct(
            (dbl(0.5) + F.get("_v", i * 4)).alias("x"),
            (dbl(0.5) + F.get("_v", i * 4 + 1)).alias("y"),
            F.get("_v", i * 4 + 2).alias("z"),
            F.least(dbl(1), F.abs(F.get("_v", i * 4 + 3)) * dbl(8)).alias("vis"),
        ),
    )
    return rows.withColumn("_v", v).select(
        F.col("label").cast("string").alias("seq_id"),
        F.floor(F.col("rn") / 2).cast("long").alias("frame_idx"),
        (F.col("rn") % 2).cast("long").alias("pose_idx"),
        F.when(F.col("vec_id") % 11 != 0, (F.col("vec_id") % 2).cast("long")).alias("track_id"),
        landmark.alias("landmarks"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("label").cast("string").alias("seq_id"),
        F.when(F.col("label") % 2 == 0, "fall").otherwise("adl").alias("label"),
        F.floor((F.col("_n") + 1) / 2).cast("long").alias("n_frames"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("image"),
        F.col("l_returnflag").alias("class"),
        (F.col("l_partkey") % 100).cast("double").alias("x"),
        (F.col("l_suppkey") % 100).cast("double").alias("y"),
        F.col("l_quantity").alias("w"),
        (F.col("l_linenumber") * dbl(10)).alias("h"),
        (F.col("l_discount") * dbl(10)).alias("confidence"),
        F.col("l_linestatus").alias("status"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("box_id"),
    )


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(
        F.col("source").alias("detector"),
        (F.col("quality") == 1).alias("y_true"),
        (F.col("n_chars") > 1000).alias("y_pred"),
        (F.col("toxic") == 1).alias("toxic"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.timestamp_seconds(F.lit(788918400) + (F.col("c_custkey") % 100) * 86400).alias("start_date"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 5
    s = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.when(m == 0, "video")
        .when(m == 1, "video_surgical")
        .when(m == 2, "audio")
        .when(m == 3, "prescription")
        .otherwise("vitals")
        .alias("modality"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(s == "F", "done").when(s == "P", "processing").otherwise("received").alias("status"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m = F.col("l_orderkey") % 5
    offset = F.when(
        F.col("l_linenumber") == 1, F.concat(F.lit(',"instant_s":'), (F.col("l_partkey") * 60).cast("string"))
    ).otherwise("")
    evidence = F.when(F.col("l_tax") > 0.01, F.concat(F.lit('"ev-'), ident, F.lit('"'))).otherwise("null")
    return li.select(
        ident.alias("id"),
        F.col("l_orderkey").cast("string").alias("upload_id"),
        F.when(m == 0, "video")
        .when(m == 1, "video_surgical")
        .when(m == 2, "audio")
        .when(m == 3, "prescription")
        .otherwise("vitals")
        .alias("modality"),
        F.concat(
            F.lit('{"summary":"flag '),
            F.col("l_returnflag"),
            F.lit('","evidence_id":'),
            evidence,
            F.lit(',"details":{"line":'),
            F.col("l_linenumber").cast("string"),
            offset,
            F.lit("}}"),
        ).alias("result"),
        F.col("l_discount").alias("score"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = F.col("l_quantity")
    return li.select(
        F.concat(F.lit("ev-"), ident).alias("evidence_id"),
        F.when(F.col("l_returnflag") == "A", "vitals").otherwise("video").alias("feature"),
        F.concat(F.lit("run-"), (F.col("l_suppkey") % 7).cast("string")).alias("run_id"),
        F.when(q >= 40, "CRITICAL").when(q >= 30, "HIGH").when(q >= 20, "medium").when(q >= 10, "LOW").otherwise("odd").alias("severity"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "line"
    )
