"""Risk fusion: events of several modalities into one scored, levelled timeline.

The as-of lookup needs only the newest event per (patient, modality, grid cell),
so events are reduced to cells by a hash aggregate before any ordering happens.
Grid points are then produced from the cells, chunk by chunk, without a join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl
from wardwatch.functions.text import exact_round, fixed
from wardwatch.plans.ordered import CHUNK, carried, chunk_of, chunk_window

# Weight of a severity level and of a modality in the risk score.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.45, "LOW": 0.2, "INFO": 0.05}
UNKNOWN_SEVERITY = 0.1
WEIGHTS = {"video": 0.40, "audio": 0.30, "vitals": 0.40, "prescription": 0.45}
HALF_LIFE_S = 600.0
STEP_S = 60.0
YELLOW, RED, BAND = 0.15, 0.35, 0.05
ALERT_LEVEL = "red"
LEVELS = ["green", "yellow", "red"]

GRID_CHUNK = 4096  # grid points per chunk


def severity_weight(level: Column) -> Column:
    up = F.upper(level)
    out = F.when(up == "CRITICAL", dbl(SEVERITY_WEIGHTS["CRITICAL"]))
    for name in ["HIGH", "MEDIUM", "LOW", "INFO"]:
        out = out.when(up == name, dbl(SEVERITY_WEIGHTS[name]))
    return out.otherwise(dbl(UNKNOWN_SEVERITY))


def fusion_modality(m: Column) -> Column:
    return F.when(m == "video_surgical", "video").otherwise(m)


def event_instant(explicit: Column, created: Column, start: Column) -> Column:
    """Explicit offset, else seconds from start to creation (never negative), else 0."""
    elapsed = (F.unix_micros(created) - F.unix_micros(start)) / dbl(1e6)
    return F.coalesce(explicit, F.greatest(dbl(0), elapsed), dbl(0))


def iso_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def half_life_decay(elapsed: Column, half_life: float) -> Column:
    return F.pow(dbl(2), -elapsed / dbl(half_life))


def fusion_events(analyses: DataFrame, uploads: DataFrame, patients: DataFrame, evidence: DataFrame) -> DataFrame:
    """Analyses with a finding and resolvable evidence, as timeline events.

    An evidence id stored under several paths resolves to the first path.
    """
    parsed = F.from_json("result", "summary string, evidence_id string, details struct<instant_s double>")
    found = (
        analyses.filter((F.col("score") != 0) & F.col("score").isNotNull())
        .withColumn("_r", parsed)
        .select(
            F.col("id").alias("analysis_id"),
            "upload_id",
            "modality",
            "created_at",
            F.col("_r.summary").alias("summary"),
            F.col("_r.evidence_id").alias("evidence_id"),
            F.col("_r.details.instant_s").alias("instant_s"),
        )
        .filter(F.col("evidence_id").isNotNull())
    )
    first_path = evidence.groupBy("evidence_id").agg(
        F.min_by("severity", F.concat_ws("/", "feature", "run_id")).alias("severity_level")
    )
    starts = patients.select(F.col("id").alias("patient_id"), "start_date")
    # the patient comes in through the uploads, so that the rows end up laid out by
    # upload and not by a patient who may hold a large share of them
    owners = uploads.select(F.col("id").alias("upload_id"), "patient_id").join(starts, "patient_id")
    return (
        found.join(first_path, "evidence_id")
        .join(owners, "upload_id")
        .select(
            "patient_id",
            fusion_modality(F.col("modality")).alias("modality"),
            event_instant(F.col("instant_s"), F.col("created_at"), F.col("start_date")).alias("t"),
            severity_weight(F.col("severity_level")).alias("severity"),
            F.coalesce("summary", F.lit("")).alias("summary"),
            "evidence_id",
            F.struct("created_at", "analysis_id").alias("seq"),
        )
    )


def grid_cell(t: Column, step: float) -> Column:
    """Index of the first grid point at or after ``t`` (0 for earlier events)."""
    guess = F.ceil(t / dbl(step)).cast("long")
    up = F.when(guess * dbl(step) < t, guess + 1).otherwise(guess)
    exact = F.when((up - 1) * dbl(step) >= t, up - 1).otherwise(up)
    return F.greatest(F.lit(0).cast("long"), exact)


def last_grid_index(events: DataFrame, step: float) -> DataFrame:
    """Per patient, the index of the last grid point: the last event plus one step."""
    return (
        events.groupBy("patient_id")
        .agg(F.max("t").alias("_max_t"))
        .select("patient_id", F.floor((F.col("_max_t") + dbl(step)) / dbl(step)).cast("long").alias("last_k"))
        .filter(F.col("last_k") >= 0)
    )


def time_grid(events: DataFrame, step: float = STEP_S, chunk: int = GRID_CHUNK) -> DataFrame:
    """Grid points 0, step, … up to one step after the patient's last event."""
    ends = last_grid_index(events, step)
    cuts = ends.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of("last_k", chunk))))
    k = F.sequence(F.col("_c") * chunk, F.least(F.col("last_k"), F.col("_c") * chunk + (chunk - 1)))
    return cuts.select("patient_id", F.explode(k).alias("k")).withColumn("t", F.col("k") * dbl(step))


def latest_per_modality(
    events: DataFrame, weights: Mapping[str, float] = WEIGHTS, step: float = STEP_S, chunk: int = GRID_CHUNK
) -> DataFrame:
    """Every grid point with, per weighted modality, the newest event at or before it.

    Events: ``patient_id, modality, t, severity, summary, evidence_id, seq``; ``seq``
    is arrival order, so of two events at the same time the later arrival wins.
    """
    return chunked_grid(events, weights, step, chunk).drop(CHUNK)


def chunked_grid(
    events: DataFrame, weights: Mapping[str, float] = WEIGHTS, step: float = STEP_S, chunk: int = GRID_CHUNK
) -> DataFrame:
    """``latest_per_modality`` with the chunk of each grid point, by which the rows
    already lie; later scans over the grid reuse that layout."""
    names = list(weights)
    event = F.struct("t", "seq", "severity", "summary", "evidence_id")
    marks = (
        last_grid_index(events, step)
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of("last_k", chunk))))
        .select("patient_id", (F.col("_c") * chunk).alias("k"), "last_k")
    )
    cells = (
        events.filter(F.col("modality").isin(names))
        .select("patient_id", grid_cell(F.col("t"), step).alias("k"), "modality", event.alias("_e"))
        .unionByName(marks, allowMissingColumns=True)
        .groupBy("patient_id", "k")
        .agg(
            F.max("last_k").alias("last_k"),
            *[F.max(F.when(F.col("modality") == m, F.col("_e"))).alias(m) for m in names],
        )
    )
    filled = carried(
        cells,
        ["patient_id"],
        "k",
        chunk,
        last={"last_k": F.col("last_k"), **{m: F.col(m) for m in names}},
        keep_chunk=True,
    )
    following = F.lead("k").over(chunk_window(["patient_id"], "k"))
    end = F.coalesce(following - 1, F.least(F.col("last_k"), (F.col(CHUNK) + 1) * chunk - 1))
    return (
        filled.withColumn("_end", end)
        .withColumn("k", F.explode(F.sequence(F.col("k"), F.col("_end"))))
        .withColumn("t", F.col("k") * dbl(step))
        .select("patient_id", CHUNK, "k", "t", *names)
    )


def risk_points(
    events: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    step: float = STEP_S,
    half_life: float = HALF_LIFE_S,
    chunk: int = GRID_CHUNK,
) -> DataFrame:
    """Score, contributions, missing modalities and contributing events per grid point."""
    names = list(weights)
    grid = chunked_grid(events, weights, step, chunk)
    part = {
        m: dbl(weights[m]) * F.col(f"{m}.severity") * half_life_decay(F.col("t") - F.col(f"{m}.t"), half_life)
        for m in names
    }
    grid = grid.select("*", *[part[m].alias(f"_p_{m}") for m in names])
    score = dbl(0)
    for m in names:
        score = score + F.coalesce(F.col(f"_p_{m}"), dbl(0))
    entries = F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("modality"), F.col(f"_p_{m}").alias("part"))) for m in names])
    missing = F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in names])
    contributing = F.array(
        *[
            F.when(
                F.col(m).isNotNull(),
                F.struct(
                    F.lit(m).alias("modality"),
                    F.col(f"{m}.t").alias("t"),
                    F.col(f"{m}.severity").alias("severity"),
                    F.col(f"{m}.summary").alias("summary"),
                    F.col(f"{m}.evidence_id").alias("evidence_id"),
                ),
            )
            for m in names
        ]
    )
    return grid.select(
        "patient_id",
        CHUNK,
        "k",
        "t",
        score.alias("score"),
        F.map_from_entries(F.array_compact(entries)).alias("contributions"),
        F.array_compact(missing).alias("missing"),
        F.array_compact(contributing).alias("events"),
    )


def hysteresis_level(
    points: DataFrame,
    yellow: float = YELLOW,
    red: float = RED,
    band: float = BAND,
    keys: tuple[str, ...] = ("patient_id",),
    pos: str = "k",
    chunk: int = GRID_CHUNK,
) -> DataFrame:
    """Banded level per point, with the level of the point before.

    A score acts on the current level (0, 1, 2) as a clamp. Clamps to one value
    reset the level; after a reset only the first half-open clamp on the far side
    can still move it, to the middle. So the level follows from the last reset and
    the last positions of the two half-open clamps: three carried columns, no fold.
    """
    if not (yellow <= red and band >= 0):
        raise ValueError("need yellow <= red and a band that is not negative")
    s = F.col("score")
    lo = F.when(s > dbl(red + band), 2).when(s > dbl(yellow + band), 1).otherwise(0)
    hi = F.when(s < dbl(yellow - band), 0).when(s < dbl(red - band), 1).otherwise(2)
    at = F.col(pos)
    out = carried(
        points,
        keys,
        pos,
        chunk,
        chunk=F.col(CHUNK) if CHUNK in points.columns else None,
        last={
            "_reset": F.when(lo == hi, F.struct(at.alias("at"), lo.alias("to"))),
            "_raise": F.when((lo == 1) & (hi == 2), at),
            "_lower": F.when((lo == 0) & (hi == 1), at),
        },
        with_before=True,
    )

    def level(suffix: str) -> Column:
        to = F.coalesce(F.col(f"_reset{suffix}.to"), F.lit(0))
        since = F.coalesce(F.col(f"_reset{suffix}.at"), F.lit(-1))
        up = F.coalesce(F.col(f"_raise{suffix}") > since, F.lit(False))
        down = F.coalesce(F.col(f"_lower{suffix}") > since, F.lit(False))
        value = F.when((to == 0) & up, 1).when((to == 2) & down, 1).otherwise(to)
        return F.when(value == 2, LEVELS[2]).when(value == 1, LEVELS[1]).otherwise(LEVELS[0])

    kept = [c for c in points.columns if c != CHUNK]
    return out.select(*kept, level("").alias("level"), level("_before").alias("previous_level"))


def transitions(levelled: DataFrame) -> DataFrame:
    return levelled.filter(F.col("level") != F.col("previous_level"))


def alert_triggers(levelled: DataFrame, alert_level: str = ALERT_LEVEL) -> DataFrame:
    return transitions(levelled).filter(F.col("level") == alert_level)


def alert_key(events: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(events, lambda e: e["evidence_id"])), "|")


def alert_payload(events: Column) -> Column:
    return F.transform(
        events,
        lambda e: F.struct(
            e["modality"].alias("modality"),
            e["summary"].alias("summary"),
            F.concat(F.lit("/evidence/"), e["evidence_id"]).alias("link"),
        ),
    )


def clinical_reason(t: Column, events: Column, contributions: Column) -> Column:
    def said(e: Column) -> Column:
        age = F.bround(t - e["t"], 0).cast("long")
        when = (
            F.when(age <= 1, F.lit("now"))
            .when(age < 60, F.concat(age.cast("string"), F.lit("s ago")))
            .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("min ago")))
            .otherwise(F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago")))
        )
        return F.concat(F.lit("["), e["modality"], F.lit("] "), e["summary"], F.lit(" ("), when, F.lit(")"))

    listed = F.transform(
        F.array_sort(F.map_entries(contributions)),
        lambda kv: F.concat(kv["key"], F.lit(": "), fixed(kv["value"], 2)),
    )
    tail = F.when(
        F.size(contributions) > 1,
        F.array(F.concat(F.lit("(contributions: "), F.array_join(listed, " | "), F.lit(")"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(events) == 0, F.lit("elevated risk")).otherwise(
        F.array_join(F.concat(F.transform(events, said), tail), " — ")
    )


def dedup_alerts(
    levelled: DataFrame, existing: DataFrame | None = None, alert_level: str = ALERT_LEVEL
) -> DataFrame:
    """One alert per (patient, set of evidence): the earliest trigger, unless that set
    is already stored in ``existing(patient_id, alert_key)``."""
    fired = alert_triggers(levelled, alert_level).withColumn("alert_key", alert_key(F.col("events")))
    if existing is not None:
        fired = fired.join(existing.select("patient_id", "alert_key"), ["patient_id", "alert_key"], "left_anti")
    first = fired.groupBy("patient_id", "alert_key").agg(
        F.min_by(F.struct("k", "t", "level", "score", "events", "contributions"), "k").alias("_f")
    )
    return first.select(
        "patient_id",
        "alert_key",
        F.col("_f.t").alias("t"),
        F.col("_f.level").alias("level"),
        exact_round(F.col("_f.score"), 2).alias("score"),
        clinical_reason(F.col("_f.t"), F.col("_f.events"), F.col("_f.contributions")).alias("reason"),
        alert_payload(F.col("_f.events")).alias("payload"),
    )


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy("patient_id", "t", "seq")


def metadata_summary(metadata: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(metadata), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"])), ", "
    )


def current_level(levelled: DataFrame) -> DataFrame:
    return levelled.groupBy("patient_id").agg(F.max_by("level", "k").alias("level"))
