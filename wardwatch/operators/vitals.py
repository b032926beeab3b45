"""Vital-sign operators on long sample tables ``(record_id, channel, idx, x)``.

``idx`` is the dense sample number of a record and channel. Window statistics come
from one grouped array per window, whose length is the window size; everything
that looks across windows or samples uses chunked scans, so one long record does
not sit in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.functions.guards import count_where, dbl, gt_num, lt_num, nan_if, ratio
from wardwatch.functions.text import exact_round, fixed
from wardwatch.operators.quality import binary_metrics, zero_filled
from wardwatch.plans.joins import interval_join
from wardwatch.plans.ordered import DEFAULT_CHUNK, carried, chunk_window, core_rows, with_halo
from wardwatch.plans.runs import runs

KEYS = ("record_id", "channel")

# Defaults of the signal analysis.
MAX_GAP_S = 5.0
MAX_INVALID = 0.5
DECELERATION_DROP = 15.0
DECELERATION_S = 15.0
Z_THRESHOLD = 3.0
BASELINE_WINDOWS = 20
TAU = 0.15
ACIDOSIS_PH = 7.05
HR_LOW, HR_HIGH = 60.0, 100.0
SPO2_LOW, SUSTAINED = 90.0, 0.5

FEATURES = ["mean", "std", "min", "max", "baseline", "short_term_variability", "deceleration_count"]


def mark_signal_loss(samples: DataFrame, mode: str = "ctg", zero_channels: tuple[str, ...] = ("FHR",)) -> DataFrame:
    """``ctg``: NaN is loss, and so is zero on ``zero_channels``; on others, such as
    contractions, zero is a genuine value. ``bedside``: NaN or not positive is loss. A
    null sample is loss in either mode."""
    x = F.col("x")
    if mode == "ctg":
        lost = F.isnan(x) | ((x == 0) & F.coalesce(F.col("channel").isin(*zero_channels), F.lit(False)))
    elif mode == "bedside":
        lost = F.isnan(x) | (x <= 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return samples.withColumn("invalid", x.isNull() | F.coalesce(lost, F.lit(False)))


def invalid_runs(marked: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    return runs(marked, KEYS, "idx", F.col("invalid"), chunk)


def interpolate_gaps(
    marked: DataFrame, max_gap_s: float = MAX_GAP_S, fs: float = 1.0, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Linear fill of gaps of at most ``int(max_gap_s * fs)`` samples with valid
    neighbours on both sides; longer gaps keep their value and stay invalid."""
    limit = int(max_gap_s * fs)
    if limit < 1:
        return marked
    rows = with_halo(marked, "idx", chunk, before=limit, after=limit)
    known = F.when(~F.col("invalid"), F.struct("idx", "x"))
    w = chunk_window(KEYS, "idx")
    rows = rows.withColumn("_l", F.last(known, ignorenulls=True).over(w.rowsBetween(-limit, 0))).withColumn(
        "_r", F.first(known, ignorenulls=True).over(w.rowsBetween(0, limit))
    )
    gap = F.col("_r.idx") - F.col("_l.idx")
    fill = F.coalesce(F.col("invalid") & (gap - 1 <= limit), F.lit(False))
    step = (F.col("_r.x") - F.col("_l.x")) * (F.col("idx") - F.col("_l.idx")) / gap
    rows = rows.withColumn("x", F.when(fill, F.col("_l.x") + step).otherwise(F.col("x"))).withColumn(
        "invalid", F.col("invalid") & ~fill
    )
    return core_rows(rows).drop("_l", "_r")


def window_numbers(idx: Column, n: int, step: int) -> Column:
    """Numbers of the windows ``[k*step, k*step+n)`` that contain sample ``idx``."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((idx - (n - 1)) / F.lit(step)).cast("long"))
    last = F.floor(idx / F.lit(step)).cast("long")
    return F.when(last >= first, F.sequence(first, last))


def sliding_windows(
    marked: DataFrame, size_s: float, stride_s: float, fs: float = 1.0, max_invalid: float = MAX_INVALID, mask_features: bool = False
) -> DataFrame:
    """Complete windows with their samples in order: ``k, start_s, end_s, insufficient, w``.

    A window is complete when all its samples arrived, which its row count shows;
    the record length is not needed. The sample array has the window size; with
    ``mask_features`` it leaves invalid samples out, so that no feature sees them.
    """
    n, step = int(size_s * fs), int(stride_s * fs)
    if n <= 0 or step <= 0:
        raise ValueError("window size and stride must be positive")
    placed = marked.withColumn("k", F.explode(window_numbers(F.col("idx"), n, step)))
    grouped = (
        placed.groupBy(*KEYS, "k")
        .agg(
            F.array_sort(F.collect_list(F.struct("idx", "x", "invalid"))).alias("_s"),
            F.avg(F.col("invalid").cast("double")).alias("_bad"),
        )
        .filter(F.size("_s") == n)
    )
    return grouped.select(
        *KEYS,
        "k",
        (F.col("k") * step / dbl(fs)).alias("start_s"),
        ((F.col("k") * step + n) / dbl(fs)).alias("end_s"),
        (F.col("_bad") > dbl(max_invalid)).alias("insufficient"),
        (F.transform(F.filter("_s", lambda s: ~s["invalid"]), lambda s: s["x"]) if mask_features else F.col("_s.x")).alias("w"),
    )


def array_mean(a: Column) -> Column:
    return F.aggregate(a, dbl(0), lambda s, v: s + v) / F.size(a)


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    lower = F.get(s, F.floor((n - 1) / F.lit(2)).cast("int"))
    upper = F.get(s, F.floor(n / F.lit(2)).cast("int"))
    return (lower + upper) / dbl(2)


def deceleration_count(w: Column, floor: Column, min_run: int) -> Column:
    """Runs of at least ``min_run`` samples below ``floor``; an open last run counts."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(lt_num(x, floor), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), (acc["n"] + F.when(run == min_run, 1).otherwise(0)).alias("n"))

    return F.aggregate(w, start, step, lambda acc: acc["n"])


def window_features(
    windows: DataFrame, fs: float = 1.0, drop: float = DECELERATION_DROP, min_run: int | None = None
) -> DataFrame:
    """Seven features per window. Insufficient windows have NULL features; a NaN
    sample makes every statistic NaN."""
    run = max(1, int(DECELERATION_S * fs) if min_run is None else min_run)
    w = F.col("w")
    n = F.size(w)
    base = windows.select(
        *[c for c in windows.columns if c != "w"],
        "w",
        F.exists(w, lambda x: F.isnan(x)).alias("_nan"),
        array_mean(w).alias("mean"),
        array_median(w).alias("_median"),
    ).withColumn("valid", ~F.col("insufficient"))
    deviation = F.sqrt(array_mean(F.transform(w, lambda x: (x - F.col("mean")) * (x - F.col("mean")))))
    steps = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.abs(b - a))
    variability = F.when(n > 1, array_mean(steps)).otherwise(dbl(0))
    nan = F.col("_nan")
    values = {
        "mean": nan_if(nan, F.col("mean")),
        "std": nan_if(nan, deviation),
        "min": nan_if(nan, F.array_min(w)),
        "max": nan_if(nan, F.array_max(w)),
        "baseline": nan_if(nan, F.col("_median")),
        "short_term_variability": nan_if(nan, variability),
        "deceleration_count": deceleration_count(w, nan_if(nan, F.col("_median")) - dbl(drop), run).cast("double"),
    }
    kept = [c for c in windows.columns if c != "w"]
    return base.select(*kept, "valid", *[F.when(F.col("valid"), values[f]).alias(f) for f in FEATURES])


def rolling_zscore(
    features: DataFrame,
    threshold: float = Z_THRESHOLD,
    baseline_size: int = BASELINE_WINDOWS,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Deviation of a window mean from the previous ``baseline_size`` valid windows.

    Adds ``score`` and ``flag``; NULL without a full baseline or for invalid windows.
    """
    if threshold <= 0 or baseline_size < 2:
        raise ValueError("threshold must be positive and the baseline at least 2")
    counted = carried(
        features.filter("valid"), KEYS, "k", chunk, sums={"_j": F.lit(1).cast("long")}
    )
    rows = with_halo(counted, "_j", chunk, before=baseline_size)
    frame = chunk_window(KEYS, "_j").rowsBetween(-baseline_size, -1)
    m = F.col("mean")
    seen = F.count(m).over(frame)
    lo, hi, avg, sd = F.min(m).over(frame), F.max(m).over(frame), F.avg(m).over(frame), F.stddev_pop(m).over(frame)
    flat = F.when(m == lo, dbl(0)).otherwise(dbl(float("inf")))
    scored = core_rows(rows.withColumn("score", F.when(seen == baseline_size, F.when(lo == hi, flat).otherwise(F.abs(m - avg) / sd))))
    scored = scored.drop("_j").withColumn("flag", gt_num(F.col("score"), dbl(threshold)))
    rest = (
        features.filter("not valid")
        .withColumn("score", F.lit(None).cast("double"))
        .withColumn("flag", F.lit(None).cast("boolean"))
    )
    return scored.unionByName(rest)


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"zscore": rolling_zscore}


def run_detectors(features: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every named detector over the same windows, stacked under ``detector``."""
    parts = [fn(features).withColumn("detector", F.lit(name)) for name, fn in detectors.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_verdict(flags: DataFrame, tau: float = TAU, by: Sequence[str] = ("record_id", "detector")) -> DataFrame:
    """Pathological when the flagged share of valid windows exceeds ``tau``."""
    if not 0 <= tau <= 1:
        raise ValueError("tau must be in [0, 1]")
    out = flags.groupBy(*by).agg(
        F.count("flag").alias("n_valid"),
        count_where(F.col("flag").isNull()).alias("n_excluded"),
        ratio(count_where(F.col("flag")), F.count("flag")).alias("fraction"),
    )
    return out.withColumn("predicted", F.col("fraction") > dbl(tau))


def evaluate_verdicts(verdicts: DataFrame, records: DataFrame, ph_limit: float = ACIDOSIS_PH) -> DataFrame:
    """Verdicts against the pH outcome, per detector. Indeterminate verdicts are
    counted and left out; verdicts without a record are ignored."""
    joined = verdicts.join(records.select("record_id", (F.col("ph") < dbl(ph_limit)).alias("pathological")), "record_id")
    metrics = binary_metrics(joined.filter(F.col("predicted").isNotNull()), "pathological", "predicted", ["detector"])
    extra = joined.groupBy("detector").agg(
        count_where(F.col("predicted").isNull()).alias("n_indeterminate"),
        F.avg(F.col("pathological").cast("double")).alias("prevalence"),
    )
    return extra.join(metrics, "detector", "left")


def resample_linear(samples: DataFrame, fs_from: float, fs_to: float, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Linear resampling: each sample produces the output points up to the next one;
    past the last sample the value is held."""
    rows = with_halo(samples, "idx", chunk, after=1)
    rows = core_rows(rows.withColumn("_next", F.lead(F.struct("x", "idx")).over(chunk_window(KEYS, "idx"))))
    i, r = F.col("idx"), fs_to / fs_from
    final = F.col("_next").isNull()
    total = F.floor((i + 1) / dbl(fs_from) * dbl(fs_to)).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.ceil(i * dbl(r)).cast("long") - 1)
    last = F.when(final, total - 1).otherwise(F.ceil((i + 1) * dbl(r)).cast("long") + 1)
    spread = rows.withColumn("_j", F.explode(F.when(last >= first, F.sequence(first, last))))
    at = F.col("_j") / dbl(fs_to) * dbl(fs_from)
    spread = spread.filter((at >= i) & (final | (at < i + 1)))
    value = F.when(final, F.col("x")).otherwise(F.col("x") + (F.col("_next.x") - F.col("x")) * (at - i))
    return spread.select(*KEYS, F.col("_j").alias("idx"), value.alias("x"))


def compose_timeline(samples: DataFrame, records: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concatenate records in the declared order ``(timeline_id, ord, record_id)``.

    Returns the re-indexed samples, the provenance segments (half-open ranges), and
    one row per timeline with the rate of its first record and its lowest pH. Each of
    them fails when a declared record has no samples; ``missing_records`` lists those.
    """
    lengths = samples.groupBy("record_id").agg((F.max("idx") + 1).alias("_n"))
    upto = Window.partitionBy("timeline_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    absent = F.raise_error(F.concat(F.lit("declared record without samples: "), F.col("record_id"))).cast("long")
    declared = order.join(lengths, "record_id", "left").withColumn("_n", F.coalesce("_n", absent))
    placed = declared.withColumn("start_idx", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    provenance = placed.select(
        "timeline_id", "ord", "record_id", "start_idx", (F.col("start_idx") + F.col("_n")).alias("end_idx")
    )
    moved = samples.join(provenance.select("timeline_id", "record_id", "start_idx"), "record_id").select(
        F.col("timeline_id").alias("record_id"), "channel", (F.col("start_idx") + F.col("idx")).alias("idx"), "x"
    )
    composed = (
        declared.filter("_n > 0")
        .join(records, "record_id")
        .groupBy(F.col("timeline_id").alias("record_id"))
        .agg(F.min_by("fs", "ord").alias("fs"), F.min("ph").alias("ph"))
    )
    return moved, provenance, composed


def missing_records(order: DataFrame, samples: DataFrame) -> DataFrame:
    """Declared records that have no samples; composing needs this to be empty."""
    return order.join(samples.select("record_id").distinct(), "record_id", "left_anti")


def anomaly_events(scored: DataFrame) -> DataFrame:
    """Flagged windows as events with a readable id."""
    ident = F.concat_ws("-", "record_id", "detector", F.concat(fixed(F.col("start_s"), 0), F.lit("s")))
    return scored.filter("flag").select(
        "record_id", "detector", "k", "start_s", "end_s", "score", ident.alias("evidence_id")
    )


def provenance_of(events: DataFrame, provenance: DataFrame, fs: float = 1.0, width: int = 1 << 16) -> DataFrame:
    """Source record of each event; its own record where no segment covers it."""
    points = events.withColumn("_at", F.floor(F.col("start_s") * dbl(fs)).cast("long"))
    segs = provenance.select(
        F.col("timeline_id").alias("record_id"), F.col("record_id").alias("_source"), "start_idx", "end_idx"
    )
    hit = interval_join(points, segs, ["record_id"], "_at", "start_idx", "end_idx", width, "left")
    return hit.withColumn("source_record_id", F.coalesce("_source", "record_id")).drop(
        "_at", "_source", "start_idx", "end_idx"
    )


def positive(w: Column) -> Column:
    return F.filter(w, lambda x: ~F.isnan(x) & (x > 0))


def hr_out_of_range(w: Column, low: float = HR_LOW, high: float = HR_HIGH) -> Column:
    ok = positive(w)
    m = array_median(ok)
    return F.coalesce((F.size(ok) > 0) & ((m < dbl(low)) | (m > dbl(high))), F.lit(False))


def sustained_hypoxemia(w: Column, low: float = SPO2_LOW, share: float = SUSTAINED) -> Column:
    ok = positive(w)
    below = F.size(F.filter(ok, lambda x: x < dbl(low)))
    return F.coalesce(ratio(below, F.size(ok)) >= dbl(share), F.lit(False))


def clinical_truth(
    windows: DataFrame,
    criteria: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Adds ``truth`` by channel; criteria are Column builders over the sample array."""
    rules = criteria or {"HR": hr_out_of_range, "SpO2": sustained_hypoxemia}
    out = None
    for channel, rule in rules.items():
        hit = F.col("channel") == channel
        out = F.when(hit, rule(F.col("w"))) if out is None else out.when(hit, rule(F.col("w")))
    return windows.withColumn("truth", out.otherwise(F.lit(False)))


def evaluate_signal(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per record and channel: window count, clinical events, metrics (zero when
    undefined) and the first anomalous window. NULL predictions read as false."""
    joined = truth.select(*KEYS, "k", "start_s", "end_s", "truth").join(predicted.select(*KEYS, "k", "flag"), [*KEYS, "k"], "left")
    joined = joined.withColumn("flag", F.coalesce("flag", F.lit(False)))
    metrics = zero_filled(binary_metrics(joined, "truth", "flag", KEYS))
    first = joined.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_windows"),
        count_where(F.col("truth")).alias("n_events"),
        F.min_by(F.struct("start_s", "end_s"), F.when(F.col("truth"), F.col("k"))).alias("_f"),
    )
    return first.join(metrics, list(KEYS)).select(
        *KEYS,
        "n_windows",
        "n_events",
        "precision",
        "recall",
        "f1",
        F.col("_f.start_s").alias("first_start_s"),
        F.col("_f.end_s").alias("first_end_s"),
    )


def sweep_records(truth: DataFrame) -> DataFrame:
    """Records with any clinical event, most events first."""
    n = (
        truth.groupBy("record_id")
        .pivot("channel", ["HR", "SpO2"])
        .agg(F.sum(F.col("truth").cast("long")))
        .select("record_id", F.coalesce("HR", F.lit(0)).alias("hr_events"), F.coalesce("SpO2", F.lit(0)).alias("spo2_events"))
    )
    total = F.col("hr_events") + F.col("spo2_events")
    return n.filter(total > 0).orderBy(total.desc(), "record_id")


def headline_finding(truth: DataFrame) -> DataFrame:
    """The most urgent finding per record: hypoxemia before heart rate."""
    per = (
        truth.withColumn("_w", F.when(F.col("truth"), F.struct("k", "start_s", "end_s", array_median(positive(F.col("w"))).alias("median"))))
        .groupBy("record_id")
        .agg(
            F.min(F.when(F.col("channel") == "SpO2", F.col("_w"))).alias("o"),
            F.min(F.when(F.col("channel") == "HR", F.col("_w"))).alias("h"),
        )
    )

    def minutes(e: str) -> Column:
        a, b = F.floor(F.col(f"{e}.start_s") / 60).cast("string"), F.floor(F.col(f"{e}.end_s") / 60).cast("string")
        return F.concat(F.lit("between "), a, F.lit(" and "), b, F.lit(" minutes"))

    kind = F.when(F.col("h.median") > dbl(HR_HIGH), "tachycardia").otherwise("bradycardia")
    has_o, has_h = F.col("o").isNotNull(), F.col("h").isNotNull()
    summary = (
        F.when(has_o, F.concat(F.lit("Oxygen saturation below 90% (hypoxemia) "), minutes("o"), F.lit(".")))
        .when(has_h, F.concat(F.lit("Heart rate outside 60-100 bpm ("), kind, F.lit(") "), minutes("h"), F.lit(".")))
        .otherwise(F.lit("Vital signs without changes in the period."))
    )
    start = F.when(has_o, F.col("o.start_s")).otherwise(F.col("h.start_s"))
    name = F.when(has_o, "spo2").otherwise("hr")
    return per.select(
        "record_id",
        summary.alias("summary"),
        F.when(has_o | has_h, dbl(1)).otherwise(dbl(0)).alias("score"),
        F.when(has_o, "CRITICAL").when(has_h, "MEDIUM").alias("severity"),
        F.when(
            has_o | has_h,
            F.concat(F.col("record_id"), F.lit("-"), name, F.lit("-"), F.floor(start).cast("string"), F.lit("s")),
        ).alias("evidence_id"),
    )


def record_stats(
    marked: DataFrame, size_s: float, stride_s: float, fs: float = 1.0, valid_only: bool = True
) -> DataFrame:
    """Rounded min, max and mean, duration, number of complete windows and of samples
    that are still invalid. ``valid_only`` is the cardiotocography rule; the bedside
    rule takes every sample."""
    n, step = int(size_s * fs), int(stride_s * fs)
    x = F.when(~F.col("invalid"), F.col("x")) if valid_only else F.col("x")
    total = F.count(F.lit(1))
    return marked.groupBy(*KEYS).agg(
        exact_round(F.min(x), 1).alias("min"),
        exact_round(F.max(x), 1).alias("max"),
        exact_round(F.round(F.avg(x), 9), 1).alias("mean"),
        exact_round(total / dbl(fs), 1).alias("duration_s"),
        F.when(total >= n, F.floor((total - n) / F.lit(step)).cast("long") + 1).otherwise(F.lit(0).cast("long")).alias("n_windows"),
        count_where(F.col("invalid")).alias("n_invalid"),
    )


def worst_window(scored: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Flagged window with the highest score, earliest on ties."""
    best = F.max_by(F.struct("k", "start_s", "end_s", "score"), F.struct(F.col("score"), -F.col("k")))
    return (
        scored.filter("flag")
        .groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, "_b.k", "_b.start_s", "_b.end_s", "_b.score")
    )
