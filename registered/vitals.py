"""Vital-sign operators on the bridge samples: window 6, stride 2, gap 2, baseline 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import forest as IF
from wardwatch.operators import vitals as VI

fam = Family()
SIZE, STRIDE, GAP, BASE, Z = 6.0, 2.0, 2.0, 5, 1.5


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return VI.interpolate_gaps(VI.mark_signal_loss(V.samples(spark, sf)), GAP, 1.0)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return VI.sliding_windows(clean(spark, sf), SIZE, STRIDE)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return VI.window_features(windows(spark, sf), min_run=2)


def zscores(spark: SparkSession, sf: str) -> DataFrame:
    return VI.rolling_zscore(features(spark, sf), Z, BASE).withColumn("detector", F.lit("zscore"))


def bedside_windows(spark: SparkSession, sf: str) -> DataFrame:
    marked = VI.mark_signal_loss(V.bedside_samples(spark, sf), "bedside")
    return VI.sliding_windows(marked, SIZE, STRIDE)


def bedside_truth(spark: SparkSession, sf: str) -> DataFrame:
    return VI.clinical_truth(bedside_windows(spark, sf))


cte("marked", "SELECT *, x = 0 OR isnan(x) AS invalid FROM samples", "samples")
cte(
    "gap_runs",
    """SELECT record_id, min(idx) AS s, max(idx) + 1 AS e FROM (
      SELECT record_id, idx, idx - row_number() OVER (PARTITION BY record_id ORDER BY idx) AS g FROM marked WHERE invalid)
    GROUP BY record_id, g""",
    "marked",
)
cte(
    "fills",
    """SELECT g.record_id, g.s, g.e, l.x AS lx, r.x AS rx FROM gap_runs g
    JOIN marked l ON l.record_id = g.record_id AND l.idx = g.s - 1
    JOIN marked r ON r.record_id = g.record_id AND r.idx = g.e WHERE g.e - g.s <= 2""",
    "gap_runs",
)
cte(
    "clean",
    """SELECT m.record_id, m.channel, m.idx, m.invalid AND f.s IS NULL AS invalid,
      CASE WHEN f.s IS NULL THEN m.x ELSE lx + (rx - lx) * (m.idx - (f.s - 1)) / (f.e - f.s + 1)::DOUBLE END AS x
    FROM marked m LEFT JOIN fills f ON m.invalid AND f.record_id = m.record_id AND m.idx >= f.s AND m.idx < f.e""",
    "fills",
)


def window_cte(name: str, src: str) -> None:
    cte(
        name,
        f"""SELECT record_id, channel, k, k * 2.0::DOUBLE AS start_s, k * 2.0::DOUBLE + 6.0 AS end_s,
          avg(invalid::INT) > 0.5 AS insufficient, list(x ORDER BY idx) AS w
        FROM {src} JOIN (SELECT record_id AS rid, channel AS ch, unnest(range(0, (count(*) - 6) // 2 + 1)) AS k
          FROM {src} GROUP BY 1, 2 HAVING count(*) >= 6) ON rid = record_id AND ch = channel AND idx >= 2 * k AND idx < 2 * k + 6
        GROUP BY record_id, channel, k""",
        src,
    )


window_cte("windows", "clean")
cte(
    "decel",
    """SELECT record_id, k, count(*) FILTER (len >= 2) AS n FROM (
      SELECT record_id, k, g, count(*) AS len FROM (
        SELECT record_id, k, i, i - row_number() OVER (PARTITION BY record_id, k ORDER BY i) AS g FROM (
          SELECT record_id, k, i, w[i] AS x, list_median(w) - 15.0 AS lim FROM windows, LATERAL (SELECT unnest(range(1, 7)) AS i)) WHERE x < lim)
      GROUP BY record_id, k, g) GROUP BY record_id, k""",
    "windows",
)
cte(
    "features",
    """SELECT w.record_id, w.channel, w.k, start_s, end_s, NOT insufficient AS valid,
      CASE WHEN NOT insufficient THEN list_avg(w) END AS mean,
      CASE WHEN NOT insufficient THEN list_stddev_pop(w) END AS std,
      CASE WHEN NOT insufficient THEN list_min(w) END AS min,
      CASE WHEN NOT insufficient THEN list_max(w) END AS max,
      CASE WHEN NOT insufficient THEN list_median(w) END AS baseline,
      CASE WHEN NOT insufficient THEN list_avg(list_transform(range(1, 6), lambda i: abs(w[i + 1] - w[i]))) END AS short_term_variability,
      CASE WHEN NOT insufficient THEN coalesce(d.n, 0)::DOUBLE END AS deceleration_count
    FROM windows w LEFT JOIN decel d ON d.record_id = w.record_id AND d.k = w.k""",
    "windows",
    "decel",
)
cte(
    "zs",
    """SELECT *, CASE WHEN score IS NULL THEN NULL ELSE score > 1.5 END AS flag, 'zscore' AS detector FROM (
    SELECT f.record_id, f.channel, f.k, start_s, end_s, valid, mean,
      CASE WHEN n = 5 THEN CASE WHEN lo = hi THEN CASE WHEN mean = lo THEN 0.0 ELSE 'inf'::DOUBLE END ELSE abs(mean - m) / sd END END AS score
    FROM features f LEFT JOIN (
      SELECT record_id, k, count(mean) OVER b AS n, min(mean) OVER b AS lo, max(mean) OVER b AS hi, avg(mean) OVER b AS m, stddev_pop(mean) OVER b AS sd
      FROM features WHERE valid WINDOW b AS (PARTITION BY record_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) z
      ON z.record_id = f.record_id AND z.k = f.k)""",
    "features",
)
cte(
    "verdicts",
    """SELECT *, fraction > 0.15::DOUBLE AS predicted FROM (SELECT record_id, detector, count(flag) AS n_valid,
      count(*) FILTER (flag IS NULL) AS n_excluded, count(*) FILTER (flag) / nullif(count(flag), 0)::DOUBLE AS fraction
      FROM zs GROUP BY record_id, detector)""",
    "zs",
)


@fam.add("vit_mark_signal_loss", stmt("SELECT record_id, idx, x, invalid FROM marked", "marked"))
def _mark(spark, sf):
    return VI.mark_signal_loss(V.samples(spark, sf)).select("record_id", "idx", "x", "invalid")


@fam.add(
    "vit_mark_signal_loss_bedside",
    stmt("SELECT record_id, channel, idx, isnan(x) OR x <= 0 AS invalid FROM bedside", "bedside"),
)
def _mark_bedside(spark, sf):
    return VI.mark_signal_loss(V.bedside_samples(spark, sf), "bedside").select("record_id", "channel", "idx", "invalid")


@fam.add("vit_invalid_runs", stmt("SELECT record_id, s AS run_start, e AS run_end, e - s AS run_len FROM gap_runs", "gap_runs"))
def _runs(spark, sf):
    return VI.invalid_runs(VI.mark_signal_loss(V.samples(spark, sf))).drop("channel")


@fam.add("vit_interpolate_gaps", stmt("SELECT record_id, idx, round(x, 6) AS x, invalid FROM clean", "clean"))
def _interp(spark, sf):
    return clean(spark, sf).select("record_id", "idx", F.round("x", 6).alias("x"), "invalid")


@fam.add(
    "vit_sliding_windows",
    stmt("SELECT record_id, k, start_s, end_s, insufficient, len(w)::BIGINT AS n, round(list_sum(w), 6) AS total FROM windows", "windows"),
)
def _windows(spark, sf):
    total = F.aggregate("w", dbl(0), lambda a, b: a + b)
    return windows(spark, sf).select(
        "record_id", "k", "start_s", "end_s", "insufficient", F.size("w").cast("long").alias("n"), F.round(total, 6).alias("total")
    )


ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in VI.FEATURES)


@fam.add("vit_window_features", stmt(f"SELECT record_id, k, valid, {ROUNDED} FROM features", "features"))
def _features(spark, sf):
    return features(spark, sf).select("record_id", "k", "valid", *[F.round(f, 6).alias(f) for f in VI.FEATURES])


@fam.add("vit_deceleration_count", stmt("SELECT record_id, k, deceleration_count FROM features", "features"))
def _decel(spark, sf):
    return features(spark, sf).select("record_id", "k", "deceleration_count")


@fam.add("vit_rolling_zscore", stmt("SELECT record_id, k, round(score, 6) AS score, flag FROM zs", "zs"))
def _z(spark, sf):
    return zscores(spark, sf).select("record_id", "k", F.round("score", 6).alias("score"), "flag")


@fam.add("vit_isolation_forest")
def _forest(spark, sf):
    scored = IF.isolation_forest(features(spark, sf), contamination=0.1, seed=42)
    return scored.select("record_id", "k", F.round("score", 6).alias("score"), "flag")


@fam.add(
    "vit_forest_faults",
    stmt(
        """SELECT record_id, count(*) AS windows, CASE WHEN count(*) FILTER (valid) >= 10 THEN count(*) FILTER (valid) ELSE 0 END AS scored,
        0::BIGINT AS outside, 0::BIGINT AS unexpected, 0::BIGINT AS extra, false AS mixed FROM features GROUP BY 1""",
        "features",
    ),
)
def _forest_faults(spark, sf):
    """Every window of every record has a score exactly when it should, flags follow the scores."""
    return IF.forest_faults(IF.isolation_forest(features(spark, sf), contamination=0.1, seed=42), 0.1)


@fam.add("vit_record_verdict", stmt("SELECT record_id, detector, n_valid, n_excluded, round(fraction, 6) AS fraction, predicted FROM verdicts", "verdicts"))
def _verdict(spark, sf):
    return VI.record_verdict(zscores(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@fam.add(
    "vit_evaluate_verdicts",
    stmt(
        """SELECT detector, n_indeterminate, round(prevalence, 6) AS prevalence, tp, fp, fn, tp + fn AS support,
          round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
          round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (
        SELECT detector, count(*) FILTER (predicted IS NULL) AS n_indeterminate, avg((ph < 7.05::DOUBLE)::INT) AS prevalence,
          count(*) FILTER (predicted AND ph < 7.05::DOUBLE) AS tp, count(*) FILTER (predicted AND NOT ph < 7.05::DOUBLE) AS fp,
          count(*) FILTER (NOT predicted AND ph < 7.05::DOUBLE) AS fn FROM verdicts JOIN records USING (record_id) GROUP BY detector)""",
        "verdicts",
        "records",
    ),
)
def _evaluate(spark, sf):
    out = VI.evaluate_verdicts(VI.record_verdict(zscores(spark, sf)), V.records(spark, sf))
    return out.select(
        "detector", "n_indeterminate", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ["prevalence", "precision", "recall", "f1"]]
    )


@fam.add(
    "vit_resample_linear",
    stmt(
        """SELECT a.record_id, j AS idx, round(CASE WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (j / 4.0::DOUBLE - a.idx) END, 6) AS x
        FROM (SELECT record_id, unnest(range(0, count(*) * 4)) AS j FROM samples GROUP BY record_id) g
        JOIN samples a ON a.record_id = g.record_id AND a.idx = g.j // 4
        LEFT JOIN samples b ON b.record_id = g.record_id AND b.idx = g.j // 4 + 1""",
        "samples",
    ),
)
def _resample(spark, sf):
    return VI.resample_linear(V.samples(spark, sf), 1.0, 4.0).select("record_id", "idx", F.round("x", 6).alias("x"))


def order_of(spark, sf):
    ids = V.table(spark, sf, "events").select("user_id").distinct()
    return ids.select(
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("timeline_id"),
        F.col("user_id").alias("ord"),
        F.col("user_id").cast("string").alias("record_id"),
    )


cte(
    "provenance",
    """SELECT timeline_id, ord, record_id, (sum(n) OVER w - n)::BIGINT AS start_idx, (sum(n) OVER w)::BIGINT AS end_idx FROM (
      SELECT 'T' || (record_id::BIGINT % 10) AS timeline_id, record_id::BIGINT AS ord, record_id, count(*) AS n FROM samples GROUP BY record_id)
    WINDOW w AS (PARTITION BY timeline_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""",
    "samples",
)


@fam.add("vit_compose_provenance", stmt("SELECT * FROM provenance", "provenance"))
def _compose_prov(spark, sf):
    return VI.compose_timeline(V.samples(spark, sf), V.records(spark, sf), order_of(spark, sf))[1]


@fam.add(
    "vit_compose_timeline",
    stmt(
        """SELECT timeline_id AS record_id, start_idx + idx AS idx, x, fs, ph FROM samples JOIN provenance USING (record_id)
        JOIN (SELECT 'T' || (record_id::BIGINT % 10) AS timeline_id, min(fs) AS fs, min(ph) AS ph FROM records GROUP BY 1) USING (timeline_id)""",
        "provenance",
        "records",
    ),
)
def _compose(spark, sf):
    moved, _, composed = VI.compose_timeline(V.samples(spark, sf), V.records(spark, sf), order_of(spark, sf))
    return moved.join(composed, "record_id").select("record_id", "idx", "x", "fs", "ph")


cte(
    "composed",
    "SELECT timeline_id AS record_id, 'FHR' AS channel, start_idx + idx AS idx, x, x = 0 AS invalid FROM samples JOIN provenance USING (record_id)",
    "provenance",
)
window_cte("composed_windows", "composed")


@fam.add(
    "vit_provenance_of",
    stmt(
        """SELECT w.record_id, w.k, coalesce(p.record_id, w.record_id) AS source_record_id FROM composed_windows w
        LEFT JOIN provenance p ON p.timeline_id = w.record_id AND w.start_s >= p.start_idx AND w.start_s < p.end_idx WHERE NOT insufficient""",
        "composed_windows",
    ),
)
def _prov(spark, sf):
    moved, provenance, _ = VI.compose_timeline(V.samples(spark, sf), V.records(spark, sf), order_of(spark, sf))
    wins = VI.sliding_windows(VI.mark_signal_loss(moved), SIZE, STRIDE).filter("not insufficient")
    return VI.provenance_of(wins.select("record_id", "k", "start_s"), provenance, width=256).select(
        "record_id", "k", "source_record_id"
    )


@fam.add(
    "vit_anomaly_events",
    stmt(
        """SELECT record_id, detector, k, start_s, end_s, round(score, 6) AS score,
        record_id || '-zscore-' || printf('%.0f', start_s) || 's' AS evidence_id FROM zs WHERE flag""",
        "zs",
    ),
)
def _events(spark, sf):
    return VI.anomaly_events(zscores(spark, sf)).withColumn("score", F.round("score", 6))


cte("bed_marked", "SELECT *, isnan(x) OR x <= 0 AS invalid FROM bedside", "bedside")
window_cte("bed_windows", "bed_marked")
cte(
    "truth",
    """SELECT *, list_filter(w, lambda v: v > 0) AS ok, CASE channel
      WHEN 'HR' THEN coalesce(list_median(list_filter(w, lambda v: v > 0)) < 60 OR list_median(list_filter(w, lambda v: v > 0)) > 100, false)
      ELSE coalesce(len(list_filter(w, lambda v: v > 0 AND v < 90)) / nullif(len(list_filter(w, lambda v: v > 0)), 0)::DOUBLE >= 0.5, false) END AS truth
    FROM bed_windows""",
    "bed_windows",
)


@fam.add("vit_hr_out_of_range", stmt("SELECT record_id, k, truth FROM truth WHERE channel = 'HR'", "truth"))
def _hr(spark, sf):
    return bedside_windows(spark, sf).filter("channel = 'HR'").select("record_id", "k", VI.hr_out_of_range(F.col("w")).alias("truth"))


@fam.add("vit_sustained_hypoxemia", stmt("SELECT record_id, k, truth FROM truth WHERE channel = 'SpO2'", "truth"))
def _spo2(spark, sf):
    return bedside_windows(spark, sf).filter("channel = 'SpO2'").select("record_id", "k", VI.sustained_hypoxemia(F.col("w")).alias("truth"))


cte(
    "bed_zs",
    """SELECT record_id, channel, k, CASE WHEN n = 5 THEN CASE WHEN lo = hi THEN m1 <> lo ELSE abs(m1 - m) / sd > 1.5 END END AS flag FROM (
      SELECT record_id, channel, k, m1, count(m1) OVER b AS n, min(m1) OVER b AS lo, max(m1) OVER b AS hi, avg(m1) OVER b AS m, stddev_pop(m1) OVER b AS sd
      FROM (SELECT *, list_avg(w) AS m1 FROM bed_windows WHERE NOT insufficient)
      WINDOW b AS (PARTITION BY record_id, channel ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
    "bed_windows",
)


@fam.add(
    "vit_evaluate_signal",
    stmt(
        """SELECT record_id, channel, n_windows, n_events, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
          round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
          first_k * 2.0::DOUBLE AS first_start_s, first_k * 2.0::DOUBLE + 6 AS first_end_s FROM (
        SELECT t.record_id, t.channel, count(*) AS n_windows, count(*) FILTER (truth) AS n_events, min(CASE WHEN truth THEN t.k END) AS first_k,
          count(*) FILTER (truth AND coalesce(flag, false)) AS tp, count(*) FILTER (NOT truth AND coalesce(flag, false)) AS fp,
          count(*) FILTER (truth AND NOT coalesce(flag, false)) AS fn
        FROM truth t LEFT JOIN bed_zs z ON z.record_id = t.record_id AND z.channel = t.channel AND z.k = t.k GROUP BY 1, 2)""",
        "truth",
        "bed_zs",
    ),
)
def _evaluate_signal(spark, sf):
    wins = bedside_windows(spark, sf)
    flags = VI.rolling_zscore(VI.window_features(wins, min_run=2), Z, BASE)
    out = VI.evaluate_signal(flags, VI.clinical_truth(wins))
    return out.select(
        "record_id", "channel", "n_windows", "n_events", "first_start_s", "first_end_s",
        *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]],
    )


@fam.add("vit_evaluate_signal_both_detectors")
def _evaluate_both(spark, sf):
    wins = bedside_windows(spark, sf)
    feats = VI.window_features(wins, min_run=2)
    z = VI.rolling_zscore(feats, Z, BASE).select(*VI.KEYS, "k", F.col("flag").alias("fz"))
    f = IF.isolation_forest(feats, contamination=0.1, seed=42).select(*VI.KEYS, "k", F.col("flag").alias("ff"))
    either = z.join(f, [*VI.KEYS, "k"], "full").withColumn(
        "flag", F.coalesce("fz", F.lit(False)) | F.coalesce("ff", F.lit(False))
    )
    return VI.evaluate_signal(either, VI.clinical_truth(wins))


@fam.add(
    "vit_sweep_records",
    stmt(
        """SELECT * FROM (SELECT record_id, count(*) FILTER (truth AND channel = 'HR') AS hr_events,
        count(*) FILTER (truth AND channel = 'SpO2') AS spo2_events FROM truth GROUP BY 1) WHERE hr_events + spo2_events > 0""",
        "truth",
    ),
)
def _sweep(spark, sf):
    return VI.sweep_records(bedside_truth(spark, sf))


@fam.add(
    "vit_headline_finding",
    stmt(
        """SELECT record_id, CASE WHEN ok_ IS NOT NULL THEN 'Oxygen saturation below 90% (hypoxemia) between ' || (ok_ * 2 // 60) || ' and ' || ((ok_ * 2 + 6) // 60) || ' minutes.'
          WHEN hk IS NOT NULL THEN 'Heart rate outside 60-100 bpm (' || CASE WHEN hm > 100 THEN 'tachycardia' ELSE 'bradycardia' END || ') between ' || (hk * 2 // 60) || ' and ' || ((hk * 2 + 6) // 60) || ' minutes.'
          ELSE 'Vital signs without changes in the period.' END AS summary,
          CASE WHEN ok_ IS NOT NULL OR hk IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
          CASE WHEN ok_ IS NOT NULL THEN 'CRITICAL' WHEN hk IS NOT NULL THEN 'MEDIUM' END AS severity,
          CASE WHEN ok_ IS NOT NULL THEN record_id || '-spo2-' || ok_ * 2 || 's' WHEN hk IS NOT NULL THEN record_id || '-hr-' || hk * 2 || 's' END AS evidence_id
        FROM (SELECT record_id, min(CASE WHEN truth AND channel = 'SpO2' THEN k END) AS ok_, min(CASE WHEN truth AND channel = 'HR' THEN k END) AS hk,
          arg_min(list_median(ok), k) FILTER (truth AND channel = 'HR') AS hm FROM truth GROUP BY record_id)""",
        "truth",
    ),
)
def _headline(spark, sf):
    return VI.headline_finding(bedside_truth(spark, sf))


STATS = """SELECT record_id, channel, printf('%.1f', {m}(x) FILTER ({f}))::DOUBLE AS min, printf('%.1f', max(x) FILTER ({f}))::DOUBLE AS max,
    printf('%.1f', round(avg(x) FILTER ({f}), 9))::DOUBLE AS mean, count(*)::DOUBLE AS duration_s,
    CASE WHEN count(*) >= 6 THEN (count(*) - 6) // 2 + 1 ELSE 0 END AS n_windows, count(*) FILTER (invalid) AS n_invalid FROM {t} GROUP BY 1, 2"""


@fam.add("vit_record_stats", stmt(STATS.format(m="min", f="NOT invalid", t="clean"), "clean"))
def _stats(spark, sf):
    return VI.record_stats(clean(spark, sf), SIZE, STRIDE)


@fam.add("vit_record_stats_bedside", stmt(STATS.format(m="min", f="true", t="bed_marked"), "bed_marked"))
def _stats_bed(spark, sf):
    return VI.record_stats(VI.mark_signal_loss(V.bedside_samples(spark, sf), "bedside"), SIZE, STRIDE, valid_only=False)


@fam.add(
    "vit_worst_window",
    stmt(
        """SELECT record_id, k, start_s, end_s, round(score, 6) AS score FROM zs WHERE flag
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, k) = 1""",
        "zs",
    ),
)
def _worst(spark, sf):
    return VI.worst_window(zscores(spark, sf)).drop("channel").withColumn("score", F.round("score", 6))


@fam.add(
    "vit_run_detectors",
    stmt(
        """SELECT d.name AS detector, record_id, k, round(score, 6) AS score, CASE WHEN score IS NOT NULL THEN score > lim END AS flag
        FROM zs, (VALUES ('sensitive', 1.0::DOUBLE), ('strict', 3.0::DOUBLE)) AS d(name, lim)""",
        "zs",
    ),
)
def _run_detectors(spark, sf):
    named = {
        "sensitive": lambda f: VI.rolling_zscore(f, 1.0, BASE),
        "strict": lambda f: VI.rolling_zscore(f, 3.0, BASE),
    }
    out = VI.run_detectors(features(spark, sf), named)
    return out.select("detector", "record_id", "k", F.round("score", 6).alias("score"), "flag")
