import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwatch.operators import vitals as VI
from wardwatch.operators.forest import drawn_windows, isolation_forest

SAMPLES = "record_id string, channel string, idx long, x double"
WINDOWS = "record_id string, channel string, k long, mean double, valid boolean"


def samples(table, values, record="r"):
    return table([(record, "FHR", i, float(v)) for i, v in enumerate(values)], SAMPLES)


def scores(table, means, size=5, threshold=3.0, chunk=100000):
    rows = [("r", "FHR", k, None if m is None else float(m), m is not None) for k, m in enumerate(means)]
    return [(r.score, r.flag) for r in VI.rolling_zscore(table(rows, WINDOWS), threshold, size, chunk).orderBy("k").collect()]


def test_zscore_hand_cases(table):
    base = [138, 140, 142, 139, 141]
    got = scores(table, [*base, 145])
    assert got[:5] == [(None, None)] * 5
    assert got[5][0] == pytest.approx(5 / math.sqrt(2)) and got[5][1] is True
    assert scores(table, [*base, 144])[5][1] is False
    own = scores(table, [*base, 142])[5][0]
    assert scores(table, [*base, 142], threshold=own)[5][1] is False
    assert scores(table, [140] * 5 + [160])[5] == (math.inf, True)
    assert scores(table, [140] * 5 + [140])[5] == (0.0, False)
    skipped = scores(table, [138, 140, None, 142, 139, 141, 145], chunk=2)
    assert skipped[2] == (None, None) and skipped[6][0] == pytest.approx(5 / math.sqrt(2))


@pytest.mark.parametrize("chunk", [4, 1000])
def test_gaps(table, chunk):
    values = [0, 10, 0, 0, 16, 0, 0, 0, 20, float("nan"), 30, 0]
    got = VI.interpolate_gaps(VI.mark_signal_loss(samples(table, values)), 2.0, 1.0, chunk).orderBy("idx").collect()
    assert [r.x for r in got] == [0, 10, 12, 14, 16, 0, 0, 0, 20, 25, 30, 0]
    assert [r.idx for r in got if r.invalid] == [0, 5, 6, 7, 11]


def test_windows_are_complete_and_strict(table):
    values = [0, 0, 0, 5, 5, 5, 5, 5, 5, 5, 5]
    w = VI.sliding_windows(VI.mark_signal_loss(samples(table, values)), 6, 2).orderBy("k").collect()
    assert [(r.k, r.start_s, r.end_s, r.insufficient) for r in w] == [(0, 0, 6, False), (1, 2, 8, False), (2, 4, 10, False)]
    with pytest.raises(ValueError):
        VI.sliding_windows(VI.mark_signal_loss(samples(table, values)), 0, 2)


def test_features_and_decelerations(table):
    values = [140, 100, 100, 140, 140, 100, 100, 100]
    row = VI.window_features(VI.sliding_windows(VI.mark_signal_loss(samples(table, values)), 8, 8), min_run=2).first()
    assert row["mean"] == np.mean(values) and row["std"] == pytest.approx(np.std(values)) and row["baseline"] == np.median(values)
    assert row["short_term_variability"] == pytest.approx(np.mean(np.abs(np.diff(values))))
    assert row["deceleration_count"] == 0.0
    lifted = [140] * 6 + [100, 100, 140, 140, 100, 100]
    again = VI.window_features(VI.sliding_windows(VI.mark_signal_loss(samples(table, lifted)), 12, 12), min_run=2).first()
    assert again["deceleration_count"] == 2.0


def test_nan_poisons_statistics(table):
    row = VI.window_features(VI.sliding_windows(VI.mark_signal_loss(samples(table, [1, 2, float("nan"), 4])), 4, 4), min_run=1).first()
    assert row["valid"] and all(math.isnan(row[c]) for c in ["mean", "std", "min", "max", "baseline"])


def test_verdict_needs_more_than_tau(table):
    rows = [("a", "z", i, i < 3) for i in range(20)] + [("b", "z", i, None) for i in range(3)]
    got = {r.record_id: (r.fraction, r.predicted, r.n_excluded) for r in VI.record_verdict(table(rows, "record_id string, detector string, k long, flag boolean")).collect()}
    assert got["a"] == (0.15, False, 0) and got["b"] == (None, None, 3)


def test_resample_holds_the_end(table):
    got = VI.resample_linear(samples(table, [0, 10, 20]), 1.0, 2.0, chunk=2).orderBy("idx").collect()
    assert [r.x for r in got] == [0, 5, 10, 15, 20, 20]


def forest_input(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(rec, "FHR", k, True, *(float(v) for v in rng.normal(size=7) + (9 if k == 5 else 0))) for rec in "ab" for k in range(n)]
    rows += [("few", "FHR", k, True, *[0.0] * 7) for k in range(9)] + [("a", "FHR", 999, False, *[None] * 7)]
    return spark.createDataFrame(rows, "record_id string, channel string, k long, valid boolean, " + ", ".join(f"`{f}` double" for f in VI.FEATURES))


def test_forest_invariants(spark):
    df = forest_input(spark)
    pick = lambda d: {(r.record_id, r.k): (r.score, r.flag) for r in d.collect()}
    whole = pick(isolation_forest(df, 0.1, 42))
    assert whole == pick(isolation_forest(df.repartition(7).orderBy(F.rand(1)), 0.1, 42))
    assert whole["few", 3] == (None, None) and whole["a", 999] == (None, None)
    for rec in "ab":
        mine = {k: v for (r, k), v in whole.items() if r == rec and v[0] is not None}
        assert max(mine, key=lambda k: mine[k][0]) == 5 and sum(f for _, f in mine.values()) == 6
    cut = pick(isolation_forest(df, 0.1, 42, chunk=16))
    assert {k: v[1] for k, v in cut.items()} == {k: v[1] for k, v in whole.items()}
    assert pick(isolation_forest(df, 0.1, 43)) != whole


def test_forest_of_a_long_record_draws_from_all_windows(spark):
    values = [F.rand(i).alias(f) for i, f in enumerate(VI.FEATURES)]
    df = spark.range(20_500).select(F.lit("r").alias("record_id"), F.lit("FHR").alias("channel"), F.col("id").alias("k"), F.lit(True).alias("valid"), *values)
    drawn = drawn_windows(df.withColumn("_n", F.lit(20_500)), 1, 100, 256).selectExpr("k", "explode(_trees) AS tree")
    per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(per_tree) == 100 and min(per_tree) >= 256
    assert drawn.select("k").distinct().count() > 15_000
    out = isolation_forest(df, 0.1, 1, trees=20)
    assert out.filter("score IS NULL OR flag IS NULL").count() == 0 and out.filter("flag").count() == 2050


def test_composing_fails_on_a_declared_record_without_samples(spark):
    order = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "timeline_id string, ord long, record_id string")
    records = spark.createDataFrame([("a", 4.0, 7.3), ("b", 4.0, 7.0)], "record_id string, fs double, ph double")
    some = spark.createDataFrame([("a", "FHR", 0, 1.0)], SAMPLES)
    for part in VI.compose_timeline(some, records, order):
        with pytest.raises(Exception, match="declared record without samples: b"):
            part.collect()
    whole = some.union(spark.createDataFrame([("b", "FHR", 0, 2.0)], SAMPLES))
    assert [r["ph"] for r in VI.compose_timeline(whole, records, order)[2].collect()] == [7.0]


def test_zero_is_loss_on_heart_rate_alone(spark):
    rows = [("FHR", 0.0), ("UC", 0.0), ("FHR", None), ("UC", None), ("UC", float("nan")), ("FHR", 1.0), (None, 0.0)]
    marked = VI.mark_signal_loss(spark.createDataFrame(rows, "channel string, x double"))
    assert [r["invalid"] for r in marked.collect()] == [True, False, True, True, True, False, False]


@pytest.mark.parametrize("masked,mean,low", [(False, 7.5, 0.0), (True, 10.0, 10.0)])
def test_masked_features_leave_invalid_samples_out(table, masked, mean, low):
    marked = VI.mark_signal_loss(samples(table, [10, 10, 0, 10]))
    out = VI.window_features(VI.sliding_windows(marked, 4.0, 4.0, max_invalid=0.5, mask_features=masked)).first()
    assert out.valid and (out["mean"], out["min"]) == (mean, low)


def test_records_grown_together_equal_records_grown_alone():
    import numpy as np
    import pandas as pd

    from wardwatch.operators import forest as IF

    rng = np.random.default_rng(5)
    frames = [pd.DataFrame(rng.random((n, len(VI.FEATURES))), columns=VI.FEATURES).assign(k=range(n), _trees=[list(range(7))] * n) for n in (12, 40, 300)]
    sizes = np.array([len(f) for f in frames])

    def scores(parts, names):
        rows, n = pd.concat(parts, ignore_index=True), np.array([len(p) for p in parts])
        record = np.repeat(np.arange(len(parts)), n)
        nodes, psi = IF.grown(rows, record, names, n, 3, 7, 64)
        return IF.score(nodes, rows[VI.FEATURES].to_numpy(), 7, psi[record], record * 7)

    together = scores(frames, ["a", "b", "c"])
    alone = np.concatenate([scores([f], [n]) for f, n in zip(frames, "abc", strict=True)])
    assert len(together) == sizes.sum() and np.array_equal(together, alone)
