"""Chunked scans against plain loops, with one key holding most rows."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwatch.plans import ordered as O
from wardwatch.plans.joins import interval_join
from wardwatch.plans.materialise import SHUFFLE_CLEANUP, written
from wardwatch.plans.quantiles import exact_quantile
from wardwatch.plans.runs import runs


def data(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for key, size in [("hot", n), ("cold", 7), ("one", 1)]:
        for i in range(size):
            if rng.random() < 0.8:
                rows.append((key, i, rng.choice([None, rng.randint(0, 5)]), rng.random() < 0.6))
    rng.shuffle(rows)
    return rows


SCHEMA = "key string, pos long, v int, hit boolean"


@pytest.mark.parametrize("length", [3, 17, 100000])
def test_carried_matches_loop(table, length):
    rows = data()
    df = O.carried(table(rows, SCHEMA), ["key"], "pos", length, sums={"s": F.col("v")}, last={"l": F.col("v")}, with_before=True)
    got = {(r.key, r.pos): (r.s, r.l, r.l_before) for r in df.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        total, last = 0, None
        for _, pos, v, _h in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            before = last
            total += v or 0
            last = v if v is not None else last
            want[key, pos] = (total, last, before)
    assert got == want


@pytest.mark.parametrize("length", [4, 50])
def test_halo_lag_matches_loop(table, length):
    rows = data(2)
    df = O.with_halo(table(rows, SCHEMA), "pos", length, before=3, after=2)
    w = O.chunk_window(["key"], "pos").rangeBetween(-3, 2)
    got = {(r.key, r.pos): r.n for r in O.core_rows(df.withColumn("n", F.count("*").over(w))).collect()}
    for key, pos, _v, _h in rows:
        assert got[key, pos] == sum(1 for r in rows if r[0] == key and pos - 3 <= r[1] <= pos + 2)
    assert len(got) == len(rows)


def test_index_and_previous_across_buckets(table):
    rows = data(3)
    df = table(rows, SCHEMA)
    got = {(r.key, r.pos): r.idx for r in O.dense_index(df, ["key"], ["pos"], F.floor(F.col("pos") / 10)).collect()}
    prev = {(r.key, r.pos): r.prev and r.prev.pos for r in O.previous_row(df, ["key"], ["pos"], F.floor(F.col("pos") / 10), ["pos"]).collect()}
    for key in ["hot", "cold", "one"]:
        places = sorted(r[1] for r in rows if r[0] == key)
        assert [got[key, p] for p in places] == list(range(len(places)))
        assert [prev[key, p] for p in places] == [None, *places[:-1]][: len(places)]


@pytest.mark.parametrize("length", [2, 9, 1000])
def test_runs_match_loop(table, length, as_rows):
    rows = data(4)
    want = []
    for key in ["hot", "cold", "one"]:
        hits = sorted(r[1] for r in rows if r[0] == key and r[3])
        start = None
        for i, p in enumerate(hits):
            start = p if start is None else start
            if i + 1 == len(hits) or hits[i + 1] != p + 1:
                want.append((key, start, p + 1))
                start = None
    got = runs(table(rows, SCHEMA), ["key"], "pos", F.col("hit"), length)
    assert as_rows(got, "key", "run_start", "run_end") == sorted(want, key=str)


def test_exact_quantile(table):
    rng = np.random.default_rng(5)
    values = {"hot": rng.normal(0.5, 0.1, 500).round(3), "flat": np.full(40, 0.25), "one": np.array([0.9])}
    df = table([(k, float(v)) for k, a in values.items() for v in a], "key string, x double")
    for q in [0.0, 0.1, 0.9, 1.0]:
        got = {r.key: r.quantile for r in exact_quantile(df, ["key"], "x", q, parts=5).collect()}
        for k, a in values.items():
            assert got[k] == pytest.approx(np.quantile(a, q), abs=1e-12)
    nth = {r.key: r.quantile for r in exact_quantile(df, ["key"], "x", 0.9, nth=True, parts=5).collect()}
    for k, a in values.items():
        assert nth[k] == sorted(a)[int(0.9 * len(a))]


def test_quantile_of_bunched_values_is_spread(table):
    bunched = [0.5 + i * 1e-12 for i in range(3000)]  # one bin of any equal cut
    df = table([("a", x) for x in bunched] + [("b", float(i)) for i in range(1000)], "key string, x double")
    got = {r.key: r.quantile for r in exact_quantile(df, ["key"], "x", 0.25, parts=16).collect()}
    assert got["a"] == pytest.approx(np.quantile(bunched, 0.25), abs=1e-15) and got["b"] == pytest.approx(249.75)
    sizes = O.ranged(df, ["key", "x"], 16).groupBy(O.CHUNK).count().toPandas()["count"]
    assert sizes.max() < 3 * 4000 / 16


def test_interval_join_keeps_bounds(table, as_rows):
    points = table([("a", 0), ("a", 5), ("a", 9), ("a", 10), ("b", 3)], "key string, p long")
    spans = table([("a", 0, 5, "x"), ("a", 5, 10, "y"), ("b", 4, 4, "empty")], "key string, s long, e long, name string")
    got = interval_join(points, spans, ["key"], "p", "s", "e", 4, "left")
    assert as_rows(got, "key", "p", "name") == sorted([("a", 0, "x"), ("a", 5, "y"), ("a", 9, "y"), ("a", 10, None), ("b", 3, None)], key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_previous_in_sampled_ranges(table, parts):
    rows = data() + [(None, i, None, False) for i in range(50)]
    df = table(rows, SCHEMA)
    got = {(r.key, r.pos): r.prev and r.prev.pos for r in O.previous_in_ranges(df, ["key"], ["pos"], ["pos"], parts=parts).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        places = sorted(r[1] for r in rows if r[0] == key)
        want |= {(key, p): q for p, q in zip(places, [None, *places], strict=False)}
    assert got == want
    assert O.previous_in_ranges(df.limit(0), ["key"], ["pos"], ["pos"]).count() == 0


@pytest.mark.parametrize("long", [1, 60, 100_000])
def test_previous_by_key(table, long):
    rows = data() + [(None, i, None, False) for i in range(50)] + [("one", 900, 1, True), ("one", 900, 1, True)]
    got = O.previous_by_key(table(rows, SCHEMA), ["key"], ["pos"], ["pos"], place="at", long=long).collect()
    want = []
    for key in {r[0] for r in rows}:
        places = sorted(r[1] for r in rows if r[0] == key)
        want += [(key, p, q) for p, q in zip(places, [None, *places], strict=False)]
        at = [r.at for r in sorted((r for r in got if r.key == key), key=lambda r: r.pos)]
        assert at == sorted(at) and len(set(at)) == len(set(places))
    assert sorted([(r.key, r.pos, r.prev and r.prev.pos) for r in got], key=str) == sorted(want, key=str)


def test_long_keys_are_cut_and_short_ones_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(O, "previous_in_ranges", partial(O.previous_in_ranges, parts=12))
    df = spark.range(9000).select(F.when(F.col("id") < 6000, -1).otherwise(F.col("id") % 300).alias("key"), F.col("id").alias("pos"))
    sizes = O.previous_by_key(df, ["key"], ["pos"], ["pos"], long=1000).rdd.glom().map(len).collect()
    assert sum(sizes) == 9000 and max(sizes) < 4000
    plan = O.previous_by_key(df, ["key"], ["pos"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_written_can_remove_its_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f"{d.getName()}/{x.getName()}" for top in disk.localDirs() for d in top.listFiles() for x in d.listFiles() or [] if x.getName().startswith("shuffle_")}

    made = {}
    for clean in (False, True):
        before = files()
        out = written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n")), clean=clean)
        made[clean] = files() - before
        assert out.agg(F.sum("n"), F.count("k")).first()[:] == (5000, 700)
    assert made[False] and not made[True] and spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_a_crowded_key_fills_many_ranges(table):
    rows = [("hot", i, 1, True) for i in range(4000)] + [(f"k{i}", 0, 1, True) for i in range(8000)]
    placed = O.ranged(table(rows, SCHEMA), ["key", "pos"], 24)
    sizes = placed.groupBy(O.CHUNK).count().toPandas()["count"]
    assert sizes.max() < 3 * len(rows) / 24
    assert placed.filter("key = 'hot'").select(O.CHUNK).distinct().count() >= 6


def test_previous_row_keeps_one_range_a_task(spark):
    df = spark.range(6400).select((F.col("id") % 2).alias("key"), F.col("id").alias("pos"))
    out = O.previous_in_ranges(df, ["key"], ["pos"], ["pos"], parts=64)
    sizes = out.rdd.glom().map(len).collect()
    assert sum(sizes) == 6400 and max(sizes) < 250  # ranges of about 100 rows; by hash, several meet in one task
