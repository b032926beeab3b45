import pickle
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwatch.functions.text import fold_runs, normalize
from wardwatch.operators import random_forest as RF
from wardwatch.operators import speech as SP

SEG = "recording_id string, seg_idx int, start_s double, end_s double, text string, no_speech_prob double"


def test_terms_without_case_or_accent(table, as_rows):
    seg = table([("r", 0, 0.0, 2.0, " Doutor, NAO CONSIGO ", 0.1), ("r", 1, 2.0, 4.0, "RESPIRAR direito, dor e dor.", 0.3)], SEG)
    t = SP.assemble_transcript(seg)
    hits = SP.find_terms(t, ["não consigo respirar", "dor", "", "ausente"])
    assert as_rows(hits, "term", "char_at") == [("dor", 39), ("dor", 45), ("não consigo respirar", 9)]
    stamped = SP.term_timestamp(hits, seg, width=8)
    assert {(r.term, r.approx_timestamp_s) for r in stamped.collect()} == {("dor", 2.0), ("não consigo respirar", 0.0)}
    assert t.first().reliable and SP.assemble_transcript(seg, 0.19).first().reliable is False


@pytest.mark.parametrize("text,term,at", [("aaaa", "aa", [0, 2]), ("aaaaa", "aa", [0, 2]), ("abcabc", "c", [2, 5]), ("x.y", ".", [1]), ("a\\Eb", "\\E", [1]), ("", "a", [])])
def test_occurrences_do_not_overlap(table, text, term, at):
    hits = SP.find_terms(table([("r", text)], "recording_id string, text string"), [term])
    assert sorted(r.char_at for r in hits.collect()) == at


def test_sentiment(spark):
    words = SP.POSITIVE, SP.NEGATIVE
    say = lambda s: spark.range(1).select(SP.lexicon_sentiment(F.lit(s), *words).alias("m")).first().m
    assert tuple(say("Estou ótimo, feliz")) == ("positive", 1.0)
    assert tuple(say("dor e febre, mas melhor"))[0] == "negative"
    assert tuple(say("dor melhor")) == ("neutral", 0.0) and tuple(say("nada")) == ("neutral", 0.0)
    assert len(SP.default_terms()) == 44 and "cansaço excessivo" in SP.default_terms()


def test_fatigue_order(table):
    rows = [(0.005, 0.020, 20.0, 0.10, 3.0), (0.008, 0.030, 18.0, 0.15, 2.8), (0.006, 0.025, 19.0, 0.12, 2.9), (0.020, 0.060, 10.0, 0.30, 1.5)]
    df = table([("run", str(i), *r) for i, r in enumerate(rows)], "run_id string, recording_id string, jitter_local double, shimmer_local double, hnr_db double, pause_rate double, speaking_rate_wps double")
    got = {r.recording_id: r.score for r in SP.fatigue_relative(df, 0.5).collect()}
    assert got["3"] > got["2"]
    flat = SP.fatigue_relative(df.filter("recording_id = '0'"), 0.5).first()
    assert flat.score == 0.0 and not flat.fatigued


def test_split_never_shares_a_patient(table):
    cycles = table([(f"p{i % 10}", i) for i in range(200)], "patient_id string, cycle_index long")
    train, test = SP.group_split(cycles, 0.3, 1)
    a, b = ({r.patient_id for r in d.select("patient_id").distinct().collect()} for d in (train, test))
    assert len(b) == 3 and not a & b and train.count() + test.count() == 200
    assert SP.sample_patients(cycles, 4, 1).select("patient_id").distinct().count() == 4


def test_period_of_a_sine(table):
    import math

    env = table([("r", k, 2 + math.sin(2 * math.pi * k / 8)) for k in range(64)] + [("s", k, 1.0) for k in range(64)] + [("t", k, float(k % 2)) for k in range(9)], "record_id string, k long, energy double")
    for chunk in (10, 1000):
        got = {r.record_id: r.period_s for r in SP.dominant_period(env, 2.0, 0.15, 0.5, chunk=chunk).collect()}
        assert got == {"r": 4.0, "s": None, "t": None}


def test_cycle_classifier_learns_and_repeats(table):
    import random

    rng = random.Random(0)
    rows = [(i, "crackle" if i % 5 == 0 else "normal", [rng.random() + (3 if i % 5 == 0 else 0), rng.random()]) for i in range(100)]
    cycles = table(rows, "cycle_index long, label string, features array<double>").coalesce(1)
    once, again = (SP.predict_cycles(SP.train_cycle_classifier(cycles, trees=20, depth=4), cycles) for _ in range(2))
    got = {r.cycle_index: (r.label, r.predicted_label, r.confidence) for r in once.collect()}
    assert got == {r.cycle_index: (r.label, r.predicted_label, r.confidence) for r in again.collect()}
    assert all(a == b and 0.5 <= c <= 1.0 for a, b, c in got.values())


def test_large_forests_stay_out_of_the_driver(table):
    rng = random.Random(1)
    rows = [(i, "crackle" if i % 5 == 0 else "normal", [rng.random() + (3 if i % 5 == 0 else 0), rng.random(), float(i % 3)]) for i in range(1600)]
    cycles = table(rows, "cycle_index long, label string, features array<double>")
    model = SP.train_cycle_classifier(cycles, depth=3)
    assert len(pickle.dumps(model)) < 20_000 and sum(1 for _ in model.trees()) == 200
    got = SP.predict_cycles(model, cycles).collect()
    assert len(got) == 1600 and all(r.label == r.predicted_label and 0.5 <= r.confidence <= 1.0 for r in got)


def test_forests_of_tasks_repeat_and_match_spark(table):
    rng = random.Random(2)
    rows = [(i, "abc"[min(2, int(3 * rng.random() ** 2))], [rng.gauss(0, 1) for _ in range(9)]) for i in range(600)]
    rows = [(i, label, [x + (label == "b") * (k == 3) + (label == "c") * (k == 5) for k, x in enumerate(v)]) for i, label, v in rows]
    cycles = table(rows, "cycle_index long, label string, features array<double>").repartition(3, "cycle_index")
    train, test = cycles.filter("cycle_index < 400"), cycles.filter("cycle_index >= 400")
    sure = {}
    for nodes in (0, 0, SP.NODES_IN_DRIVER):
        got = SP.predict_cycles(SP.train_cycle_classifier(train, trees=60, depth=8, nodes=nodes), test).collect()
        sure.setdefault(nodes, []).append({r.cycle_index: (r.label == r.predicted_label, r.confidence) for r in got})
    (once, again), (spark,) = sure[0], sure[SP.NODES_IN_DRIVER]
    assert once == again and len(once) == 200
    right = lambda m: sum(a for a, _ in m.values()) / 200
    assert abs(right(once) - right(spark)) < 0.08 and np.mean([abs(once[i][1] - spark[i][1]) for i in once]) < 0.06


def test_a_tree_of_all_rows_and_features_is_that_of_spark(table):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(3)
    y = rng.choice(3, 900, p=[0.6, 0.3, 0.1]).astype(np.int32)
    x = rng.normal(size=(900, 4)) + y[:, None] * [0.0, 0.5, 0.0, 0.8]
    x[:, 2] = rng.integers(0, 5, 900)
    weight = 300 / np.bincount(y)
    rows = table([(i, float(y[i]), float(weight[y[i]]), x[i].tolist()) for i in range(900)], "i long, y double, w double, f array<double>").withColumn("v", array_to_vector("f"))
    made = DecisionTreeClassifier(labelCol="y", featuresCol="v", weightCol="w", maxDepth=4).fit(rows)
    want = {r.i: r.p for r in made.transform(rows).select("i", vector_to_array("probability").alias("p")).collect()}
    bounds = [RF.bin_bounds(x[:, f], weight[y]) for f in range(4)]
    bins = RF.binned(x, bounds)
    tree = RF.grown_tree(bins, y, np.ones(900, dtype=int), weight, 4, 4, rng)
    got = RF.votes(tree, bins, weight)
    assert len(tree["feature"]) == made.numNodes and all(got[i] == pytest.approx(want[i]) for i in want)


def test_faults_of_a_forest_of_tasks(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 10) for i in range(740)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    grown = []
    grow = SP.grow_forest
    monkeypatch.setattr(SP.train_cycle_classifier, "__defaults__", (*SP.train_cycle_classifier.__defaults__[:-1], 20_000))
    monkeypatch.setattr(SP, "grow_forest", lambda *a: grown.append(grow(*a)) or grown[0])
    got = queries()["spk_classify_faults"](spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r[1:] == (20, 0, 0, 0) for r in got)
    assert len(grown) == 1 and sum(1 for _ in grown[0].trees()) == 50


@pytest.mark.parametrize("odd", [None, [0.0, float("nan")], [0.0, None], [0.0]])
def test_features_without_value_are_refused(table, odd):
    rows = [(i, "normal" if i % 2 else "both", [float(i), 1.0]) for i in range(20)] + [(20, "both", odd)]
    cycles = table(rows, "cycle_index long, label string, features array<double>")
    for nodes in (0, SP.NODES_IN_DRIVER):
        with pytest.raises(Exception):
            SP.train_cycle_classifier(cycles, trees=2, nodes=nodes)


def test_one_run_of_fatigue_spreads_over_tasks(spark, table):
    names = "jitter_local shimmer_local hnr_db pause_rate speaking_rate_wps".split()
    rows = table([("run", f"r{i}", *[float(i * k % 11) for k in (1, 2, 3, 4, 5)]) for i in range(400)], "run_id string, recording_id string, " + ", ".join(f"{n} double" for n in names))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        sizes = [len(p) for p in SP.fatigue_relative(rows, 0.5).rdd.glom().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 400 and max(sizes) < 200


def test_training_rows_of_few_classes_fill_all_tasks(table):
    rows = [(i, "crackle" if i % 5 == 0 else "normal", [1.0, 2.0]) for i in range(1000)]
    made = SP.training_rows(table(rows, "cycle_index long, label string, features array<double>").coalesce(1))
    sizes = [len(p) for p in made.rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 4 and max(sizes) < 2 * 1000 / len(sizes)
    assert {(r["label"], r["_weight"]) for r in made.collect()} == {("crackle", 2.5), ("normal", 0.625)}


def loop_hits(text, terms, context=40):
    """Left-to-right search in the folded text, with the place of every folded character."""
    fold, place = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKD", c.lower()):
            if not unicodedata.combining(d):
                fold.append(d)
                place.append(i)
    folded, ends = "".join(fold), [*place, len(text)]
    out = []
    for term in terms:
        t = "".join(d for d in unicodedata.normalize("NFKD", term.lower()) if not unicodedata.combining(d))
        at = folded.find(t) if t else -1
        while at >= 0:
            end = at + len(t)
            first, last = ends[at], ends[end] if end < len(folded) else len(text)
            out.append((term, first, text[max(0, first - context) : last + context]))
            at = folded.find(t, end)
    return sorted(out)


def odd_text(rng, n):
    words = ["não", "não", "NÃO", "dor", "DOR", "d́oŗ", "tonto", "tontonto", "falta", "de ar", "aaaa", "İx", "Ǻb", "ß", "ﬁm", "x.y", "\\E", "(a)", "😀", "ñ"]
    return "".join(rng.choice(words) + rng.choice([" ", "", ", ", "\n"]) for _ in range(n))


TERMS = ["não", "dor", "tonto", "falta de ar", "falta", "aa", "ta", ".", "\\E", "(a)", "ix", "ab", "", "́", "ã😀", "ñ"]


def test_folded_marks_keep_places(spark):
    for text in ["não ḑ́or", "NÃO", "", "́́a", "Ǻ̀b", "abc"]:
        row = spark.range(1).select(normalize(F.lit(text)).alias("n"), fold_runs(F.lit(text)).alias("r")).first()
        want = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        assert row.n == want and sum(r.n for r in row.r) == len(text) - len(want)
    assert spark.range(1).select(SP.highlight_term(F.lit("eu não sei"), "NÃO")).first()[0] == "eu **não** sei"


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    texts = [("none", ""), ("null", None), ("e", "nothing here"), ("long", odd_text(rng, 6000)), *((f"t{i}", odd_text(rng, 30)) for i in range(40))]
    got = SP.find_terms(spark.createDataFrame(texts, "recording_id string, text string"), TERMS)
    want = sorted((i, *h) for i, t in texts if t for h in loop_hits(t, TERMS))
    assert sorted((r.recording_id, r.term, r.char_at, r.context) for r in got.collect()) == want and len(want) > 3000


def test_terms_across_segments_and_blocks(spark):
    rng = random.Random(8)
    rows, want = [], []
    for rec in ("a", "b"):
        text, at, k = odd_text(rng, 700), 0, 0
        while at < len(text):
            step = rng.choice([0, 1, 1, 2, 5, 60])
            rows.append((rec, k, float(k), float(k + 1), text[at : at + step], 0.1))
            at, k = at + step, k + 1
        want += [(rec, *h) for h in loop_hits(text, TERMS)]
    got = SP.find_terms_in_segments(spark.createDataFrame(rows, SEG), TERMS, block=64)
    assert sorted((r.recording_id, r.term, r.char_at, r.context) for r in got.collect()) == sorted(want)


def test_texts_are_searched_once(spark):
    df = spark.createDataFrame([("r", "dor e falta")], "recording_id string, text string")
    terms = [t for t in SP.default_terms() if not SP.overlaps_itself(t)]
    plan = SP.find_terms(df, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("(?=") == 2
