"""Joins, archives, filters and mixing against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardwatch.llm import embedding_dedup, mixing, ngram_join, quality, url_filter, warc
from wardwatch.llm.components import components
from wardwatch.llm.queries import URL_RULES
from wardwatch.llm.shared import apart, open_file, shared_folder
from wardwatch.session import ensure_checkpoint_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chain_star_and_ring(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(20)] + [(30, i) for i in range(31, 60)] + [(i, 60 + (i - 59) % 9) for i in range(60, 69)] + [(70, 70), (None, 3)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    want = roots(70, [x for x in links if x[0] is not None and x[0] < 70])
    assert got == {v: want[v] for v in got} and len(got) == 21 + 30 + 9
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_components_against_all_pairs(docs_of, k, num):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Two Words"), (4, "two words"), (5, "two"), (6, passage), (6, passage), (None, passage)]
    base = [rng.choice(vocabulary) for _ in range(130)]
    for i in range(10, 90):  # one large group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(130)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    for i in range(100, 140):  # texts that share a passage alone
        rows.append((i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 150)))))
    rows += [(i, "word " * 30_000) for i in (200, 201)]
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        m = min(k, len(words))
        sets.append({tuple(words[j : j + m]) for j in range(len(words) - m + 1)} if words else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows))), key=str)
    docs = docs_of(rows).withColumn("rid", F.lit(1))
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, k, num, 100, sketch_bits=17).collect()), key=str) == want
    assert ngram_join.jaccard_components(docs_of([]), k, num).count() == 0


def test_one_of_each_group_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (1, text.upper()), (2, text + " more"), (7, "another text of its own entirely"), (7, "another text of its own entirely"), (9, None)]
    kept = ngram_join.near_duplicates_removed(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 9] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_join_leaves_no_tables_behind(spark, docs_of):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    base = " ".join(f"v{i}" for i in range(80))
    kept = ngram_join.near_duplicates_removed(docs_of([(1, base), (2, base + " more"), (3, base), (4, "quite another text")]))
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert "dropped" in left and not left & {"posts", "members", "rows", "placed", "between", "named", "judged"}
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def shuffled_bytes(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("stage", ["join", "quality"])
def test_texts_that_stay_are_not_shuffled(spark, docs_of, tmp_path, stage):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(6000))) for i in range(40)]
    rows += [(40, rows[7][1]), (41, rows[7][1] + " more"), (7, rows[7][1]), (42, None), (43, "too short"), (43, "too short")]
    docs_of(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file://"))
    tables = set(folder.iterdir())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.near_duplicates_removed(docs) if stage == "join" else quality.kept_documents(docs, BPE, public_tokenizers.path("piece_bpe_32k.model"))
        before = shuffled_bytes(spark)
        kept.write.parquet(str(tmp_path / "kept"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = sum(len(t) for _, t in rows if t)
    assert shuffled_bytes(spark) - before < whole / 2
    left = sum(f.stat().st_size for t in set(folder.iterdir()) - tables for f in t.rglob("*.parquet"))
    assert left < whole / 2
    got = sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect())
    assert got == ([*range(40), 42, 43] if stage == "join" else [*range(8), *range(7, 42)])


@pytest.mark.parametrize("bits", [7, 23])
def test_rows_apart_by_a_filter_of_any_width(spark, bits):
    rows = spark.range(500).selectExpr("if(id % 50 = 0, null, id) AS id", "struct(id % 3 AS a) AS other")
    keys = spark.range(0, 300, 3).select("id")
    maybe, others = apart(rows, keys, "id", bits)
    here, there = maybe.count(), {r["id"] for r in others.collect()}
    assert not there & set(range(0, 300, 3)) and here + others.count() == 500 and (bits == 7 or here < 110)
    assert maybe.columns == others.columns == ["id", "other"] and apart(rows, keys.limit(0), "id", bits)[1].count() == 500


def vectors(rng, n):
    centres = rng.normal(size=(n // 8, 16))
    return np.concatenate([centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.12, size=(n, 16))])


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = vectors(rng, 600)
    x[:150] = x[0] + rng.normal(scale=0.02, size=(150, 16))  # a hot group
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(600)]
    rows += [(600, None, 0), (601, [], 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, [None] + [1.0] * 15, 0), (605, rows[0][1], None), (606, [1e300] * 16, 5), (607, [2e300] * 16, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(0))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, cell_rows=60, block_rows=70).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(600))
    assert found >= 0.97 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(600))
    assert [got[i]["n_links"] for i in range(600, 608)] == [0] * 6 + [1, 1] and got[607]["component_id"] == 606
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    exact = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, cell_rows=10_000, block_rows=70).collect()}
    want = roots(600, zip(*np.nonzero(near), strict=True))
    assert all(exact[i]["n_links"] == near[i].sum() and exact[i]["component_id"] == want[i] for i in range(600))
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embedding_links_of_a_hot_group_and_of_one_over_many_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2400, 16))
    x[:800] = x[0] + rng.normal(scale=0.15, size=(800, 16))  # near copies of one vector
    x[800:2000, 4:] = rng.normal(scale=0.02, size=(1200, 12))  # dense, and wider than any cell
    table = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(2400)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    centres = embedding_dedup.fit_cells(table.withColumn("rid", F.col("vec_id")), 0.93, 12, 1024, 40_000, 12, 17)[16]
    home = (unit @ centres.T).argmax(axis=1)
    assert len(set(home[:800])) <= 5 and len(set(home[800:2000])) >= 50
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, cell_rows=12, block_rows=100).collect()}
    want = roots(2400, zip(*np.nonzero(near), strict=True))
    assert near.sum() > 600_000 and all((got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), want[i]) for i in range(2400))


def test_archives_round_trip(spark):
    rows = [(5, "http://a.org/\r\nx: y", "<p>same</p>"), (2, "http://b.org", "<p>same</p>"), (2, "http://b.org", "<p>same</p>"), (9, None, None), (7, "http://c.org", ""), (None, "http://d.org", "<p>same</p>"), (8, "http://e.org", "é" * 300_000 + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("f")).repartition(3)
    got = sorted(map(tuple, warc.deduplicated_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page, kind, refers, html in [(5, "revisit", 2, rows[0][2]), (2, "response", None, rows[1][2]), (2, "revisit", 2, rows[1][2]), (9, "revisit", 7, ""), (7, "response", None, ""), (None, "response", None, rows[0][2]), (8, "response", None, rows[6][2])]:
        want.append((page, len(html.encode()), warc.digest(html.encode()), kind, refers))
    assert got == sorted(want, key=str)
    small = warc.deduplicated_archives(pages, min_bytes=1).filter("record_type = 'revisit'")
    assert sorted(r["page_id"] for r in small.collect()) == [2, 5]
    assert warc.deduplicated_archives(pages.limit(0)).count() == 0


def test_records_can_be_read_alone(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "p" * i) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark, "w")
    files = warc.write_archives(pages, folder, "2024-01-01T00:00:00Z")
    heads = warc.headers(files, folder).orderBy("offset").collect()
    stream = open_file(folder, heads[7]["file"])
    stream.seek(heads[7]["offset"])
    _, size, fields, block = next(warc.read_records(stream))
    assert size == heads[7]["size"] and fields["Page-ID"] == "7" and block.endswith(b"\r\n\r\nppppppp")


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/1?q", "https://example.org/en/12", "http://org/x#y", "http://evilorg/x", "x.com/fr/", None, "http://shop.COM/FR/1", "http://shop.com/fr/1", "http://example.org", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    model = url_filter.fit(["a.b", "c.d"], ["/good", "/bad"], np.array([False, True]))
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, model).collect()}
    parts = [("a.example.org", "/es/1"), ("example.org", "/en/12"), ("org", "/x"), ("evilorg", "/x"), ("", ""), ("", ""), ("shop.com", "/FR/1"), ("shop.com", "/fr/1"), ("example.org", ""), ("b:", "//c/d")]
    assert [(got[i]["host"], got[i]["path"]) for i in range(10)] == parts
    assert [got[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", None, None, None, None, "com/fr/", None, None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 7)] == ["block", "block", "allow", "allow"]
    alone = model.block_probability(["", "b:"], ["", "//c/d"])
    assert got[4]["block_probability"] == pytest.approx(alone[0]) and got[9]["block_probability"] == pytest.approx(alone[1])
    assert url_filter.judge(pages.limit(0), URL_RULES, model).count() == 0


def test_url_model_on_held_out_urls(spark):
    rng = random.Random(9)
    bad, good = ["casino", "bets", "pills"], ["docs", "library", "school"]
    rows = []
    for i in range(600):
        kind = i % 2 == 0
        rows.append((f"http://{rng.choice('abcdefgh')}{rng.choice(bad if kind else good)}{i}.net/{rng.choice(bad if kind else good)}/{i}", kind))
    table = spark.createDataFrame([*rows[:400], (None, True), ("http://x", None)], "url string, blocked boolean")
    model = url_filter.fit_table(table, max_rows=150)
    split = [(u.split("://")[1].split("/")[0], "/" + u.split("/", 3)[3]) for u, _ in rows[400:]]
    p = model.block_probability([h for h, _ in split], [q for _, q in split])
    assert np.mean((p >= 0.5) == [k for _, k in rows[400:]]) > 0.95
    assert url_filter.fit([], [], np.array([])).block_probability(["a"], ["/"])[0] == 0.5


def test_rates_meet_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(0, 500, 400)
    seen = spark.createDataFrame(pd.DataFrame({"n_tokens": t, "posterior": list(p)}), "n_tokens long, posterior array<double>").repartition(3)
    have = t @ p
    targets = have * [1.0, 0.4, 0.05]
    history = mixing.fit_rates(seen, targets, ridge=1e-4, steps=400, tolerance=1e-9)
    rate, _ = mixing._rates(p, history, 1e-4)
    assert rate.min() >= 0 and np.abs((rate * t) @ p - targets).max() < 0.01 * targets.sum()
    # no nearby nonnegative rates do better
    w, total = t / t.sum(), targets.sum()
    loss = lambda r: 0.5 * ((((r * t) @ p - targets) / total) ** 2).sum() + 0.5e-4 * (w * (r - 1) ** 2).sum()
    for _ in range(50):
        assert loss(np.maximum(rate + rng.normal(scale=0.02, size=400), 0)) >= loss(rate) - 1e-9


def test_mixture_of_labelled_documents(spark, docs_of):
    rng = random.Random(6)
    common = ["river", "stone", "winter", "garden", "letter"]
    rows, labels = [(1000, None), (1001, ""), (None, "river stone")], []
    for i in range(300):
        kind = ("clean", "low", "toxic")[i % 3]
        own = {"clean": "tale", "low": "click!!", "toxic": "scum"}[kind]
        rows.append((i, " ".join([rng.choice(common) for _ in range(30)] + [own])))
        if i < 200:
            labels.append((i, kind))
    docs = docs_of(rows)
    given = spark.createDataFrame([*labels, *labels[:5], (None, "clean"), (5, "other")], "doc_id long, domain string")
    weights = {"clean": 0.9, "low": 0.07, "toxic": 0.03}
    got = mixing.mix(docs, given, weights, "clean").toPandas()
    assert len(got) == len(rows)
    held = got[(got.doc_id >= 200) & (got.doc_id < 300)]
    right = [int(np.argmax(p)) == int(i) % 3 for p, i in zip(held.posterior, held.doc_id, strict=True)]
    assert np.mean(right) > 0.95
    totals = np.stack(got.posterior).T @ (got.rate * got.n_tokens)
    assert totals / totals.sum() == pytest.approx(list(weights.values()), abs=0.02) and (got.copies >= 0).all()
    kept = {r["doc_id"] for r in mixing.mixed_documents(docs, given, weights, "clean").collect()}
    assert kept >= set(range(0, 300, 3)) and len(kept & set(range(2, 300, 3))) < 15
    assert mixing.mix(docs_of([]), given, weights, "clean").count() == 0
    assert mixing.mix(docs, given.limit(0), weights, "clean").count() == len(rows)


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns
        docs = warc.stored(docs, "stage")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert [stage(spark, empty, sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_rows_of_one_id_are_judged_by_their_texts(docs_of):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "tuq"]
    rows = [(1, base[0]), (7, base[0] + " more"), (7, base[1]), (None, base[1] + " more"), (None, base[2]), (None, base[2]), (7, ""), (7, "")]
    kept = ngram_join.near_duplicates_removed(docs_of(rows).withColumn("_kept", F.lit(1)).withColumn("key", F.lit(2)).withColumn("tag", F.lit(3)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, base[0]), (7, base[1]), (None, base[2]), (7, ""), (7, "")], key=str)


def test_stages_carry_columns_of_any_name(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_text", "_m", "_lang", "_unit", "_kept", "row", "unit", "tag", "key", "rid"]
    for name, stage in corpus_pipeline.STAGES:
        with_more = stage(spark, docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]), sf)
        plain = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert with_more.columns == [*docs.columns, *names]
        assert sorted(r[0] for r in with_more.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())


def test_mixing_sends_a_text_once(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.mixing_weights(spark, docs, sf)
    assert "AS text#" not in kept._jdf.queryExecution().analyzed().toString()
    other = corpus_pipeline.mixing_weights(spark, docs.withColumn("text", F.col("text").cast("binary")), sf)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in other.select("doc_id").collect())


def test_record_ids_of_two_crawls_differ(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, html string")
    ids = set()
    for _ in range(2):
        folder = warc.shared_folder(spark, "w")
        name = warc.write_archives(pages, folder, "2024-01-01T00:00:00Z").first()["file"]
        ids |= {f["WARC-Record-ID"] for _, _, f, _ in warc.read_records(warc.open_file(folder, name))}
    assert len(ids) == 2
