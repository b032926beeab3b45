"""Toxicity, collocations and hard negatives against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardwatch.llm import collocations, hard_negatives, toxicity
from wardwatch.llm.quotient import QuotientFilter, counted, filters_of, permuted, restored


def edits(a: str, b: str) -> int:
    """Edits with neighbouring swaps, by the plain table."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


words = st.text("abc", min_size=0, max_size=10)


@settings(max_examples=400, deadline=None)
@given(st.lists(words.filter(bool), min_size=1, max_size=12), words)
def test_automaton_on_trie_equals_all_distances(terms, word):
    terms = [t + "-" if i % 3 == 2 else t for i, t in enumerate(terms)]
    got = sorted(toxicity.LexiconTrie(terms).near(word))
    want = []
    for t in sorted(set(terms)):
        if t.endswith("-"):
            want += [(t, 0)] if word.startswith(t[:-1]) else []
        elif (d := edits(t, word)) <= toxicity.edits_allowed(t):
            want.append((t, d))
    assert got == sorted(want)


def _toxic_rows(seed=3, n=600):
    rng = random.Random(seed)
    plain = [a + b for a in "ba ke li mo nu ra si to".split() for b in "dan fel gir hum jol kas".split()]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["numpty", "dolt", "grumbleskin"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_held_out_misspelled_and_quoted(spark, docs_of):
    rows, labels = _toxic_rows()
    given_ = [(9000, "lamo kefel bagir nmupty rasi dolt"), (9001, None), (9002, ""), (None, "lamo you numpty dolt numpty"), (9003, "kefel " * 200_000)]
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (77777, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    docs = docs_of([*rows, *rows[:3], *given_]).selectExpr("*", "1 as score", "2 as toxic", "3 as predicted")
    got = toxicity.toxic_documents(docs, table).collect()
    assert len(got) == len(rows) + 3 + len(given_)
    truth, by = dict(labels), {r["doc_id"]: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(by[i]["held_out"] for i in held) and sum(r["held_out"] for r in got if r["doc_id"] is not None and r["doc_id"] < 9000 and r["doc_id"] > 2) == len([i for i in held if i > 2])
    assert all(by[i]["predicted"] == truth[i] for i in held)
    assert by[9000]["n_hits"] == 2 and by[9000]["predicted"] == 1
    assert by[9001]["score"] == by[9002]["score"] < 0.3 and by[9003]["predicted"] == 0
    model = toxicity.fit_toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.lexicon.terms) == {"numpty", "dolt", "grumbleskin"}
    spellings = model.lexicon.spellings()
    assert spellings["Grumbl3sk1n"] is not None and spellings["d0lt"] is not None and spellings["gramblesskin"] is not None and spellings["kefel"] is None

    def said(text):
        return model.score(*toxicity.hits_of(text, model.lexicon, spellings))

    assert said('kefel bagir wrote the word “dolt” in lamo rasi') < said("kefel bagir you dolt in lamo rasi")
    assert toxicity.toxic_documents(docs_of([]), table).count() == 0
    empty = toxicity.toxic_documents(docs_of(rows[:5]), table.limit(0)).collect()
    assert len({r["score"] for r in empty}) == 1


def test_copies_of_a_text_make_no_term(spark):
    rows, labels = _toxic_rows(seed=5, n=300)
    odd = " ".join(f"{a}{a}zork" for a in "bcdfghjklmnpqrstvwx")
    known = [(t, dict(labels)[i]) for i, t in rows] + [(f"{odd} dolt {'bafel ' * k}", 1) for k in range(40)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(known, "text string, toxic int"))
    assert not [t for t in lexicon.terms if "zork" in t]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=3), st.integers(0, 9), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 400)), max_size=80), st.randoms())
def test_quotient_filters_are_lossless_and_merge(widths, block_bits, entries, rng):
    draw = np.random.default_rng(rng.randrange(1 << 30))
    seeds = np.stack([draw.integers(0, 1 << w, 61, dtype=np.uint64, endpoint=False) if w < 64 else draw.integers(0, 1 << 63, 61, dtype=np.uint64) * np.uint64(2) for w in widths], axis=1)
    assert (permuted(seeds, widths) <= np.array([(1 << w) - 1 for w in widths], np.uint64)).all()
    want: Counter = Counter()
    shards: dict[int, list] = {}
    for part in range(3):
        some = entries[part::3]
        for i, c in some:
            want[tuple(seeds[i].tolist())] += c
        if some:
            x = permuted(seeds[[i for i, _ in some]], widths)
            assert (restored(x, widths) == seeds[[i for i, _ in some]]).all()
            for f in filters_of(*counted(x, np.array([c for _, c in some])), widths, block_bits):
                again = QuotientFilter.from_bytes(f.to_bytes())
                assert (again.x == f.x).all() and (again.counts == f.counts).all() and again.block == f.block
                shards.setdefault(f.block, []).append(again)
    got: Counter = Counter()
    for filters in shards.values():
        whole = QuotientFilter.merged(filters)
        keys, counts = QuotientFilter.from_bytes(whole.to_bytes()).items()
        assert (whole.get(keys) == counts).all()
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            assert tuple(k) not in got
            got[tuple(k)] = c
    assert got == want


def test_first_lanes_that_clash_stay_apart():
    x = np.array([[5, 2], [5, 1], [5, 2], [3, 9]], np.uint64)
    keys, counts = counted(x)
    assert keys.tolist() == [[3, 9], [5, 1], [5, 2]] and counts.tolist() == [1, 1, 2]


@given(st.integers(1, 1 << 34), st.integers(1, 5), st.randoms())
@settings(max_examples=60, deadline=None)
def test_packed_ids_come_back(size, k, rng):
    packer = collocations.KeyPacker(size)
    ids = [[rng.randint(1, size) for _ in range(k)] for _ in range(5)]
    keys = packer.pack([np.array(c) for c in zip(*ids, strict=True)])
    assert packer.unpack(keys, k).tolist() == ids


def brute_collocations(rows, least, top):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [q for (lq, q), c in f.items() if lq == lang and c >= least and len(q) > len(p) and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if longer:
            continue
        s, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, total[lang], s))
    want = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        want += [(o[0], i, *o[1:]) for i, o in enumerate(mine[:top], 1)]
    return sorted(want)


def test_collocations_against_all_counts(spark, docs_of):
    rng = random.Random(1)
    vocabulary = ["the", "of", "New", "york", "new", "état", "x-y", "a\x01", "\x1f", "ß", *[f"w{i}" for i in range(15)]]
    rows = [(0, None, "en"), (1, "", "en"), (2, " \t\n.", None), (3, "New York City\tNEW york city. " * 40, None), (4, "the of " * 9000, "de")]
    for i in range(5, 300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", ", ", "\r\n", " ", " "]) for _ in range(60))
        rows.append((i, text, rng.choice(["en", "fr"])))
        if i % 7 == 0:
            rows.append(rows[-1])
    docs = docs_of(rows).withColumnRenamed("source", "word").selectExpr("*", "1 as ids", "2 as rank")
    want = brute_collocations(rows, 10, 25)
    assert len(want) > 40 and {w[0] for w in want} >= {"und", "de", "en", "fr"}
    for words, pairs in ((1000, 1000), (0, 1000), (1000, 0)):  # sent to the tasks, or not
        got = collocations.collocations(docs, least=10, top=25, sent_words=words, sent_pairs=pairs)
        assert sorted(map(tuple, got.collect())) == want
    assert collocations.collocations(docs_of([])).count() == 0
    assert collocations.collocations(docs_of(rows), least=10**6).count() == 0


def test_many_flushes_and_blocks_give_the_same_counts(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(200)), "en") for i in range(40)]
    texts = docs_of(rows).select("lang", "text")
    vocabulary = collocations.numbered(collocations.word_counts(texts, 5, limit=3).filter("word is not null")).cache()
    seen = []
    for n_words, room in ((8000, 10**6), (1 << 36, 500)):
        got = collocations.phrase_counts(texts, vocabulary, vocabulary.count(), n_words, 5, 4, 100, 1000, room)
        seen.append(sorted((tuple(r["ids"]), r["f"]) for r in got.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 300


def brute_negatives(rows):
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        good.append((vec_id, [int(np.floor(256 * c)) for c in v], label))
    out = []
    for i, (a, q, label) in enumerate(good):
        if a is None or a % 50:
            continue
        score = [(-sum(x * y for x, y in zip(q, v, strict=True)), b is None, b or 0, j) for j, (b, v, _) in enumerate(good) if j != i and len(v) == len(q)]
        near = sorted(s for s in score if good[s[3]][2] == label)[:5]
        for p in near:
            inside = sorted(s for s in score if good[s[3]][2] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])[:3]
            out += [(a, good[p[3]][0], r, good[s[3]][0], -p[0], -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def test_hard_negatives_against_all_products(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 0.4
    rows = []
    for i in range(1500):
        v = (centres[i % 4] + rng.normal(size=6) * 0.2).astype(np.float32)
        if i % 3 == 0:
            v = centres[0].astype(np.float32)  # one vector held by a third of the rows
        rows.append((i, [float(c) for c in v], int(i % 4) if i % 11 else int(rng.integers(0, 3))))
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (None, rows[4][1], 1), (2000, None, 1), (2050, [0.1] * 6, None), (2100, [float("nan")] + [0.0] * 5, 1)]
    rows += [(2150, [None] + [0.0] * 5, 1), (2200, [0.5, 0.25], 2), (2201, [0.5, 0.5], 2), (2202, [0.2, 0.9], 3), (2250, [], 1), (2251, [], 1), (2252, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rid", "2 as x", "3 as rank").repartition(5)
    want = brute_negatives(rows)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, file_bytes=1 << 10, chunk=7).collect()), key=str)
    assert got == want and len(want) > 200
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e8, 1.0, 1.0], 1), (1, [3e8, 2.0, 1.0], 1), (2, [3e8, 2.5, 1.0], 1), (3, [2.8e8, 0.0, 3.0], 2), (4, [2.8e8, 0.0, 3.25], 2), (5, [1e20, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    top = (1 << 63) - 1
    want = [(*r[:4], min(top, r[4]), min(top, r[5])) for r in brute_negatives(rows)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=str) == sorted(want, key=str)


def test_boxes_leave_pages_out():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(20_000, 3)))
    order = hard_negatives.str_order(x)
    starts = hard_negatives.page_starts(*x.shape)
    assert sorted(order.tolist()) == list(range(20_000)) and max(np.diff([*starts, 20_000])) <= hard_negatives.PAGE
    ids = np.arange(20_000)
    tree = hard_negatives.BoxTree(x[order], starts, ids[order], ids[order])
    q = x[17]
    window = hard_negatives.ScoreWindow(-np.inf, np.inf, 5)
    read = hard_negatives.search(tree, q, [window])
    want = sorted(zip((-(x @ q)).tolist(), ids.tolist(), strict=True))[:5]
    assert [(s, v) for s, v, _ in window.best] == want and read < len(starts) / 5


def test_batches_without_a_usable_row(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [None], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.usable_rows(df).count() == 0
