"""Speech and respiratory audio on segment, feature and sample tables.

Everything works row by row or in chunks; terms are found in blocks of the joined text,
so a recording of any length need not be one text value.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl, ratio
from wardwatch.functions.text import LETTERS, MARKS, PLAIN, exact_round, fixed, fold_runs, normalize, original_offset
from wardwatch.operators.random_forest import Forest, grow_forest
from wardwatch.operators.vitals import window_numbers
from wardwatch.plans.joins import interval_join
from wardwatch.plans.materialise import written
from wardwatch.plans.ordered import DEFAULT_CHUNK, carried, chunk_window, core_rows, dense_index, with_halo
from wardwatch.session import ensure_checkpoint_dir

CONTEXT = 40
ROWS_PER_TASK = 20_000
NODES_IN_DRIVER = 600_000  # of a forest, some 400 bytes each
SALTS = 64
NO_SPEECH = 0.6
SENTIMENT_THRESHOLD = 0.2
JITTER_LIMIT, SHIMMER_LIMIT, HNR_LIMIT = 0.0104, 0.0381, 15.0

# Clinical terms searched in transcripts.
TERMS = [
    "dor",
    "doendo",
    "doer",
    "dói",
    "dolor",
    "dolorido",
    "dolorida",
    "falta de ar",
    "dificuldade para respirar",
    "chiado",
    "cansaço",
    "cansaço excessivo",
    "fôlego curto",
    "não consigo dobrar",
    "não consigo mexer",
    "travado",
    "travada",
    "inchado",
    "inchada",
    "inflamado",
    "inflamada",
    "rigidez",
    "rígido",
    "tontura",
    "tonto",
    "tonta",
    "desmaio",
    "desmaiar",
    "formigamento",
    "dormência",
    "convulsão",
    "dor no peito",
    "palpitação",
    "coração acelerado",
    "pressão alta",
    "pressão baixa",
    "febre",
    "febril",
    "náusea",
    "vômito",
    "vomitar",
    "suor frio",
    "mal-estar",
    "fraqueza",
]

# Positive and negative words of the sentiment lexicon.
POSITIVE = [
    "bem",
    "otimo",
    "otima",
    "melhor",
    "melhorando",
    "tranquilo",
    "tranquila",
    "aliviado",
    "aliviada",
    "feliz",
    "calmo",
    "calma",
    "confortavel",
]
NEGATIVE = [
    "mal",
    "dor",
    "doendo",
    "doer",
    "doi",
    "dolor",
    "dolorido",
    "dolorida",
    "doem",
    "pior",
    "piorando",
    "piorou",
    "ruim",
    "grave",
    "forte",
    "intensa",
    "intenso",
    "preocupado",
    "preocupada",
    "cansado",
    "cansada",
    "triste",
    "assustado",
    "assustada",
    "sofrendo",
    "nervoso",
    "nervosa",
    "ansioso",
    "ansiosa",
    "travado",
    "travada",
    "inchado",
    "inchada",
    "inflamado",
    "inflamada",
    "rigido",
    "rigida",
    "limitado",
    "limitada",
    "dificil",
    "dificuldade",
    "febre",
    "nausea",
    "vomito",
    "vomitar",
    "tontura",
    "tonto",
    "tonta",
    "fraqueza",
    "falta",
    "desmaio",
]


def default_terms() -> list[str]:
    return list(TERMS)


def assemble_transcript(segments: DataFrame, threshold: float = NO_SPEECH) -> DataFrame:
    """Text in segment order, mean no-speech probability, and whether it is reliable."""
    out = segments.groupBy("recording_id").agg(
        F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("_s"), F.avg("no_speech_prob").alias("avg_no_speech")
    )
    out = out.select("recording_id", F.array_join("_s.text", "").alias("text"), F.coalesce("avg_no_speech", dbl(1)).alias("avg_no_speech"))
    return out.withColumn("reliable", F.col("text").rlike(r"\S") & (F.col("avg_no_speech") <= dbl(threshold)))


BLOCK = 8192


def folded_terms(terms: Sequence[str]) -> list[tuple[int, str, str]]:
    """(order, term, folded term) of the terms that fold to something."""
    out = []
    for i, t in enumerate(terms):
        low = "".join(c for c in (t or "").replace("\u0130", "i").lower())
        fold = low.translate(str.maketrans(LETTERS, PLAIN, MARKS))
        if fold:
            out.append((i, t, fold))
    return out


def overlaps_itself(term: str) -> bool:
    return any(term.startswith(term[k:]) for k in range(1, len(term)))


def _trie_pattern(terms: Sequence[str]) -> str:
    """One pattern of all terms, branching by letter like a trie; it takes the longest."""
    ends = "" in terms
    first = sorted({t[0] for t in terms if t})
    if not first:
        return ""
    branches = [re.sub(r"([^\w ])", r"\\\1", c) + _trie_pattern([t[1:] for t in terms if t and t[0] == c]) for c in first]
    if len(branches) == 1 and not ends:
        return branches[0]
    return "(?:" + "|".join(branches) + ")" + ("?" if ends else "")


def _block_hits(blocks: DataFrame, terms: Sequence[str], context: int) -> DataFrame:
    """Hits that start in the core of a block ``(recording_id, at, before, core, text)``.

    One pattern of all terms finds, at every place of the folded block, the longest term
    there; the others that fit are its beginnings, known beforehand. The block is never
    copied per term, and only places where a term stands become rows.
    """
    known = folded_terms(terms)
    apart = [f for f in known if not overlaps_itself(f[2])]
    if apart and len(apart) < len(known):
        # Terms that can overlap themselves take a second look at their own, rarer places.
        rest = [f for f in known if overlaps_itself(f[2])]
        return _places(blocks, apart, context).unionByName(_apart(_places(blocks, rest, context), rest))
    return _places(blocks, known, context) if apart or not known else _apart(_places(blocks, known, context), known)


def _places(blocks: DataFrame, known: Sequence[tuple[int, str, str]], context: int) -> DataFrame:
    """All places of the terms ``known``, overlapping ones too."""
    if not known:
        return blocks.select("recording_id", F.lit(0).alias("order"), F.lit("").alias("term"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("char_at"), F.lit("").alias("context")).limit(0)
    pattern = _trie_pattern([f for _, _, f in known])
    entry = lambda e: F.struct(F.lit(e[0]).alias("order"), F.lit(e[1]).alias("term"), F.lit(len(e[2])).alias("n"))
    fitting = F.create_map(*[x for f in sorted({f for _, _, f in known}) for x in (F.lit(f), F.array(*[entry(e) for e in known if f.startswith(e[2])]))])

    def once(df: DataFrame, **values: Column) -> DataFrame:
        """Columns computed once a row: an expression that a lambda reads would otherwise be
        computed anew for each of its elements."""
        return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))

    texts = once(blocks, _n=normalize(F.col("text"))).filter(F.col("_n").rlike(pattern))
    pieces = once(texts, _p=F.split("_n", f"(?={pattern})", -1), _m=F.regexp_extract_all("_n", F.lit(f"(?=({pattern}))"), F.lit(1)), _r=fold_runs(F.col("text"))).drop("_n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate("_p", start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    # Without a hit at its start the block's first piece belongs to none.
    placed = once(pieces, _at=F.slice(places, F.size("_p") - F.size("_m") + 1, F.size("_m"))).drop("_p")
    hits = placed.select("recording_id", "at", "before", "core", "text", "_r", F.inline(F.arrays_zip(F.col("_at").alias("p"), F.col("_m").alias("m"))))
    hits = hits.select("recording_id", "at", "before", "core", "text", "_r", "p", F.inline(F.element_at(fitting, F.col("m"))))
    marked = F.size("_r") > 0
    first = F.when(marked, original_offset(F.col("p"), F.col("_r"))).otherwise(F.col("p"))
    hits = hits.withColumn("_s", first).filter((F.col("_s") >= F.col("before")) & (F.col("_s") < F.col("before") + F.col("core")))
    end = F.when(marked, original_offset(F.col("p") + F.col("n"), F.col("_r"))).otherwise(F.col("p") + F.col("n"))
    left = F.greatest(F.col("_s") - context, F.lit(0))
    shown = F.substring(F.col("text"), left + 1, F.least(end + context, F.length("text")) - left)
    return hits.select("recording_id", "order", "term", "n", (F.col("at") + F.col("_s")).cast("long").alias("char_at"), shown.alias("context"))


def _apart(hits: DataFrame, known: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Of overlapping places of one term, those that a search from left to right takes.
    Only terms whose end is also their beginning can overlap."""
    columns = hits.columns
    hits = written(hits)  # read several times below
    keys = ["recording_id", "order"]
    near = with_halo(hits, "char_at", before=2 * max(len(f) for _, _, f in known))
    gap = F.col("char_at") - F.lag("char_at").over(chunk_window(keys, "char_at"))
    marked = core_rows(near.withColumn("_new", F.when(gap.isNull() | (gap >= F.col("n")), F.col("char_at"))))
    groups = carried(marked, keys, "char_at", last={"_group": F.col("_new")})
    rows = groups.groupBy(*keys, "term", "n", "_group").agg(F.sort_array(F.collect_list(F.struct("char_at", "context"))).alias("_all"))
    kind = "struct<next:bigint,kept:array<struct<char_at:bigint,context:string>>>"
    start = F.struct(F.lit(-1).cast("long").alias("next"), F.array().cast("array<struct<char_at:bigint,context:string>>").alias("kept")).cast(kind)

    def step(acc: Column, h: Column) -> Column:
        taken = F.struct((h["char_at"] + F.col("n")).alias("next"), F.concat(acc["kept"], F.array(h)).alias("kept")).cast(kind)
        return F.when(h["char_at"] >= acc["next"], taken).otherwise(acc)

    kept = rows.select(*keys, "term", "n", F.inline(F.aggregate("_all", start, step, lambda acc: acc["kept"])))
    return kept.select(*columns)


def _reach(terms: Sequence[str], context: int) -> int:
    """Characters behind a block's core that a hit and its context may need; each letter
    may carry several marks."""
    return 4 * max([len(t) for t in terms if t] or [0]) + context


def find_terms(transcripts: DataFrame, terms: Sequence[str], context: int = CONTEXT) -> DataFrame:
    """Hits of every term, as a substring without regard to case or accents, with the
    surrounding original text. ``order`` numbers the terms; ``char_at`` counts characters
    of the text as it is. Long texts are searched block by block."""
    after = _reach(terms, context)
    size = F.length("text")
    cut = transcripts.select("recording_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(BLOCK))).alias("_b"))
    at = F.greatest(F.col("_b") - context, F.lit(0))
    part = F.when(size <= BLOCK, F.col("text")).otherwise(F.substring(F.col("text"), at + 1, F.col("_b") - at + BLOCK + after))
    blocks = cut.select("recording_id", at.alias("at"), (F.col("_b") - at).alias("before"), F.lit(BLOCK).alias("core"), part.alias("text"))
    return _block_hits(blocks, terms, context).drop("n")


def segment_blocks(segments: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Blocks ``(recording_id, at, before, core, text)`` of the joined text of a recording's
    segments, which never exists as one value: each segment gives every block that looks
    at it the characters it needs, placed by its running offset."""
    rows = segments.select("recording_id", "seg_idx", "text", F.length("text").cast("long").alias("_len")).filter("_len > 0")
    rows = carried(rows, ["recording_id"], "seg_idx", sums={"_to": F.col("_len")}).withColumn("_from", F.col("_to") - F.col("_len"))
    first = F.greatest(F.floor((F.col("_from") - after) / F.lit(block)), F.lit(0)).cast("long")
    last = F.floor((F.col("_to") - 1 + before) / F.lit(block)).cast("long")
    spread = rows.withColumn("_b", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_from"), F.col("_b") * block - before)
    end = F.least(F.col("_to"), (F.col("_b") + 1) * block + after)
    piece = F.substring(F.col("text"), (start - F.col("_from") + 1).cast("int"), (end - start).cast("int"))
    parts = spread.filter(end > start).select("recording_id", "_b", start.alias("_s"), piece.alias("_t"))
    joined = parts.groupBy("recording_id", "_b").agg(F.array_sort(F.collect_list(F.struct("_s", "_t"))).alias("_a"), F.min("_s").alias("at"))
    core = F.lit(block)
    return joined.select("recording_id", "at", (F.col("_b") * block - F.col("at")).cast("int").alias("before"), core.alias("core"), F.array_join("_a._t", "").alias("text"))


def find_terms_in_segments(segments: DataFrame, terms: Sequence[str], context: int = CONTEXT, block: int = BLOCK) -> DataFrame:
    """As ``find_terms`` on the joined text of each recording, across segment borders."""
    return _block_hits(segment_blocks(segments, context, _reach(terms, context), block), terms, context).drop("n")


def term_timestamp(hits: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Adds the start of the segment whose text covers the hit, else NULL."""
    spans = carried(
        segments.select("recording_id", "seg_idx", "start_s", F.length("text").cast("long").alias("_len")),
        ["recording_id"],
        "seg_idx",
        sums={"_to": F.col("_len")},
    ).select("recording_id", (F.col("_to") - F.col("_len")).alias("_from"), "_to", F.col("start_s").alias("approx_timestamp_s"))
    return interval_join(hits, spans, ["recording_id"], "char_at", "_from", "_to", width, "left").drop("_from", "_to")


def highlight_term(text: Column, term: Column | str) -> Column:
    """First occurrence of the term in ``**``."""
    t = normalize(F.lit(term) if isinstance(term, str) else term)
    at = F.call_function("locate", t, normalize(text))
    runs = fold_runs(text)
    first, end = original_offset(at - 1, runs), original_offset(at - 1 + F.length(t), runs)
    marked = F.concat(
        F.substring(text, F.lit(1), first), F.lit("**"), F.substring(text, first + 1, end - first), F.lit("**"), F.substring(text, end + 1, F.length(text))
    )
    return F.when(at > 0, marked).otherwise(text)


def lexicon_sentiment(
    text: Column, positive: Sequence[str], negative: Sequence[str], threshold: float = SENTIMENT_THRESHOLD
) -> Column:
    """Struct (label, score): (pos - neg) / (pos + neg) over lexicon words."""
    words = F.regexp_extract_all(normalize(text), F.lit("[a-z]+"), F.lit(0))
    pos = F.size(F.filter(words, lambda w: w.isin(list(positive))))
    neg = F.size(F.filter(words, lambda w: w.isin(list(negative))))
    score = F.coalesce(ratio(pos - neg, pos + neg), dbl(0))
    label = F.when(F.abs(score) < dbl(threshold), "neutral").when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), score.alias("score"))


FEATURES = {"jitter_local": 1, "shimmer_local": 1, "hnr_db": -1, "pause_rate": 1, "speaking_rate_wps": -1}


def fatigue_relative(rows: DataFrame, threshold: float, by: str = "run_id") -> DataFrame:
    """Mean of five z-scores against all rows of the run; harmonicity and speaking
    rate count negatively. A feature without spread counts zero."""
    stats = rows.groupBy(by).agg(
        *[f(n).alias(f"_{tag}_{n}") for n in FEATURES for tag, f in [("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max)]]
    )
    total = dbl(0)
    for n, sign in FEATURES.items():
        z = F.when(F.col(f"_l_{n}") == F.col(f"_h_{n}"), dbl(0)).otherwise((F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}"))
        total = total + z * dbl(sign)
    # few runs hold all rows: each run is met under SALTS keys, so that none fills one task
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = salted.join(spread, [by, "_salt"]).withColumn("score", total / dbl(len(FEATURES)))
    return out.select(*rows.columns, "score", (F.col("score") > dbl(threshold)).alias("fatigued"))


def fatigue_absolute() -> Column:
    """Struct (fatigued, indicators) from fixed limits; two indicators make fatigue."""
    found = F.array_compact(
        F.array(
            F.when(F.col("jitter_local") > dbl(JITTER_LIMIT), F.lit("high_jitter")),
            F.when(F.col("shimmer_local") > dbl(SHIMMER_LIMIT), F.lit("high_shimmer")),
            F.when(F.col("hnr_db") < dbl(HNR_LIMIT), F.lit("low_hnr")),
        )
    )
    return F.struct((F.size(found) >= 2).alias("fatigued"), found.alias("indicators"))


def pause_and_rate(intervals: DataFrame, recordings: DataFrame) -> DataFrame:
    """Pause share and words per voiced second from voiced intervals
    ``(recording_id, start_s, end_s)`` and ``(recording_id, duration_s, text)``."""
    voiced = intervals.groupBy("recording_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_v"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    v = F.coalesce("_v", dbl(0))
    pause = F.when(F.col("duration_s") > 0, F.greatest(F.col("duration_s") - v, dbl(0)) / F.col("duration_s")).otherwise(dbl(0))
    rate = F.when(v > 0, words / v).otherwise(dbl(0))
    return recordings.join(voiced, "recording_id", "left").select(
        "recording_id", finite_or_zero(pause).alias("pause_rate"), finite_or_zero(rate).alias("speaking_rate_wps")
    )


def finite_or_zero(x: Column) -> Column:
    inf = dbl(float("inf"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == inf), dbl(0)).otherwise(x)


def energy_envelope(samples: DataFrame, frame: int, hop: int, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Root mean square of each complete frame; partial sums combine before the shuffle."""
    placed = samples.withColumn("k", F.explode(window_numbers(F.col("idx"), frame, hop)))
    sums = placed.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.col("x")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    return sums.filter(F.col("_n") == frame).select(*keys, "k", F.sqrt(F.col("_q") / dbl(frame)).alias("energy"))


def dominant_period(
    envelope: DataFrame,
    rate: float,
    min_hz: float = 0.15,
    max_hz: float = 0.5,
    keys: Sequence[str] = ("record_id",),
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Period in seconds of the strongest autocorrelation lag in the frequency band;
    NULL for short or flat envelopes, an empty band, or a peak below 0.3.

    The lags are few and fixed by the band, so each row meets its earlier rows in
    its chunk (with halo) and the products are summed per lag map-side.
    """
    lo, hi = max(1, int(rate / max_hz)), int(rate / min_hz)
    rows = with_halo(envelope, "k", chunk, before=hi)
    past = F.collect_list("energy").over(chunk_window(keys, "k").rowsBetween(-hi, 0))
    rows = core_rows(rows.withColumn("_past", past))
    lags = F.concat(F.array(F.lit(0)), F.sequence(F.lit(lo), F.lit(max(lo, hi - 1))))
    pairs = F.transform(lags, lambda g: F.struct(g.alias("lag"), F.col("energy").alias("_a"), F.get("_past", F.size("_past") - 1 - g).alias("_b")))
    sums = (
        rows.select(*keys, F.inline(pairs))
        .filter(F.col("_b").isNotNull())
        .groupBy(*keys, "lag")
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") + F.col("_b")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    )
    # the mean is known from lag 0, and centring the products afterwards needs only sums
    whole = sums.filter("lag = 0").select(*keys, F.col("_n").alias("n"), (F.col("_s") / (F.col("_n") * 2)).alias("_m"), F.col("_ab").alias("_e"))
    m = F.col("_m")
    corr = sums.join(whole, list(keys)).select(*keys, "n", "lag", "_e", (F.col("_ab") - m * F.col("_s") + F.col("_n") * m * m).alias("_c"))
    allowed = (F.col("lag") >= lo) & (F.col("lag") < F.least(F.col("n") - 1, F.lit(hi)))
    best = corr.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("_e").alias("_e"),
        F.max(F.when(F.col("lag") == 0, F.col("_c"))).alias("_zero"),
        F.max_by(F.struct("lag", "_c"), F.when(allowed, F.struct(F.col("_c"), -F.col("lag")))).alias("_b"),
    )
    usable = (F.col("n") >= 10) & (F.col("_zero") > F.col("_e") * dbl(1e-12)) & (F.least(F.col("n") - 1, F.lit(hi)) > lo)
    strength = F.try_divide(F.col("_b._c"), F.col("_zero"))
    return best.select(*keys, "n", F.when(usable & (strength >= dbl(0.3)), F.col("_b.lag") / dbl(rate)).alias("period_s"))


def respiratory_pattern(n: Column, period: Column, low_ratio: Column) -> Column:
    """Struct (detected, breath_rate_bpm, confidence, method) of an envelope."""
    none = F.lit(None).cast("double")

    def out(detected: bool, rate: Column, confidence: Column, method: Column) -> Column:
        return F.struct(
            F.lit(detected).alias("detected"), rate.alias("breath_rate_bpm"), confidence.alias("confidence"), method.alias("method")
        )

    periodic = F.concat(F.lit("envelope autocorrelation (period="), fixed(period, 2), F.lit("s)"))
    return (
        F.when(n < 20, out(False, none, dbl(0), F.lit("audio too short")))
        .when(
            period.isNotNull(),
            out(True, exact_round(dbl(60) / period, 1), exact_round(F.least(dbl(1), dbl(0.5) + dbl(0.5) * low_ratio), 2), periodic),
        )
        .when(low_ratio > dbl(0.6), out(True, none, exact_round(low_ratio, 2), F.lit("energy mostly in the low band")))
        .otherwise(out(False, none, dbl(0), F.lit("no respiratory pattern")))
    )


def consult_severity(hits: Column, fatigued: Column, pattern: Column, confidence: Column, sentiment: Column) -> Column:
    """Struct (severity, event_type, confidence, status) of a reliable consultation."""
    said = hits > 0
    breathes = pattern & (confidence >= dbl(0.5))

    def case(severity: str, kind: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("event_type"))

    main = (
        F.when(said & fatigued, case("HIGH", "critical_terms_and_fatigue"))
        .when(said, case("MEDIUM", "critical_terms"))
        .when(fatigued, case("MEDIUM", "vocal_fatigue"))
        .when(breathes, case("LOW", "respiratory_pattern"))
        .when(sentiment != "neutral", case("INFO", "sentiment"))
        .otherwise(case("INFO", "speech_analysis"))
    )
    return F.struct(
        main["severity"].alias("severity"),
        main["event_type"].alias("event_type"),
        F.when(said | fatigued, dbl(0.85)).otherwise(dbl(0.5)).alias("confidence"),
        F.when(said | fatigued | pattern, "positive").otherwise("negative").alias("status"),
    )


def consult_score(reliable: Column, hits: Column, fatigued: Column, pattern: Column, confidence: Column) -> Column:
    """Score of a consultation; an unreliable transcript scores only a breathing pattern."""
    by_terms = F.when(hits > 0, dbl(0.5) + F.least(hits * dbl(0.1), dbl(0.5))).otherwise(dbl(0))
    by_fatigue = F.when(fatigued, dbl(0.7)).otherwise(dbl(0))
    by_breath = F.when(pattern & (confidence >= dbl(0.5)), dbl(0.3)).otherwise(dbl(0))
    return F.when(reliable, F.greatest(by_terms, by_fatigue, by_breath)).when(pattern & (confidence >= dbl(0.3)), dbl(0.3))


def consult_summary(
    segments: DataFrame,
    acoustic: DataFrame | None,
    terms: Sequence[str],
    positive: Sequence[str],
    negative: Sequence[str],
    fatigue_threshold: float,
    no_speech: float = NO_SPEECH,
    sentiment_threshold: float = SENTIMENT_THRESHOLD,
) -> DataFrame:
    """One row per recording: reliability, sentiment, term count, relative fatigue.

    Unreliable transcripts have NULL sentiment and no terms; recordings without
    acoustic features have NULL fatigue.
    """
    t = assemble_transcript(segments, no_speech)
    n = find_terms(t.filter("reliable"), terms).groupBy("recording_id").agg(F.count(F.lit(1)).alias("_hits"))
    mood = F.when(F.col("reliable"), lexicon_sentiment(F.col("text"), positive, negative, sentiment_threshold))
    out = t.withColumn("_m", mood).join(n, "recording_id", "left")
    if acoustic is not None:
        tired = fatigue_relative(acoustic, fatigue_threshold).select("recording_id", F.col("score").alias("fatigue_score"), "fatigued")
        out = out.join(tired, "recording_id", "left")
    else:
        out = out.withColumns({"fatigue_score": F.lit(None).cast("double"), "fatigued": F.lit(None).cast("boolean")})
    return out.select(
        "recording_id",
        "reliable",
        F.col("_m.label").alias("sentiment_label"),
        F.coalesce("_m.score", dbl(0)).alias("sentiment_score"),
        F.coalesce("_hits", F.lit(0)).alias("critical_terms_found"),
        "fatigue_score",
        "fatigued",
    )


def patient_order(cycles: DataFrame, seed: int) -> DataFrame:
    """Distinct patients with their place in a seeded hash order."""
    ids = cycles.select("patient_id").distinct()
    hashed = ids.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("patient_id"))))
    return dense_index(hashed, [], ["_h", "patient_id"], F.substring("_h", 1, 3), "place")


def sample_patients(cycles: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All cycles of ``n`` patients picked by seeded hash."""
    chosen = patient_order(cycles, seed).filter(F.col("place") < n)
    return cycles.join(chosen.select("patient_id"), "patient_id", "left_semi")


def group_split(cycles: DataFrame, test_size: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test cycles; a patient is on one side only. The share is of patients."""
    placed = patient_order(cycles, seed)
    n_test = cycles.agg(F.ceil(F.count_distinct("patient_id") * dbl(test_size)).alias("_n")).scalar()
    test = placed.filter(F.col("place") < n_test).select("patient_id")
    return cycles.join(test, "patient_id", "left_anti"), cycles.join(test, "patient_id", "left_semi")


def training_rows(train: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``label``, vector ``_x`` and ``_weight``, inverse to the size of the class. Rows are
    dealt evenly and in fixed order, by their hash: a join by label would leave a task a class."""
    from pyspark.ml.functions import array_to_vector

    sizes = written(train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    n, mean = sizes.agg(F.sum("_n"), F.sum("_n") / F.count(F.lit(1))).first()
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-(n or 0) // ROWS_PER_TASK))
    dealt = train.select(label, features, F.xxhash64(*train.columns).alias("_h")).repartition(parts, "_h").sortWithinPartitions("_h")
    return dealt.join(F.broadcast(sizes), label).select(
        label, array_to_vector(F.col(features)).alias("_x"), (F.lit(mean) / F.col("_n")).alias("_weight")
    )


def train_cycle_classifier(
    train: DataFrame, label: str = "label", features: str = "features", trees: int = 200, seed: int = 42, depth: int = 30, nodes: int = NODES_IN_DRIVER
):
    """Random forest over array features; rows weigh inversely to their class size.
    Trees end at ``depth`` levels, by default the deepest that Spark grows.

    Spark's forest keeps all nodes in the driver, two for each row and tree if no leaf is
    left to chance; it grows forests that may have up to ``nodes``, each row keeping its node
    of every tree, so that no level walks the trees again. Tasks grow the trees of larger ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = training_rows(train, label, features)
    if 2 * trees * train.count() > nodes:
        return grow_forest(rows.select(label, vector_to_array("_x").alias("_x"), "_weight"), label, trees, depth, seed)
    ensure_checkpoint_dir(train.sparkSession)  # the node ids of a row cut their lineage there
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(
        labelCol="_y", featuresCol="_x", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True
    )
    return Pipeline(stages=[index, forest]).fit(rows)


def predict_cycles(model, cycles: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``predicted_label`` and ``confidence``, the probability of the winner."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if isinstance(model, Forest):
        names = F.array(*[F.lit(x) for x in model.labels])
        out = cycles.withColumn("_p", model.predicted(features))
        return out.select(*cycles.columns, F.get(names, "_p.prediction").alias("predicted_label"), F.col("_p.confidence").alias("confidence"))
    index, forest = model.stages
    out = forest.transform(cycles.withColumn("_x", array_to_vector(F.col(features))))
    names = F.array(*[F.lit(x) for x in index.labels])
    return out.select(
        *cycles.columns,
        F.get(names, F.col("prediction").cast("int")).alias("predicted_label"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def cycle_positions(cycles: DataFrame) -> DataFrame:
    """Adds the one-based ``position`` of a cycle among its recording's cycles."""
    bucket = F.floor(F.col("cycle_index") / 65536).cast("long")
    return dense_index(cycles, ["record_id"], ["cycle_index", "start_s", "end_s"], bucket, "_at").withColumn(
        "position", F.col("_at") + 1
    ).drop("_at")


def worst_cycle(predicted: DataFrame) -> DataFrame:
    """Most confident cycle that is not normal, the first on ties."""
    bad = predicted.filter(F.col("predicted_label") != "normal")
    best = F.max_by(F.struct("position", "predicted_label", "confidence"), F.struct(F.col("confidence"), -F.col("position")))
    return bad.groupBy("record_id").agg(best.alias("_b")).select("record_id", "_b.*")


def anomalous_cycle_evidence(predicted: DataFrame) -> DataFrame:
    ident = F.concat(F.col("record_id"), F.lit("-cycle"), F.col("cycle_index").cast("string"), F.lit("-"), F.col("predicted_label"))
    return predicted.filter(F.col("predicted_label") != "normal").withColumn("evidence_id", ident)

