"""Quality rules: repetition counts, and tokeniser fertility with bands per language."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window

from wardwatch.llm.shared import apart, discard, stored, text_tag
from wardwatch.llm.vocabulary import encoder
from wardwatch.llm.words import mixed, word_hashes

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURED = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("language", pa.string()),
        ("script", pa.string()),
        ("half", pa.int32()),
        ("digest", pa.binary()),
        ("chars_per_token", pa.float64()),
        ("token_entropy", pa.float64()),
        ("byte_share", pa.float64()),
    ]
)
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]


@lru_cache(maxsize=2)
def known_characters(path: str) -> frozenset[str]:
    """Characters that are pieces of a byte-fallback vocabulary; all others are written
    as one byte token per UTF-8 byte. A space counts as its visible stand-in."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p for p in map(model.id_to_piece, range(model.vocab_size())) if len(p) == 1) | {" "}


def repeated_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a ``k``-word window found twice or more, first ones included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = word_hashes(words)
    acc = mixed(h[:n])
    for j in range(1, k):
        acc = mixed(acc * np.uint64(31) + h[j : j + n])
    _, place, count = np.unique(acc, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[place] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def script_of(characters: set[str], text: str) -> str:
    """The script with most of the letters; "none" without letters."""
    scripts = {c: next((s for s, a, b in SCRIPTS if a <= ord(c) <= b), "other") for c in characters if c.isalpha()}
    if len(set(scripts.values())) == 1:
        return next(iter(scripts.values()))
    count: dict[str, int] = {}
    for c, name in scripts.items():
        count[name] = count.get(name, 0) + text.count(c)
    return max(sorted(count), key=count.__getitem__, default="none")


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy of the tokens as a share of the most that their number allows."""
    if len(ids) < 2:
        return 1.0
    count = np.diff(np.flatnonzero(np.diff(np.sort(ids), prepend=-1, append=-1)))
    p = count / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(len(ids)))


def measured(docs: DataFrame, byte_bpe: str, fallback: str, carry: str = "doc_id") -> DataFrame:
    """Counts, fertility and stratum of every row in a column ``_m``, beside ``row``: a
    struct of the column ``carry``.

    chars_per_token and token_entropy are those of the byte-level vocabulary; byte_share
    is the share of UTF-8 bytes that the byte-fallback vocabulary can write only as byte
    tokens. A null or empty text has zero counts and null measures. The stratum is the
    language without case and blanks, or the script where that is null or blank, and the
    half-octave of the token count: short texts scatter more."""

    def rows(batches):
        enc, known = encoder(byte_bpe), known_characters(fallback)
        for batch in batches:
            out = [_measures(t.as_py() or "", lang.as_py(), enc, known) for t, lang in zip(batch.column("text"), batch.column("lang"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, MEASURED)], names=["row", "_m"])

    kept = F.struct(F.col("doc_id").cast("long").alias("doc_id") if carry == "doc_id" else F.col(carry))
    given = docs.select(kept.alias("row"), F.col("text").cast("string").alias("text"), _lang(docs).alias("lang"))
    return given.mapInArrow(rows, T.StructType([given.schema["row"], T.StructField("_m", from_arrow_type(MEASURED))]))


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")


def _measures(text: str, lang: str | None, enc, known: frozenset[str]) -> dict:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids = enc.ids(text).astype(np.int64)
    characters = set(text)
    unknown = sum(len(c.encode("utf-8", "surrogatepass")) * text.count(c) for c in characters - known)
    n, repeats = len(ids), repeated_words(words)
    script = script_of(characters, text)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeats,
        "base_failed": len(words) < 10 or 100 * repeats > 20 * len(words),
        "language": "".join((lang or "").lower().split()) or f"script {script}",
        "script": script,
        "half": int(2 * np.log2(max(n, 1))),
        "digest": blake2b(raw, digest_size=16).digest(),
        "chars_per_token": len(text) / n if n else None,
        "token_entropy": entropy(ids) if n else None,
        "byte_share": unknown / len(raw) if n else None,
    }


def _quartiles(counts: DataFrame, *key: str) -> DataFrame:
    """(key, n, q1, q3) of grid values ``g`` that occur ``count`` times each."""
    w = Window.partitionBy(*key)
    counts = counts.withColumn("_upto", F.sum("count").over(w.orderBy("g"))).withColumn("_all", F.sum("count").over(w))
    quartile = lambda q: F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("g")))
    return counts.groupBy(*key).agg(F.sum("count").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))


def bands(rows: DataFrame, widths: dict[str, tuple[float, float]], steps: float = 1e-4) -> DataFrame:
    """(_language, _script, _half, _low_*, _high_*): quartiles -/+ widths x interquartile
    range per language and half-octave, over distinct texts.

    The range is at least that of the language over all lengths about its line (measure by
    half-octave), less for texts longer than its mean, and the quartiles reach to that
    line's: similar texts that fill a stratum do not make theirs the only values allowed. A language without two lengths of ``THIN`` texts
    has the range of its script, or else of the corpus, as has one whose range is zero;
    for byte_share it is a byte in a text of that length at least.

    A stratum of less than ``THIN`` texts takes its quartiles from the language over all
    lengths (script, corpus) at the height of that line; for texts shorter than the mean
    that range is widened. So a text is never compared with itself alone, unless the
    corpus has no others.

    Quartiles are exact on a grid of ``steps``: texts are counted by grid value, map-side
    combined, and only those counts are ordered."""
    stratum = ["language", "script", "half"]
    texts = rows.groupBy(*stratum, "digest").agg(*[F.first(m).alias(m) for m in widths])
    pools = F.explode(F.array(F.concat(F.lit("language "), "language"), F.concat(F.lit("script "), "script"), F.lit("corpus"))).alias("pool")
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / steps).cast("long").alias("g")) for m in widths]))
    counts = texts.select(*stratum, grid.alias("_v"), "digest").select("language", "script", "half", "_v.measure", "_v.g").filter("g is not null")
    counts = stored(counts.select(pools, "half", "measure", "g").groupBy("pool", "half", "measure", "g").count(), "counts")
    own = _quartiles(counts.filter("pool like 'language %'"), "pool", "half", "measure")

    # lines follow the lengths that have THIN texts or more: no single text bends one
    total = lambda x: F.sum(F.col("count") * x)
    h, g = F.col("half"), F.col("g").cast("double")
    fat = (F.sum("count").over(Window.partitionBy("pool", "half", "measure")) >= THIN).cast("long")
    sums = counts.withColumn("_f", fat).groupBy("pool", "measure").agg(
        *[total(x).alias(name) for name, x in (("_n", F.lit(1)), ("_h", h), ("_g", g), ("f", F.col("_f")), ("fh", F.col("_f") * h), ("fg", F.col("_f") * g), ("fhh", F.col("_f") * h * h), ("fhg", F.col("_f") * h * g))]
    )
    across = F.col("f") * F.col("fhh") - F.col("fh") * F.col("fh")
    slope = F.when(across > 0, (F.col("f") * F.col("fhg") - F.col("fh") * F.col("fg")) / across)
    mean = lambda x: F.when(F.col("f") > 0, F.col(f"f{x}") / F.col("f")).otherwise(F.col(f"_{x}") / F.col("_n"))
    lines = sums.select("pool", "measure", (across > 0).alias("lined"), F.coalesce(slope, F.lit(0.0)).alias("slope"), mean("h").alias("mean_half"), mean("g").alias("mean_g"))
    off = F.round(g - F.col("mean_g") - F.col("slope") * (h - F.col("mean_half"))).cast("long")
    wide = _quartiles(counts.join(lines, ["pool", "measure"]).groupBy("pool", "measure", off.alias("g")).agg(F.sum("count").alias("count")), "pool", "measure")
    wide = wide.join(lines, ["pool", "measure"]).select("pool", "measure", F.struct("n", "q1", "q3", "lined", "slope", "mean_half", "mean_g").alias("w"))

    found = texts.select(*stratum).distinct().withColumn("measure", F.explode(F.array(*map(F.lit, widths))))
    found = found.withColumn("pool", F.concat(F.lit("language "), "language")).join(own, ["pool", "half", "measure"])
    found = found.join(wide.withColumnRenamed("w", "_l"), ["pool", "measure"]).withColumn("pool", F.concat(F.lit("script "), "script"))
    found = found.join(wide.withColumnRenamed("w", "_s"), ["pool", "measure"]).withColumn("pool", F.lit("corpus"))
    found = found.join(wide.withColumnRenamed("w", "_c"), ["pool", "measure"])
    found = found.withColumn("_p", F.when(F.col("_l.lined"), F.col("_l")).when(F.col("_s.lined"), F.col("_s")).otherwise(F.col("_c")))
    shorter = F.pow(F.lit(2.0), (F.col("_p.mean_half") - h) / 4)  # scatter falls with the root of the length
    between = F.col("_p.q3") - F.col("_p.q1")
    floor = F.when(between > 0, between).otherwise(F.col("_c.q3") - F.col("_c.q1")) * F.least(F.lit(1.0), shorter)
    floor = F.greatest(floor, F.when(F.col("measure") == "byte_share", F.pow(F.lit(2.0), -h / 2) / (4 * steps)).otherwise(0.0))
    line = F.col("_p.mean_g") + F.col("_p.slope") * (h - F.col("_p.mean_half")) + (F.col("_p.q1") + F.col("_p.q3")) / 2
    # too few texts of its own: the wider group's range about its line, at this length
    reach = F.greatest(between * F.greatest(F.lit(1.0), shorter), floor)
    thin = F.col("n") < THIN
    found = found.withColumn("_spread", F.when(thin, reach).otherwise(F.greatest(F.col("q3") - F.col("q1"), floor)))
    found = found.withColumn("_q1", F.when(thin, line - reach / 2).otherwise(F.least(F.col("q1"), line - floor / 2)))
    found = found.withColumn("_q3", F.when(thin, line + reach / 2).otherwise(F.greatest(F.col("q3"), line + floor / 2)))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, c * steps))
    edges = []
    for m, (below, above) in widths.items():
        edges.append(pick(m, F.col("_q1") - below * F.col("_spread") - 1).alias(f"_low_{m}"))
        edges.append(pick(m, F.col("_q3") + above * F.col("_spread") + 1).alias(f"_high_{m}"))
    return found.groupBy(*[F.col(c).alias(f"_{c}") for c in stratum]).agg(*edges)


# Distinct texts from which quartiles are taken at least, if a wider group has more.
THIN = 20

# Interquartile ranges below the first and above the third quartile. Repetition and
# markup lower the entropy; short lists of rare words raise it, and are no fault.
WIDTHS = {"chars_per_token": (5.0, 6.0), "token_entropy": (2.0, 6.0), "byte_share": (8.0, 8.0)}


def judged(docs: DataFrame, byte_bpe: str, fallback: str, widths: dict[str, tuple[float, float]] | None = None, carry: str = "doc_id") -> DataFrame:
    """``measured`` rows with ``kept``, written once: the bands need all rows first.

    A text fails at the base with fewer than 10 words, or if over a fifth of them lie in
    repeated windows. Others are kept if every measure lies in the band of their stratum."""
    widths = widths or WIDTHS
    rows = stored(measured(docs, byte_bpe, fallback, carry), "quality")
    edges = stored(bands(rows.filter("not _m.base_failed").select("_m.*"), widths), "bands")
    inside = F.lit(True)
    for m in widths:
        inside &= F.col(f"_m.{m}").between(F.col(f"_low_{m}"), F.col(f"_high_{m}"))
    here = [F.col(f"_m.{c}") == F.col(f"_{c}") for c in ("language", "script", "half")]
    joined = rows.join(edges, here, "left")
    return joined.withColumn("_kept", ~F.col("_m.base_failed") & F.coalesce(inside, F.lit(False))).select(*rows.columns, "_kept")


def judge(docs: DataFrame, byte_bpe: str, fallback: str, widths: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per document: counts, base_failed, kept and the measures.

    Null and empty texts fail at the base. Repeated rows count each; columns but doc_id,
    text and lang are ignored; an empty table gives no row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged(docs, byte_bpe, fallback, widths).select("row.doc_id", *[f"_m.{c}" for c in counts], F.col("_kept").alias("kept"), *[f"_m.{m}" for m in WIDTHS])


def kept_documents(docs: DataFrame, byte_bpe: str, fallback: str) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by itself, with all their columns.

    Null and empty texts go; repeated rows are judged each; extra columns may have any
    name; an empty table gives no row."""
    # rows of one text and lang are judged alike, so the stored measures need not carry texts
    key = F.struct(text_tag().alias("tag"), _lang(docs).alias("lang")).alias("key")
    rows = judged(docs.select(F.col("text"), _lang(docs).alias("lang"), key), byte_bpe, fallback, carry="key")
    failed = stored(rows.filter("not _kept").select("row.key").distinct(), "failed")
    discard(rows)
    maybe, others = apart(docs.select(F.struct(*docs.columns).alias("row"), key), failed, "key")
    return others.select("row").union(maybe.join(failed, "key", "left_anti").select("row")).select("row.*")
