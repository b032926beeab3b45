"""Phrase collocations per language, counted exactly in counting quotient filters.

Texts are read three times. The first pass counts words. The others pack the ids of
neighbouring words, all frequent enough themselves, into one key, count keys in quotient
filters inside the task and send the filters, cut into blocks, to the tasks that merge
them: first pairs, then longer phrases whose pairs are all frequent. Only phrases that
reach the threshold leave a merge; scores, cuts and containment are joins of those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardwatch.llm.quotient import QuotientFilter, counted, filters_of, permuted
from wardwatch.llm.shared import discard, stored
from wardwatch.plans.ordered import dense_index

SPLITS = b".,;:!?\n\x0b\x0c\r"
# A-Z lower-cased and every splitting character made a full stop, one byte for one.
FOLDED = bytes(46 if b in SPLITS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BORDER = b"."
ID_BUCKETS = 1024


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of several texts in a row, with BORDER, which is no word, between pieces."""
    return (b" " + BORDER + b" ").join(texts).translate(FOLDED).replace(BORDER, b" . ").split()


def _by_lang(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch by language, in groups of about ``size`` bytes."""
    groups: dict[str, list[bytes]] = {}
    held: Counter = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        body = text.as_py()
        if body:
            groups.setdefault(lang, []).append(body.encode("utf-8"))
            held[lang] += len(body)
            if held[lang] >= size:
                yield lang, groups.pop(lang)
                held[lang] = 0
    yield from groups.items()


def word_counts(texts: DataFrame, least: int, limit: int = 400_000) -> DataFrame:
    """(lang, word, c) of words met ``least`` times or more; word null: all words of the
    language. Each task adds up to ``limit`` words before it gives them on."""

    def rows(batches):
        seen: dict[str, Counter] = {}
        total: Counter = Counter()

        def flush():
            for lang, words in seen.items():
                borders = words.pop(BORDER, 0)
                total[lang] -= borders
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(words) + 1), pa.string()), pa.array([None, *words], pa.binary()).cast(pa.string()), pa.array([total[lang], *words.values()], pa.int64())],
                    names=["lang", "word", "c"],
                )
            seen.clear()
            total.clear()

        for batch in batches:
            for lang, group in _by_lang(batch):
                words = tokens_of(group)
                seen.setdefault(lang, Counter()).update(words)
                total[lang] += len(words)
                if sum(map(len, seen.values())) >= limit:
                    yield from flush()
        yield from flush()

    made = texts.mapInArrow(rows, "lang string, word string, c long")
    return made.groupBy("lang", "word").agg(F.sum("c").alias("c")).filter((F.col("c") >= least) | F.col("word").isNull())


def numbered(words: DataFrame) -> DataFrame:
    """(id, lang, word, c): ids from 1 without gaps, by hash bucket and then by word, so
    that no task orders all words; only the sizes of the buckets are scanned as one."""
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(ID_BUCKETS))
    placed = words.withColumn("b", bucket)
    sizes = placed.groupBy("b").agg(F.count(F.lit(1)).alias("m"))  # ID_BUCKETS rows at most
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("b").orderBy("lang", "word")
    return placed.withColumn("r", F.row_number().over(inside)).join(base, "b").select((F.col("base") + F.col("r")).alias("id"), "lang", "word", "c")


class KeyPacker:
    """Rows of k word ids as rows of unsigned 64-bit lanes, and back."""

    def __init__(self, vocabulary: int):
        self.bits = max(1, int(vocabulary).bit_length())
        self.per_lane = 64 // self.bits

    def widths(self, k: int) -> list[int]:
        """Bits of each lane."""
        return [self.bits * min(self.per_lane, k - at) for at in range(0, k, self.per_lane)]

    def pack(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(self.widths(len(columns)))), np.uint64)
        for j, ids in enumerate(columns):
            lane = j // self.per_lane
            out[:, lane] = (out[:, lane] << np.uint64(self.bits)) | ids.astype(np.uint64)
        return out

    def unpack(self, keys: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(keys), k), np.int64)
        for lane in range(keys.shape[1]):
            here = list(range(lane * self.per_lane, min(k, (lane + 1) * self.per_lane)))
            for back, j in enumerate(reversed(here)):
                out[:, j] = (keys[:, lane] >> np.uint64(back * self.bits)) & np.uint64((1 << self.bits) - 1)
        return out


def _phrases(ids: np.ndarray, shortest: int, longest: int, packer: KeyPacker, pairs: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(k, permuted keys) of the runs of k known ids, of which all neighbours are in
    ``pairs`` (sorted packed keys) where that is given."""
    known = ids > 0
    next_to = known[:-1] & known[1:]
    if pairs is not None:
        at = np.flatnonzero(next_to)
        keys = packer.pack([ids[at], ids[at + 1]])[:, 0]
        place = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
        next_to[at] = pairs[place] == keys if len(pairs) else False
    good = next_to
    for k in range(2, longest + 1):
        n = len(ids) - k + 1
        if n <= 0:
            return
        good = good[:n] & next_to[k - 2 :]
        at = np.flatnonzero(good)
        if not len(at):
            return
        if k >= shortest:
            yield k, permuted(packer.pack([ids[at + j] for j in range(k)]), packer.widths(k))


def _filters(ids_of, shortest: int, longest: int, packer: KeyPacker, pairs, block_bits: int, room: int):
    """Counts phrases in the task; filters go out whenever ``room`` keys are held."""

    def rows(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for k, parts in sorted(held.items()):
                found = filters_of(*counted(np.concatenate(parts)), packer.widths(k), block_bits)
                for at in range(0, len(found), 1024):
                    some = found[at : at + 1024]
                    yield pa.RecordBatch.from_pydict(
                        {"k": pa.array([k] * len(some), pa.int32()), "block": pa.array([f.block for f in some], pa.int32()), "body": pa.array([f.to_bytes() for f in some], pa.binary())}
                    )
            held.clear()

        for batch in batches:
            for ids in ids_of(batch):
                for k, keys in _phrases(ids, shortest, longest, packer, pairs.value if pairs is not None else None):
                    held.setdefault(k, []).append(keys)
                    size += len(keys)
                if size >= room:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows


def _merging(least: int, packer: KeyPacker, room: int):
    """Merges the filters of one block after the other and gives its frequent phrases."""

    def rows(batches):
        now, parts, size = None, [], 0

        def closed():
            if not parts:
                return None
            k = now[0]
            keys, counts = QuotientFilter.merged(parts).items()
            often = counts >= least
            ids = packer.unpack(keys[often], k)
            return pa.RecordBatch.from_arrays(
                [pa.array([k] * len(ids), pa.int32()), pa.array(list(ids), pa.list_(pa.int64())), pa.array(counts[often], pa.int64())], names=["k", "ids", "f"]
            )

        for batch in batches:
            for k, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (k, block):
                    if parts:
                        yield closed()
                    now, parts, size = (k, block), [], 0
                parts.append(QuotientFilter.from_bytes(body))
                size += len(parts[-1].x)
                if size >= room:  # repeated keys become one before more filters are read
                    parts = [QuotientFilter.merged(parts)]
                    size = 0
        if parts:
            yield closed()

    return rows


def _joined_ids(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, text, words, ids): each text with the ids of its own known words, for
    vocabularies too large to send to every task. A text's list is no longer than itself."""
    rows = stored(texts.withColumn("rid", F.monotonically_increasing_id()), "numbered-texts")

    def distinct(batches):
        for batch in batches:
            for rid, lang, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = sorted(set(tokens_of([text.as_py().encode("utf-8")])) - {BORDER}) if text.is_valid else []
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rid] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string())], names=["rid", "lang", "word"]
                    )

    met = rows.mapInArrow(distinct, "rid long, lang string, word string")
    known = met.join(vocabulary.hint("shuffle_merge"), ["lang", "word"]).groupBy("rid").agg(F.collect_list(F.struct("word", "id")).alias("m"))
    return rows.join(known, "rid").select("lang", "text", F.col("m.word").alias("words"), F.col("m.id").alias("ids"))


def phrase_counts(texts: DataFrame, vocabulary: DataFrame, size: int, n_words: int, least: int, longest: int, sent_words: int, sent_pairs: int, room: int = 2_000_000) -> DataFrame:
    """(k, ids, f) of phrases of 2 to ``longest`` known words met ``least`` times or more.

    A block takes 1,024th of all keys, or less where a corpus has more than 2**34 words; a
    filter row then holds few keys unless ``room`` grows too.
    """
    packer = KeyPacker(size)
    block_bits = 10 + (n_words >> 34).bit_length()
    context = texts.sparkSession.sparkContext
    if size <= sent_words:
        words: dict[str, dict[bytes, int]] = {}
        for i, lang, word in vocabulary.select("id", "lang", "word").toLocalIterator():  # sent_words at most
            words.setdefault(lang, {})[word.encode("utf-8")] = i
        shared = context.broadcast(words)

        def ids_of(batch):
            for lang, group in _by_lang(batch):
                yield _ids(tokens_of(group), shared.value.get(lang, {}))

        source = texts
    else:

        def ids_of(batch):
            for text, words, ids in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                yield _ids(tokens_of([text.as_py().encode("utf-8")]), {w.encode("utf-8"): i for w, i in zip(words, ids, strict=True)})

        source = stored(_joined_ids(texts, vocabulary), "texts-with-ids")

    def counts(shortest: int, most: int, pairs) -> DataFrame:
        filters = source.mapInArrow(_filters(ids_of, shortest, most, packer, pairs, block_bits, room), "k int, block int, body binary")
        dealt = filters.repartition("k", "block").sortWithinPartitions("k", "block")
        return stored(dealt.mapInArrow(_merging(least, packer, 2 * room), "k int, ids array<long>, f long"), "phrases")

    two = counts(2, min(2, longest), None)
    if longest < 3:
        return two
    # A phrase is no more frequent than its pairs. So many of them go to the tasks; beyond
    # that all phrases are counted, with the same result.
    pairs = None
    if len(packer.widths(2)) == 1 and two.count() <= sent_pairs:
        ids = np.array([r[0] for r in two.select("ids").toLocalIterator()], np.int64).reshape(-1, 2)
        pairs = context.broadcast(np.sort(packer.pack([ids[:, 0], ids[:, 1]])[:, 0]))
    return two.unionByName(counts(3, longest, pairs))


def _ids(words: list[bytes], known: Mapping[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))


def _digits(name: str, n: int = 18):
    return F.col(name).cast(f"decimal({n},0)")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, sent_words: int = 2_000_000, sent_pairs: int = 8_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Words are what is left between spaces and tabs once A-Z is lower-cased and the text is
    split at ``.,;:!?`` and line ends; phrases lie within one piece. A phrase of 2 to
    ``longest`` words with a >= ``least`` places is scored 1000 a n / (l r), rounded down,
    at its worst cut, and left out where a longer one holds all its places. All numbers
    are exact: the products are decimals of 38 digits.

    A vocabulary of up to ``sent_words`` frequent words, and up to ``sent_pairs`` frequent
    pairs, go to the tasks; a larger vocabulary is joined to the texts, more pairs are not
    used to leave phrases out. All ways give the same rows. Null and empty texts have no words; a
    null lang is ``und``; repeated rows count each; a text of any length is one row of a
    task; ties are ordered by the phrase's bytes; other columns are ignored; an empty
    table, or one without frequent phrases, gives no row.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = stored(word_counts(texts, least), "word-counts")
    totals = words.filter("word is null").select("lang", F.col("c").alias("n"))
    vocabulary = stored(numbered(words.filter("word is not null")), "vocabulary")
    size = vocabulary.count()
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    counts = phrase_counts(texts, vocabulary, size, n_words, least, longest, sent_words, sent_pairs)
    f = counts.select("ids", "f").unionByName(vocabulary.select(F.array("id").alias("ids"), F.col("c").alias("f")))

    # The first word tells the language.
    first = vocabulary.select(F.col("id").alias("first"), "lang")
    here = counts.withColumn("first", F.col("ids")[0]).join(first, "first").join(totals, "lang").select("lang", "n", "k", "ids", F.col("f").alias("a"))
    cut = here.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumns({"left_ids": F.slice("ids", 1, F.col("cut")), "right_ids": F.slice("ids", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cut = cut.join(f.select(F.col("ids").alias("left_ids"), F.col("f").alias("l")), "left_ids").join(f.select(F.col("ids").alias("right_ids"), F.col("f").alias("r")), "right_ids")
    cut = cut.withColumns({"over": _digits("a") * _digits("n") * F.lit(1000).cast("decimal(4,0)"), "under": _digits("l") * _digits("r")})
    worst = cut.withColumn("score", F.expr("over div under")).groupBy("ids", "lang", "n", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))

    # A longer phrase that holds all places of a shorter one holds those of every phrase
    # between them, so phrases one word longer decide.
    ends = counts.filter(F.col("k") > 2).withColumn("ids", F.explode(F.array(F.slice("ids", 1, F.col("k") - 1), F.slice("ids", 2, F.col("k") - 1))))
    longer = ends.groupBy("ids").agg(F.max("f").alias("most"))
    kept = worst.join(longer, "ids", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
    flat = kept.select("ids", "lang", "n", "a", "w", F.posexplode("ids").alias("place", "id"))
    spelt = flat.join(vocabulary.select("id", "word"), "id").groupBy("ids", "lang", "n", "a", "w").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("ws"))
    named = spelt.select("lang", F.concat_ws(" ", F.col("ws.word")).alias("phrase"), "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    # Ranks from counts of score bands, so that no task orders all phrases of a language.
    band = -F.floor(F.log2(F.col("score") + 1) * 16).cast("long")
    ranked = dense_index(stored(named, "named"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], band, "rank").withColumn("rank", (F.col("rank") + 1).cast("long"))
    result = stored(ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for used in (words, vocabulary, counts):
        discard(used)
    return result
