"""Best-fit packing of token pieces with certified bin counts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.shared import stored
from wardwatch.llm.vocabulary import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, cache: int = 180_000) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its ids being those of the
    vocabulary and ``end_id``. Only longer documents are cut; the first piece takes what
    whole pieces leave. A null or empty text is one piece, the end id."""

    def cut(batches):
        enc = encoder(vocabulary, cache)
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py()), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for name, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int32() if n == "piece" else pa.int64()) for n, v in out.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual-feasible functions: no packing of
    ``lengths`` has fewer bins.

    Threshold functions count items above capacity - e whole and those below e not at
    all; rounding functions u_k map x to floor((k + 1) x / capacity) / k, but leave x
    where (k + 1) x / capacity is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    total = count * x
    best = -(-int(total.sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]  # items of at least x
    size_below = np.cumsum(total)  # tokens in items of at most x
    for e in range(1, capacity // 2 + 1):
        whole = int(above[capacity - e + 1])
        middle = int(size_below[capacity - e] - size_below[e - 1])
        best = max(best, whole - (-middle // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity), so that the sum is exact
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin of each item, longest first, each into the bin
    whose room it fits best."""
    bins = np.empty(len(lengths), np.int64)
    place = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    mask, n_bins = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, number, n_bins = capacity, n_bins, n_bins + 1
        bins[item], place[item] = number, capacity - room
        left = room - size
        if left:
            if not open_bins[left]:
                mask |= 1 << left
            open_bins[left].append(number)
    return bins, place


def pack(items: DataFrame, capacity: int, per_partition: int, rounds: int) -> DataFrame:
    """(item, sequence_id, offset, fill, part_bins, part_bound) for ``items`` (item, length).

    Items are dealt by hash into partitions of about ``per_partition`` and packed best
    fit decreasing; a partition is certified if its bins equal its lower bound. In each
    further round, the bins with room of partitions that have a gap, and the emptiest bin
    of every certified one, give their items to a common pool, which is dealt anew and
    packed again; the new packing is taken if it needs fewer bins. A sequence is named by
    the item that opens it.
    """
    schema = "item long, length long, sequence_id long, offset long, fill long, part long, part_bins long, part_bound long"

    def fill_bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, place = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        opener = np.empty(n, np.int64)
        first = place == 0
        opener[bins[first]] = pdf["item"].to_numpy()[first]
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        return pdf.assign(sequence_id=opener[bins], offset=place, fill=fill[bins], part_bins=n, part_bound=lower_bound(lengths, capacity))

    def packed(pool: DataFrame, n_items: int, turn: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-n_items // per_partition))
        dealt = pool.select("item", "length", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)).alias("part"))
        return stored(dealt.groupBy("part").applyInPandas(fill_bins, schema), "packed"), parts

    settled = None
    current, parts = packed(items, items.count(), 0)
    for turn in range(1, rounds + 1):
        if parts == 1:
            break
        emptiest = current.groupBy("part").agg(F.min(F.struct("fill", "sequence_id"))["sequence_id"].alias("least"))
        marked = current.join(emptiest, "part").withColumn(
            "_pool", (F.col("fill") < capacity) & ((F.col("part_bins") > F.col("part_bound")) | (F.col("sequence_id") == F.col("least")))
        )
        pool, rest = marked.filter("_pool"), marked.filter(~F.col("_pool")).select(current.columns)
        n_items, old = pool.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        if not n_items:
            break
        again, parts = packed(pool.select("item", "length"), n_items, turn)
        new = again.filter("offset = 0").count()
        if new >= old:
            break
        settled = rest if settled is None else settled.unionByName(rest)
        current = again
    return current if settled is None else settled.unionByName(current)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, per_partition: int = 50_000, rounds: int = 3, cache: int = 180_000
) -> DataFrame:
    """Every piece of every document with its sequence and offset, and the certificate of
    the partition it was packed in: ``part_bins`` sequences, ``part_bound`` of which any
    packing of that partition needs.

    Whole pieces are sequences of their own, one bin with a bound of one. A task remembers the ids of up to twice
    ``cache`` words. Repeated rows are packed each for
    themselves; null ids are kept; an empty table gives no sequence.
    """
    pieces = stored(
        token_pieces(docs, vocabulary, end_id, capacity, cache).withColumn("item", F.monotonically_increasing_id()), "pieces"
    )
    whole = pieces.filter(F.col("length") == capacity).select(
        "item", F.col("item").alias("sequence_id"), *[F.lit(n).cast("long").alias(c) for n, c in ((0, "offset"), (1, "part_bins"), (1, "part_bound"))]
    )
    part = pieces.filter(F.col("length") < capacity).select("item", "length")
    placed = pack(part, capacity, per_partition, rounds).select("item", "sequence_id", "offset", "part_bins", "part_bound")
    return pieces.join(whole.unionByName(placed), "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound"
    )
