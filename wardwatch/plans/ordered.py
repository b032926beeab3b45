"""Ordered scans that stay parallel inside one key.

A window partitioned by record alone puts a hot record into a single task. Here
the rows of a key are cut into chunks of fixed position length, and

* ``with_halo`` copies the few rows next to a cut into the neighbouring chunk,
  enough for every computation with bounded look-back or look-ahead;
* ``carried`` computes unbounded scans (running sums, last known value)
  in two levels: one small row per chunk is scanned per key, and its result is
  joined to the chunk, whose rows are then scanned locally.

Both need one shuffle of the rows, by (keys, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.plans.materialise import written

CHUNK = "_chunk"
CORE = "_core"
DEFAULT_CHUNK = 1 << 17
LONG_KEY = 100_000  # rows of one key that a task still sorts at once
LONG_SAMPLED = 200  # of which a sample has about so many


def chunk_of(pos: str | Column, length: int) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(length)).cast("long")


def with_halo(
    df: DataFrame,
    pos: str,
    length: int = DEFAULT_CHUNK,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add ``_chunk`` and ``_core``; rows within ``before``/``after`` positions of a
    cut also appear, with ``_core`` false, in the chunk that looks at them."""
    home = chunk_of(pos, length)
    first = F.greatest(F.lit(0).cast("long"), chunk_of(F.col(pos) - after, length))
    last = chunk_of(F.col(pos) + before, length)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(CORE, F.col(CHUNK) == home)


def chunk_window(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(CHUNK, CORE)


def carried(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    length: int = DEFAULT_CHUNK,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    chunk: Column | None = None,
    keep_chunk: bool = False,
    tiebreak: Sequence[str] = (),
    with_before: bool = False,
) -> DataFrame:
    """Whole-key scans in ``pos`` order, inclusive of the current row.

    ``sums``: running sum; ``last``: most recent non-NULL value. ``chunk`` overrides the cut (any
    expression monotone in ``pos``; a ``_chunk`` column already there is kept as it is,
    and with it the layout of the rows). ``with_before`` also adds, for every ``last``
    column, ``<name>_before``: its value on the row before.
    """
    sums, last = dict(sums or {}), dict(last or {})
    values = {f"_v_{name}": expr for name, expr in {**sums, **last}.items()}
    laid_out = CHUNK in df.columns and chunk is not None
    rows = df.withColumns(values if laid_out else {CHUNK: chunk if chunk is not None else chunk_of(pos, length), **values})
    order = [F.col(pos), *[F.col(c) for c in tiebreak]]
    rank = F.struct(*order) if tiebreak else F.col(pos)

    def known(name: str) -> Column:
        return F.when(F.col(f"_v_{name}").isNotNull(), rank)

    partials = [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums]
    partials += [F.max_by(f"_v_{n}", known(n)).alias(f"_c_{n}") for n in last]
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, CHUNK)
        .agg(*partials)
        .select(
            *keys,
            CHUNK,
            *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
            *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
        )
    )
    inside = chunk_window(keys, *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, [*keys, CHUNK], "inner")
    scanned = [(F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0))).alias(n) for n in sums]
    scanned += [
        F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(upto), F.col(f"_c_{n}")).alias(n) for n in last
    ]
    if with_before:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        scanned += [
            F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(earlier), F.col(f"_c_{n}")).alias(f"{n}_before")
            for n in last
        ]
    fresh = {*sums, *last}
    kept = [c for c in df.columns if c not in fresh and c != CHUNK]
    out = joined.select(*kept, *([CHUNK] if keep_chunk else []), *scanned)
    return out


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "idx"
) -> DataFrame:
    """Zero-based position of a row in its key. ``bucket`` is monotone in ``order``
    and splits a key into parts that each fit one task."""
    rows = df.withColumn(CHUNK, bucket)
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_base"))
    )
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (
        rows.join(base, [*keys, CHUNK], "inner")
        .withColumn(name, F.col("_base") + F.row_number().over(here) - 1)
        .select(*df.columns, name)
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    fields: Sequence[str],
    name: str = "prev",
) -> DataFrame:
    """Struct ``name`` of ``fields`` of the row before this one in its key, across
    buckets (``bucket`` as in ``dense_index``); NULL on the first row."""
    rows = df.withColumn(CHUNK, bucket).withColumn("_self", F.struct(*fields))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    tails = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max_by("_self", F.struct(*order)).alias("_tail"))
        .select(*keys, CHUNK, F.lag("_tail").over(by_chunk).alias("_tail"))
    )
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (
        rows.join(tails, [*keys, CHUNK], "inner")
        .withColumn(name, F.coalesce(F.lag("_self").over(here), F.col("_tail")))
        .select(*df.columns, name)
    )


def ranged(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_chunk``, the number of a range of ``order``: Spark samples the range
    bounds, so ranges hold about as many rows each, wherever keys or times are crowded. Written
    once, as a second sample could give other bounds. Ties share a range."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return written(dealt.withColumn(CHUNK, F.spark_partition_id()))


def previous_in_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    name: str = "prev",
    parts: int | None = None,
    place: str | None = None,
) -> DataFrame:
    """Struct ``name`` of ``fields`` of the row before this one in its key, as
    ``previous_row`` gives it, without a bucket to choose: rows are cut into sampled ranges
    of (keys, order), and only the first row of a range looks at the range before it.

    NULL on the first row of a key; NULL keys are a key of their own; of rows with equal
    keys and order any one is the earlier. ``place`` adds a number that rises with the order
    of a key's rows; rows of equal order share it.
    """
    ordered = [*keys, *order]
    rows = ranged(df, ordered, parts)
    last = F.max_by(F.struct(F.struct(*keys).alias("key"), F.struct(*fields).alias("self")), F.struct(*ordered))
    ends = rows.groupBy(CHUNK).agg(last.alias("_end"))  # a row for each range
    ends = ends.select(CHUNK, F.lag("_end").over(Window.orderBy(CHUNK)).alias("_end"))
    # by number, not by hash, which would bring several ranges together in one task
    dealt = rows.repartitionById(max(1, rows.rdd.getNumPartitions()), F.col(CHUNK))
    here = Window.partitionBy(CHUNK).orderBy(*ordered)
    names = {c: f"_before_{c}" for c in dict.fromkeys([*keys, *fields, CHUNK])}
    placed = [(F.shiftleft(F.col(CHUNK).cast("long"), 40) + F.rank().over(here)).alias(place)] if place else []
    seen = dealt.select("*", *[F.lag(c).over(here).alias(n) for c, n in names.items()], *placed).join(F.broadcast(ends), CHUNK)
    first = F.col(names[CHUNK]).isNull()

    def before(kind: str, columns: Sequence[str]) -> Column:
        return F.when(first, F.col(f"_end.{kind}")).otherwise(F.struct(*[F.col(names[c]).alias(c) for c in columns]))

    same = before("key", keys).eqNullSafe(F.struct(*keys))
    return seen.select(*df.columns, F.when(same, before("self", fields)).alias(name), *([place] if place else []))


def previous_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    name: str = "prev",
    place: str | None = None,
    long: int = LONG_KEY,
) -> DataFrame:
    """As ``previous_in_ranges``, with one shuffle, by key, of the rows of keys that a task
    can sort. A sample tells the keys of more than about ``long`` rows; only theirs are
    cut into ranges. ``df`` is read more than once, so it should be a written table."""
    share = min(1.0, LONG_SAMPLED / long)
    sizes = df.select(*keys).sample(share, seed=0).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.filter(F.col("_n") > long * share / 2).select(*keys).collect()
    here = Window.partitionBy(*keys).orderBy(*order)
    placed = [F.rank().over(here).cast("long").alias(place)] if place else []

    def short(rows: DataFrame) -> DataFrame:
        return rows.select(*df.columns, F.lag(F.struct(*fields)).over(here).alias(name), *placed)

    if not found:
        return short(df)
    known = df.sparkSession.createDataFrame(found, df.select(*keys).schema).withColumnsRenamed({k: f"_long_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_long_{k}"))
    apart = previous_in_ranges(df.join(F.broadcast(known), same, "left_semi"), keys, order, fields, name, place=place)
    return short(df.join(F.broadcast(known), same, "left_anti")).unionByName(apart)
