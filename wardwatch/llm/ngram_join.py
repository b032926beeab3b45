"""Exact Jaccard join of word-shingle sets by grouped prefixes.

Two sets with Jaccard >= t share a member among the first |x| - ceil(t |x|) + 1 of each
in any common order. Members are ordered by how often they occur, rarest first, so that
shared passages stay out of the prefixes of texts that have anything else. Occurrence
is a count sketch of fixed size over all texts: a wrong count only costs time, since any
order gives all links.

1. Sketch pass, prefix pass: one row per text with size, set digest and prefix.
2. Sets with one prefix and size form one group; equal sets are one member of it.
3. Prefix tokens are posted per group; group pairs that share one, with sizes and
   positions that allow the overlap, are candidates.
4. A first round takes each group's neighbours inside its posting lists only. What it
   links is one component from then on, and the second round tests all pairs between
   different components, so a large group of near copies is never expanded into all its
   pairs, and no link between components is missed.
5. Candidate pairs expand to their groups' members; those that both prefixes allow are
   verified on the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardwatch.llm.components import components
from wardwatch.llm.shared import apart, discard, stored, text_tag
from wardwatch.llm.vocabulary import release_memory
from wardwatch.llm.words import shingle_set

ROWS = "doc_id long, n_shingles long, digest binary, prefix_digest long, prefix array<long>"
TAG = "tag struct<a:long,b:long>"
BLOCK_BITS = 16


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def occurrence_sketch(docs: DataFrame, k: int, bits: int = 21, fan_in: int = 64) -> np.ndarray:
    """How many texts hold a shingle of each of ``2**bits`` hash cells.

    Every task counts all its texts into one array and returns it in blocks; blocks are
    summed by a tree of ``fan_in``, so that no task meets more than that many arrays.
    The result is 4 bytes a cell however large the input is.
    """
    blocks = 1 << (bits - BLOCK_BITS)
    shift = np.uint64(64 - bits)

    def count(batches):
        release_memory()
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = shingle_set(text.as_py(), k)
                if len(found):
                    np.add.at(cells, (found >> shift).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        for b, part in enumerate(cells.reshape(blocks, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "task": pa.array([task], pa.int32()), "cells": pa.array([_pack(part)], pa.binary())})

    def add(key, table):
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for cells in table.column("cells"):
            total += np.frombuffer(cells.as_py(), np.uint32)
        return pa.Table.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([_pack(total)], pa.binary())})

    schema = "block int, task int, cells binary"
    made = part = stored(_texts(docs).select("text").mapInArrow(count, schema), "sketch")
    most = part.agg(F.max("task")).first()[0]
    while most:
        most //= fan_in
        part = part.withColumn("task", F.floor(F.col("task") / fan_in).cast("int"))
        part = part.groupBy("block", "task").applyInArrow(add, schema)
    total = np.zeros((blocks, 1 << BLOCK_BITS), np.uint32)
    for row in part.select("block", "cells").toLocalIterator():
        total[row["block"]] = np.frombuffer(row["cells"], np.uint32)
    discard(made)
    return total.reshape(-1)


def _pack(cells: np.ndarray) -> bytes:
    return np.minimum(cells, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()


def prefix_rows(docs: DataFrame, sketch: np.ndarray, k: int, num: int, den: int, tagged: bool = False) -> DataFrame:
    """One row per text: size and digest of its set, and its prefix in sketch order; with
    ``tagged``, the column ``tag`` of ``docs`` too."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - int(math.log2(len(sketch))))

    def rows(batches):
        release_memory()
        seen = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), k)
                n = len(found)
                if not n:
                    out.append((doc_id, 0, None, None, None))
                    continue
                length = n - -(-num * n // den) + 1
                # rarest first, then by hash: the key of equal counts is the hash order that np.unique gave
                count = seen[(found >> shift).astype(np.int64)]
                first = found[np.argsort(count, kind="stable")[:length]].view(np.int64)
                out.append((doc_id, n, xxhash.xxh3_128_digest(found.tobytes()), xxhash.xxh3_64_intdigest(first.tobytes()) - (1 << 63), first))
            ids, sizes, digests, prefixes, tokens = zip(*out, strict=True) if out else ((),) * 5
            columns = {
                "doc_id": pa.array(ids, pa.int64()),
                "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "prefix_digest": pa.array(prefixes, pa.int64()),
                "prefix": pa.array(tokens, pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(columns | {"tag": batch.column(2)} if tagged else columns)

    given, schema = (docs.select("doc_id", "text", "tag"), f"{ROWS}, {TAG}") if tagged else (_texts(docs), ROWS)
    return given.mapInArrow(rows, schema).withColumn("rid", F.monotonically_increasing_id())


def _allowed(na, nb, ja, jb, num: int, den: int):
    """Whether sizes and 0-based positions of a first shared token allow the threshold:
    overlap <= 1 + what follows in the shorter rest, and needed is t / (1 + t) of both."""
    return (den * na >= num * nb) & (den * nb >= num * na) & (
        (num + den) * (1 + F.least(na - ja - 1, nb - jb - 1)) >= num * (na + nb)
    )


def _bands(n, num: int, den: int):
    """Sizes that may link differ by one band at most."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).cast("int")


def _neighbours(posts: DataFrame, num: int, den: int, reach: int = 4) -> DataFrame:
    """Group pairs of a posting list, linear in its length: those that stand at most
    two places apart in an order that differs from token to token, and every group
    with the ``reach`` groups that have the fewest rarer tokens. Among near copies of one
    text those are the ones that differ least from it, and so link with the most."""
    key = ["token", "band"]
    pair = [F.least("gid", "o.gid").alias("a"), F.greatest("gid", "o.gid").alias("b")]
    this = F.struct("gid", "n", "pos").alias("o")
    allowed = _allowed(F.col("n"), F.col("o.n"), F.col("pos"), F.col("o.pos"), num, den) & (F.col("gid") != F.col("o.gid"))
    mixed_order = Window.partitionBy(key).orderBy(F.xxhash64("token", "gid"))
    near = posts.withColumn("_before", F.collect_list(this).over(mixed_order.rowsBetween(-2, -1))).select("gid", "n", "pos", F.explode("_before").alias("o"))
    first = Window.partitionBy(key).orderBy("pos", F.xxhash64("gid"))
    leads = posts.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= reach)
    leads = leads.groupBy(key).agg(F.collect_list(this).alias("_leads"))  # at most reach
    leads = leads.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "_leads")
    led = posts.join(leads, key).select("gid", "n", "pos", F.explode("_leads").alias("o"))
    return near.union(led).filter(allowed).select(*pair).distinct()


def _between(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of (group, component) with different components that share a token and may
    link; each pair of neighbouring size bands meets once."""
    here = stored(posts, "here")
    mixed = here.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    posts = stored(here.join(mixed, "token", "left_semi"), "mixed")
    discard(here)
    names = ["gid", "n", "pos", "comp"]
    a = posts.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("_band"), *[F.col(c).alias(f"_{c}") for c in names])
    found = posts.join(a, ["token", "band"]).filter(
        (F.col("comp") != F.col("_comp"))
        & ((F.col("_band") < F.col("band")) | (F.col("_gid") < F.col("gid")))
        & _allowed(F.col("n"), F.col("_n"), F.col("pos"), F.col("_pos"), num, den)
    )
    found = found.select(F.col("_gid").alias("a"), F.col("_comp").alias("ca"), F.col("gid").alias("b"), F.col("comp").alias("cb"))
    found = stored(found.distinct(), "between")
    discard(posts)
    return found


def _member_sets(docs: DataFrame, members: DataFrame, k: int, bloom_bits: int = 23) -> DataFrame:
    """(rid, items): the whole sets of ``members`` (rid, doc_id, digest). A fixed-size bit
    filter on doc_id keeps most other texts out before the join that is exact."""
    spark = docs.sparkSession
    cells = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bloom_bits))
    bits = np.zeros(1 << bloom_bits, bool)
    marks = members.select((F.floor(cells / 65536)).cast("int").alias("block"), (cells % 65536).cast("int").alias("cell")).distinct()
    for row in marks.groupBy("block").agg(F.collect_set("cell").alias("cells")).toLocalIterator():  # at most 65536 a row
        bits[row["block"] * 65536 + np.array(row["cells"])] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def rows(batches):
        release_memory()
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            keep = wanted[np.asarray(batch.column(2))]
            if not keep.any():
                continue
            digests, sets = [], []
            for text in batch.column(1).filter(pa.array(keep)):
                found = shingle_set(text.as_py(), k)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sets.append(found.tobytes())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "items": pa.array(sets, pa.binary())})

    made = _texts(docs).select("doc_id", "text", cells.alias("cell")).mapInArrow(rows, "digest binary, items binary")
    # members have one row per digest; repeated rows of a doc_id may make a set twice
    return stored(made.dropDuplicates(["digest"]).join(members.select("rid", "digest"), "digest").select("rid", "items"), "sets")


def _prefixes_allow(pairs: DataFrame, posts: DataFrame, keep: list[str], num: int, den: int) -> DataFrame:
    """The group pairs (a, b) whose prefixes leave the threshold open.

    Let w be the earlier of the two last prefix tokens. Shared members up to w are in both
    prefixes, and the set whose prefix ends at w has only its rest beyond, so the overlap
    is at most what the prefixes share and the larger rest. Tokens of one group are
    shared with none, so posted tokens say all about what is shared.
    """
    asked = pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()
    known = posts.join(asked, "gid", "left_semi").groupBy("gid").agg(F.first("n").alias("n"), F.collect_list("token").alias("p"))
    known = stored(known, "asked")
    side = lambda x: known.select(F.col("gid").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.greatest("n_a", "n_b")
    rest = F.ceil(F.lit(num) * most / den) - 1  # what follows the prefix
    shared = F.size(F.array_intersect("p_a", "p_b"))
    return both.filter((num + den) * (shared + rest) >= num * (F.col("n_a") + F.col("n_b"))).select(keep)


def _verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of members whose whole sets reach the threshold."""

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    sets = _member_sets(docs, members.join(asked, "rid", "left_semi"), k)
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("rid").alias("b"), F.col("items").alias("y")), "b")
    links = stored(both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "links")
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, sketch_bits: int = 21) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: component_id is the
    smallest doc_id reachable by links of Jaccard >= num / den, itself included.

    Null, empty and white-space texts have no set and link with nothing. Repeated rows
    and texts with equal sets link. A row with a null doc_id takes part like any other
    and is named by its component's smallest doc_id, null if there is none. Columns but
    doc_id and text are ignored; an empty table gives an empty result.
    """
    named = _rooted(docs, k, num, den, sketch_bits)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "n_shingles", "component_id")


def _rooted(docs: DataFrame, k: int, num: int, den: int, sketch_bits: int = 21, tagged: bool = False) -> DataFrame:
    """(rid, doc_id, n_shingles, root) per row, and ``tag`` if ``tagged``: rows of one root
    are linked, by chains too."""
    sketch = occurrence_sketch(docs, k, sketch_bits)
    rows = stored(prefix_rows(docs, sketch, k, num, den, tagged), "prefixes")
    tag = ["tag"] if tagged else []
    slim = rows.select("rid", "doc_id", "n_shingles", "digest", "prefix_digest", *tag)
    # one member per distinct set, one group per prefix and size
    sets = slim.filter("n_shingles > 0").groupBy("digest", "n_shingles", "prefix_digest").agg(F.min(F.struct("rid", "doc_id")).alias("m"))
    sets = sets.select("digest", "n_shingles", "prefix_digest", "m.rid", "m.doc_id")
    lead = sets.groupBy("prefix_digest", "n_shingles").agg(F.min("rid").alias("gid"), F.count(F.lit(1)).alias("size"))
    members = stored(sets.join(lead, ["prefix_digest", "n_shingles"]), "members")

    tokens = rows.filter("n_shingles > 0").select(F.col("rid").alias("gid"), F.col("n_shingles").alias("n"), "prefix")
    copies = tokens.select("gid").join(members.filter("rid = gid").select("gid"), "gid", "left_anti")
    copies = stored(copies, "copies")
    maybe, leads = apart(tokens, copies, "gid")
    tokens = leads.union(maybe.join(copies, "gid", "left_anti"))
    tokens = tokens.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    of_token = Window.partitionBy("token")  # a token of one group posts nothing
    posts = tokens.withColumn("_lo", F.min("gid").over(of_token)).withColumn("_hi", F.max("gid").over(of_token)).filter("_lo < _hi")
    posts = stored(posts.select("token", "gid", "n", F.col("pos").cast("long").alias("pos"), _bands(F.col("n"), num, den).alias("band")), "posts")
    slim = stored(slim, "rows")
    discard(rows)
    discard(copies)

    # first round: a few partners in each posting list, and in a group each to the one before it
    several = members.filter("size > 1").select("gid", "rid")
    chain = several.select(F.lag("rid").over(Window.partitionBy("gid").orderBy("rid")).alias("a"), F.col("rid").alias("b")).filter("a is not null")
    near = _prefixes_allow(stored(_neighbours(posts, num, den), "near"), posts, ["a", "b"], num, den)
    first = _verified(docs, stored(near.union(chain), "pairs"), members, k, num, den)
    found = components(first, "a", "b")

    # second round: all pairs between the components that remain
    placed = members.select("rid", "gid", "size").join(found, F.col("rid") == F.col("node"), "left")
    placed = stored(placed.select("rid", "gid", "size", F.coalesce("root", "rid").alias("comp")), "placed")
    parts = placed.select("gid", "comp").distinct()
    between = _between(posts.join(parts, "gid"), num, den)
    pairs = _prefixes_allow(between, posts, ["a", "b", "ca", "cb"], num, den)
    of = placed.select("gid", "comp", "rid")
    pairs = pairs.join(of.select(F.col("gid").alias("a"), F.col("comp").alias("ca"), F.col("rid").alias("ra")), ["a", "ca"])
    pairs = pairs.join(of.select(F.col("gid").alias("b"), F.col("comp").alias("cb"), F.col("rid").alias("rb")), ["b", "cb"])
    pairs = pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    one = placed.filter("size > 1")
    other = one.select("gid", F.col("rid").alias("b"), F.col("comp").alias("_comp"))
    inside = one.join(other, "gid").filter((F.col("rid") < F.col("b")) & (F.col("comp") != F.col("_comp"))).select(F.col("rid").alias("a"), "b")
    second = _verified(docs, stored(pairs.union(inside), "pairs"), members, k, num, den)

    roots = components(first.union(second), "a", "b")
    named = slim.join(members.select("digest", F.col("rid").alias("node")), "digest", "left").join(roots, "node", "left")
    named = stored(named.select("rid", "doc_id", "n_shingles", F.coalesce("root", "node", "rid").alias("root"), *tag), "named")
    for used in (members, posts, slim, placed, between, first, second):
        discard(used)
    return named


def near_duplicates_removed(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id
    (null ones last), of those the one with the smallest text hash, one if it is repeated.

    Rows are told apart by doc_id and text, so a repeated or null doc_id neither keeps a
    copy nor takes a different text with it. Texts without a set (null, empty, white
    space) link with nothing and all stay. Extra columns may have any name; of repeated
    rows that differ in them alone, any one stays. An empty table gives no row."""
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag().alias("tag"))
    judged = _rooted(tagged, k, num, den, tagged=True).filter("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    rows = stored(judged.groupBy("root", key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "judged")
    discard(judged)
    first = rows.groupBy("root").agg(F.min("key").alias("least"))
    marked = rows.join(first, "root").select("key", "n", (F.col("key") == F.col("least")).alias("stays"))
    marked = stored(marked.filter("not stays or n > 1"), "dropped")
    discard(rows)
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select(row, F.struct(F.col("doc_id").cast("long").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("tag")).alias("key"))
    maybe, others = apart(keyed, marked, "key")
    once = maybe.join(marked.filter("stays").select("key"), "key", "left_semi").dropDuplicates(["key"])
    kept = others.select("row").union(maybe.join(marked.select("key"), "key", "left_anti").select("row")).union(once.select("row"))
    return kept.select("row.*")
