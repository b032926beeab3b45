"""Hard negatives by score windows, found in STR-packed R-trees.

Vectors are dealt by range of (length, label, first component) to tasks, each of which
tiles its share by sort-tile-recursive packing: sorted by its widest component, cut into
slabs, each slab sorted by the next, down to pages of neighbours. The minimum bounding
boxes of pages, and of runs of boxes, make a tree whose boxes give an interval for the
inner product with a query, component by component. A best-first queue opens boxes by
their upper end, and leaves out those outside every score window still open or strictly
below the last score that a full window holds.

Trees lie in files of the shared folder. Anchors, dealt in chunks, are the only rows that
move; a task reads tree after tree and carries its best scores along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardwatch.llm.shared import discard, open_file, remove_folder, shared_folder, stored, task_file

PAGE, FANOUT = 128, 8
LAST = (1 << 63) - 1
TREE = pa.schema([("vec_id", pa.int64()), ("rid", pa.int64()), ("x", pa.binary())])
BOXES = pa.schema([("label", pa.int64()), ("d", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
FOUND = "rid long, slot int, vec_id long, other long, score long"


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 x): whole numbers, kept as doubles, which hold them exactly."""
    return np.floor(256.0 * x)


def _slab(n: int, dims: int, page: int) -> int:
    """Rows in a slab when ``n`` rows are cut by the first of ``dims`` components."""
    pages = -(-n // page)
    return -(-pages // max(2, int(np.ceil(pages ** (1.0 / dims))))) * page


def str_order(x: np.ndarray, page: int = PAGE) -> np.ndarray:
    """The order of the rows by sort-tile-recursive packing, widest components first."""
    dims = np.argsort(-x.var(axis=0), kind="stable") if len(x) else np.zeros(0, int)
    order: list[np.ndarray] = []
    stack = [(np.arange(len(x)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= page or depth == len(dims):
            order.append(rows)
            continue
        rows = rows[np.argsort(x[rows, dims[depth]], kind="stable")]
        size = _slab(len(rows), len(dims) - depth, page)
        stack += [(rows[a : a + size], depth + 1) for a in reversed(range(0, len(rows), size))]
    return np.concatenate(order)


def page_starts(n: int, dims: int, page: int = PAGE) -> list[int]:
    """Where the pages of ``n`` rows in that order start; it depends on their number alone."""
    starts: list[int] = []
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= page or depth == dims:
            starts += range(a, b, page)
            continue
        size = _slab(b - a, dims - depth, page)
        stack += [(at, min(at + size, b), depth + 1) for at in reversed(range(a, b, size))]
    return starts


def exact(x: np.ndarray, most: float) -> np.ndarray:
    """``x`` in a type in which sums of its products with numbers up to ``most`` are exact."""
    top = float(np.abs(x).max(initial=0.0)) * most * max(1, x.shape[-1])
    return x if top < 2.0**53 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class BoxTree:
    """Pages of vectors under levels of bounding boxes; level 0 holds the pages."""

    def __init__(self, x: np.ndarray, starts: Sequence[int], vec_id: np.ndarray, rid: np.ndarray):
        self.x, self.vec_id, self.rid = x, vec_id, rid
        self.spans = [list(zip(starts, [*starts[1:], len(x)], strict=True))]
        self.low = [np.minimum.reduceat(x, starts, axis=0)]
        self.high = [np.maximum.reduceat(x, starts, axis=0)]
        self.first = [np.minimum.reduceat(vec_id, starts)]
        while len(self.spans[-1]) > 1:
            cuts = list(range(0, len(self.spans[-1]), FANOUT))
            self.spans.append(list(zip(cuts, [*cuts[1:], len(self.spans[-1])], strict=True)))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts, axis=0))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts, axis=0))
            self.first.append(np.minimum.reduceat(self.first[-1], cuts))


@dataclass
class ScoreWindow:
    """The first ``k`` rows with low <= score <= high, by (score descending, vec_id)."""

    low: float
    high: float
    k: int
    best: list[tuple] = field(default_factory=list)

    def floor(self) -> float:
        """The least score that can still enter."""
        return max(self.low, -self.best[-1][0]) if len(self.best) == self.k else self.low

    def open(self, low, high, first):
        """Which boxes, by interval and smallest vec_id, may hold a row that enters."""
        least = self.floor()
        may = (low <= self.high) & (high >= least)
        if len(self.best) == self.k:
            # a box that can only equal the last score needs a smaller vec_id
            may &= (np.minimum(high, self.high) > least) | (first <= self.best[-1][1])
        return may

    def add(self, score, vec_id, rid) -> None:
        at = np.flatnonzero((score <= self.high) & (score >= self.floor()))
        if len(at) > self.k:
            at = at[np.lexsort((vec_id[at], -score[at]))[: self.k]] if score.dtype != object else sorted(at, key=lambda i: (-score[i], vec_id[i]))[: self.k]
        if len(at):
            self.best = sorted([*self.best, *((-score[i], int(vec_id[i]), int(rid[i])) for i in at)])[: self.k]


def search(tree: BoxTree, q: np.ndarray, windows: list[ScoreWindow], skip: int = -1) -> int:
    """Best-first search of one tree for one query; the row ``skip`` is left out. Returns
    the number of pages read."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)

    def bounds(level: int, a: int, b: int):
        low, high = tree.low[level][a:b], tree.high[level][a:b]
        return low @ up + high @ down, high @ up + low @ down, tree.first[level][a:b]

    def wanted(low, high, first):
        may = windows[0].open(low, high, first)
        for w in windows[1:]:
            may = may | w.open(low, high, first)
        return may

    top = len(tree.spans) - 1
    queue: list[tuple] = []

    def push(level: int, a: int, b: int):
        low, high, first = bounds(level, a, b)
        for i in np.flatnonzero(wanted(low, high, first)).tolist():
            heapq.heappush(queue, (-high[i], level, a + i, low[i], first[i]))

    push(top, 0, len(tree.spans[top]))
    read = 0
    while queue:
        high, level, node, low, first = heapq.heappop(queue)
        if not any(w.open(low, -high, first) for w in windows):
            continue
        a, b = tree.spans[level][node]
        if level:
            push(level - 1, a, b)
            continue
        read += 1
        score, vec_id, rid = tree.x[a:b] @ q, tree.vec_id[a:b], tree.rid[a:b]
        if skip >= 0 and (rid == skip).any():
            score, vec_id, rid = score[rid != skip], vec_id[rid != skip], rid[rid != skip]
        if len(score) and score.max() >= min(w.floor() for w in windows):
            for w in windows:
                w.add(score, vec_id, rid)
    return read


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, d, first, x) of the rows that take part, labels shifted where
    vec_id is divisible by 7; x holds floor(256 component) as doubles."""

    def rows(batches):
        for batch in batches:
            keep, out, d, first = [], [], [], []
            for i, v in enumerate(batch.column(3).to_pylist()):
                if v is None or any(c is None for c in v):
                    continue
                x = scaled(np.asarray(v, np.float64))
                if np.isfinite(x).all():
                    keep.append(i)
                    out.append(x.tobytes())
                    d.append(len(x))
                    first.append(float(x[0]) if len(x) else 0.0)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).take(at) for j in range(3)), pa.array(d, pa.int32()), pa.array(first, pa.float64()), pa.array(out, pa.binary())], names=["rid", "vec_id", "label", "d", "first", "x"]
            )

    label = F.col("label").cast("long")
    given = vectors.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return given.filter("label is not null").mapInArrow(rows, "rid long, vec_id long, label long, d int, first double, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), d)


def write_trees(usable: DataFrame, folder: str, tasks: int) -> list[str]:
    """Names of the tree files, one per task that had rows; a file has one tree per
    (label, length), and a list of their outer boxes beside it."""

    def write(batches):
        name = f"tree-{TaskContext.get().partitionId():06d}"
        held = [b for b in batches if b.num_rows]  # one range of rows, see hard_negatives
        if not held:
            return
        table = pa.Table.from_batches(held)
        with task_file(folder, f"{name}.arrow") as body, task_file(folder, f"{name}.boxes.arrow") as boxes:
            trees, outer = ipc.new_file(body, TREE), ipc.new_file(boxes, BOXES)
            label, d = np.asarray(table["label"]), np.asarray(table["d"])
            for one, size in sorted(set(zip(label.tolist(), d.tolist(), strict=True))):
                part = table.filter(pa.array((label == one) & (d == size))).combine_chunks().sort_by([("vec_id", "ascending"), ("rid", "ascending")])
                x = _matrix(part["x"].combine_chunks(), size)
                trees.write_batch(part.select(["vec_id", "rid", "x"]).take(pa.array(str_order(x))).combine_chunks().to_batches()[0].cast(TREE))
                outer.write_batch(pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([size], pa.int32()), pa.array([x.min(axis=0).tobytes()]), pa.array([x.max(axis=0).tobytes()])], schema=BOXES))
            trees.close()
            outer.close()
        yield pa.RecordBatch.from_pydict({"name": [name]})

    dealt = usable.repartitionByRange(tasks, "d", "label", "first", F.xxhash64("rid"))
    return sorted(r[0] for r in stored(dealt.mapInArrow(write, "name string"), "tree-names").collect())  # one row per file


class TreeFile:
    """The trees of one file, each read when a query first reaches it."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.file = folder, name, None
        listing = ipc.open_file(open_file(folder, f"{name}.boxes.arrow"))
        self.outer = []
        for i in range(listing.num_record_batches):
            label, d, low, high = (c[0].as_py() for c in listing.get_batch(i).columns)
            self.outer.append((label, d, np.frombuffer(low), np.frombuffer(high)))

    def tree(self, i: int, most: float) -> BoxTree:
        if self.file is None:
            self.file = ipc.open_file(open_file(self.folder, f"{self.name}.arrow"))
        batch = self.file.get_batch(i)
        x = _matrix(batch.column("x"), self.outer[i][1])
        vec_id = np.asarray(batch.column("vec_id").fill_null(LAST))
        return BoxTree(exact(x, most), page_starts(*x.shape), vec_id, np.asarray(batch.column("rid")))


def _chunks(batches, tasks: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one (chunk, group) after the other; partitions are sorted by ``slice``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.asarray(batch.column("slice"))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if now is not None and key[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _searching(folder: str, names: list[str], groups: int, same: bool, k: int):
    """Searches the trees of a group of files for a chunk of anchors."""

    def rows(batches):
        for key, table in _chunks(batches, groups):
            rid, label, d = (table[c].to_pylist() for c in ("rid", "label", "d"))
            queries = [np.frombuffer(b) for b in table["x"].to_pylist()]
            most = max(float(np.abs(q).max(initial=0.0)) for q in queries)
            whole = [np.array([int(v) for v in q], object) for q in queries]
            if same:
                windows = [[ScoreWindow(-np.inf, np.inf, k)] for _ in rid]
            else:
                windows = [[ScoreWindow(-(-p // 2), 95 * p // 100, k) for p in w] for w in table["scores"].to_pylist()]
            for name in names[key % groups :: groups]:
                file = TreeFile(folder, name)
                for i, (of, size, low, high) in enumerate(file.outer):
                    reach = [j for j in range(len(rid)) if d[j] == size and (of == label[j]) == same]
                    if not reach:
                        continue
                    tree = file.tree(i, most)
                    exactly = tree.x.dtype == object
                    for j in reach:
                        search(tree, whole[j] if exactly else queries[j], windows[j], rid[j] if same else -1)
            out = [(rid[j], s, v, r, int(-score)) for j in range(len(rid)) for s, w in enumerate(windows[j]) for score, v, r in w.best]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            columns[2] = [None if v == LAST else v for v in columns[2]]
            columns[4] = [max(-LAST - 1, min(LAST, v)) for v in columns[4]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 1 else pa.int64()) for n, c in enumerate(columns)], names=["rid", "slot", "vec_id", "other", "score"])

    return rows


def _best(anchors: DataFrame, folder: str, names: list[str], chunks: int, groups: int, same: bool, k: int) -> DataFrame:
    """(rid, slot, rank, vec_id, other, score): the first ``k`` rows of each window over all
    groups of trees; a group gives at most ``k`` for each."""
    piece = F.pmod(F.xxhash64("rid"), F.lit(chunks))
    spread = anchors.withColumn("slice", F.explode(F.sequence(piece * groups, piece * groups + (groups - 1))))
    dealt = spread.repartitionByRange(chunks * groups, "slice").sortWithinPartitions("slice")
    found = dealt.mapInArrow(_searching(folder, names, groups, same, k), FOUND)
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("other"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, file_bytes: int = 16 << 20, chunk: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``. Scores are inner products
    of floor(256 component), exact; rows of different length are not compared. An anchor's
    positives are its first ``positives`` other rows of its label; for each of them the
    first ``negatives`` rows of other labels with half to 95 hundredths of its score.

    Rows with a null label, a null vector or null or non-finite components (also after
    scaling) take no part. A null vec_id is no anchor, keeps its label and comes last among
    equal scores; an empty vector scores 0; repeated rows are rows of their own, also as
    anchors; scores beyond 64 bits are compared exactly and given as the nearest long;
    other columns are ignored; without anchors, or in an empty table, there is no row.
    """
    spark = vectors.sparkSession
    usable = stored(usable_rows(vectors), "vectors")
    n, d = usable.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(1))).first()
    rows_a_file = max(1024, min(16384, file_bytes // (8 * max(1, d))))
    folder = shared_folder(spark, "trees")
    names = write_trees(usable, folder, max(1, -(-n // rows_a_file)))
    anchors = usable.filter(F.col("vec_id") % every == 0).select("rid", F.col("vec_id").alias("anchor_id"), "label", "d", "x")
    chunks = max(1, -(-anchors.count() // chunk))
    # Few chunks are searched by several tasks each, over different trees.
    groups = max(1, min(len(names), -(-2 * spark.sparkContext.defaultParallelism // chunks)))
    near = _best(anchors.drop("anchor_id"), folder, names, chunks, groups, True, positives)
    near = stored(near.select("rid", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s")).select("rid", F.col("s.positive_score").alias("scores"))
    windows = anchors.drop("anchor_id").join(scores, "rid")
    far = _best(windows, folder, names, chunks, groups, False, negatives)
    far = far.select("rid", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    mined = near.join(far, ["rid", "slot"]).join(anchors.select("rid", "anchor_id"), "rid")
    result = stored(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for used in (usable, near):
        discard(used)
    remove_folder(folder)
    return result
