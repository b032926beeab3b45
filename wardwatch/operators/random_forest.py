"""Random forest classifier whose trees are grown by tasks and never meet in one process.

The parameters are those of Spark's own forest (a Poisson draw of the rows per tree, the
square root of the features tried per node, bins at quantiles, Gini impurity, leaves of one
mind merged), but Spark holds every node of every tree in the driver. Here rows become
blocks of bin numbers in the shared folder, each task reads the rows its tree drew, grows
it level by level and writes it there, and rows to predict meet the trees one at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.plans.materialise import open_file, parquet_files, remove_folder, shared_folder, written

BINS = 32
SAMPLED = 10_000  # rows whose values give the bounds of bins, as in Spark
CELLS = 1 << 20  # of the counts by node, feature, bin and class that are held at a time
DRAWS = 1 << 16  # rows counted at a time
NO_GAIN = 1e-14  # what rounding makes of none


def bin_bounds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between values: all of them, or where an even share of the weight ends."""
    known, at = np.unique(values, return_inverse=True)
    middle = (known[:-1] + known[1:]) / 2
    if len(middle) < bins:
        return middle
    reached = np.cumsum(np.bincount(at, weights))
    stride = reached[-1] / bins
    out, target = [], stride
    for i in range(1, len(known)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[: bins - 1])


def binned(x: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Number of bounds below each value: a bin ends with its bound."""
    return np.column_stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)]).astype(np.uint8)


def best_splits(bins: np.ndarray, y: np.ndarray, n: np.ndarray, node: np.ndarray, tried: np.ndarray, weight: np.ndarray):
    """(gain, feature, last bin to the left) of the best split of each node; rows come in
    order of ``node``. ``n`` counts a row's draws, ``weight`` is that of its class."""
    nodes, m = tried.shape
    k = len(weight)
    gain, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, dtype=np.int32), np.zeros(nodes, dtype=np.int32)
    step = max(1, CELLS // (m * BINS * k))
    for lo in range(0, nodes, step):
        hi = min(nodes, lo + step)
        first, end = np.searchsorted(node, [lo, hi])
        cells = (hi - lo) * m * BINS
        counts = np.zeros(k * cells)  # by class first, which sums fastest
        for a in range(first, end, DRAWS):
            rows = slice(a, min(a + DRAWS, end))
            at = node[rows] - lo
            bin_of = np.take_along_axis(bins[rows], tried[node[rows]], axis=1)
            cell = (at[:, None] * m + np.arange(m)) * BINS + bin_of + y[rows][:, None] * cells
            counts += np.bincount(cell.ravel(), np.repeat(n[rows], m), len(counts))
        left = counts.reshape(k, hi - lo, m, BINS).cumsum(axis=3)
        whole, left = left[..., -1:], left[..., :-1]
        share = np.zeros(left.shape[1:])
        some = np.ones(share.shape, dtype=bool)
        for side in (left, whole - left):  # whole numbers, so exact
            size, squares = np.zeros(share.shape), np.zeros(share.shape)
            for own, w in zip(side, weight):
                weighted = own * w
                size += weighted
                squares += weighted * weighted
            some &= size > 0
            share += np.divide(squares, size, out=squares, where=size > 0)
        all_ = whole[:, :, 0, 0].T * weight
        total = all_.sum(axis=1)
        gains = share / total[:, None, None] - ((all_ / total[:, None]) ** 2).sum(axis=1)[:, None, None]
        gains[~some] = -np.inf
        flat = gains.reshape(hi - lo, -1)
        best = flat.argmax(axis=1)
        gain[lo:hi] = flat[np.arange(hi - lo), best]
        feature[lo:hi] = tried[np.arange(lo, hi), best // (BINS - 1)]
        cut[lo:hi] = best % (BINS - 1)
    return gain, feature, cut


def grown_tree(bins: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, depth: int, tries: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Nodes in order of levels: ``feature`` (-1 in leaves), ``cut``, the last bin to the
    left, ``left`` (the right child follows it) and ``counts`` of drawn rows by class."""
    k, width = len(weight), bins.shape[1]
    features, cuts, lefts = [np.full(1, -1, dtype=np.int32)], [np.zeros(1, dtype=np.int32)], [np.zeros(1, dtype=np.int32)]
    counts = [np.bincount(y, n, k).reshape(1, k)]
    made = 1
    node = np.zeros(len(y), dtype=np.int64)
    split = np.flatnonzero((counts[0] > 0).sum(axis=1) > 1)  # of the last level, those to split
    for _ in range(depth):
        if not len(split):
            break
        place = np.full(len(features[-1]), -1)
        place[split] = np.arange(len(split))
        node = place[node]
        kept = np.flatnonzero(node >= 0)
        kept = kept[np.argsort(node[kept], kind="stable")]
        bins, y, n, node = bins[kept], y[kept], n[kept], node[kept]
        tried = np.sort(rng.random((len(split), width)).argpartition(tries - 1, axis=1)[:, :tries], axis=1)
        gain, feature, cut = best_splits(bins, y, n, node, tried, weight)
        good = gain > NO_GAIN
        first = np.cumsum(good) * 2 - 2
        features[-1][split[good]], cuts[-1][split[good]], lefts[-1][split[good]] = feature[good], cut[good], made + first[good]
        children = 2 * int(good.sum())
        right = bins[np.arange(len(node)), feature[node]] > cut[node]
        stays = good[node]
        bins, y, n, node = bins[stays], y[stays], n[stays], (first[node] + right)[stays]
        counts.append(np.bincount(node * k + y, n, children * k).reshape(children, k))
        features.append(np.full(children, -1, dtype=np.int32))
        cuts.append(np.zeros(children, dtype=np.int32))
        lefts.append(np.zeros(children, dtype=np.int32))
        made += children
        split = np.flatnonzero((counts[-1] > 0).sum(axis=1) > 1)
    return pruned(np.cumsum([0, *map(len, features)]), *map(np.concatenate, (features, cuts, lefts, counts)), weight)


def pruned(levels: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The tree with leaves that predict the same merged, from below."""
    says = (counts * weight).argmax(axis=1)
    for a, b in zip(levels[-2::-1], levels[:0:-1]):
        inner = a + np.flatnonzero(feature[a:b] >= 0)
        l = left[inner]
        feature[inner[(feature[l] < 0) & (feature[l + 1] < 0) & (says[l] == says[l + 1])]] = -1
    reached = np.zeros(len(feature), dtype=bool)
    reached[0] = True
    for a, b in zip(levels, levels[1:]):
        l = left[a:b][reached[a:b] & (feature[a:b] >= 0)]
        reached[l] = reached[l + 1] = True
    number = np.cumsum(reached) - 1
    counts[feature >= 0] = 0  # only leaves vote
    left = np.where(feature >= 0, number[left], 0)
    return {"feature": feature[reached], "cut": cut[reached], "left": left[reached].astype(np.int32), "counts": counts[reached].astype(np.int32)}


def votes(tree: dict[str, np.ndarray], bins: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares of the classes in the leaf of each row; none of a tree without rows."""
    at = np.zeros(len(bins), dtype=np.int64)
    going = np.arange(len(bins))
    while len(going):
        going = going[tree["feature"][at[going]] >= 0]
        here = at[going]
        at[going] = tree["left"][here] + (bins[going, tree["feature"][here]] > tree["cut"][here])
    weighted = tree["counts"] * weight
    total = weighted.sum(axis=1, keepdims=True)
    return np.divide(weighted, total, out=np.zeros_like(weighted), where=total > 0)[at]


@dataclass(frozen=True)
class Forest:
    """What the driver knows of a forest: labels, weights of classes, bounds of bins, and
    the folder with a row for each tree."""

    labels: list[str]
    weight: np.ndarray
    bounds: list[np.ndarray]
    folder: str

    def trees(self) -> Iterator[dict[str, np.ndarray]]:
        """In order of their numbers' files, one at a time."""
        for name in parquet_files(self.folder):
            with open_file(self.folder, name) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                    for row in batch.to_pylist():
                        tree = {c: np.frombuffer(row[c], dtype=np.int32) for c in ("feature", "cut", "left", "counts")}
                        yield tree | {"counts": tree["counts"].reshape(-1, len(self.labels))}

    def predicted(self, features: str | Column) -> Column:
        """Struct (prediction, confidence): number of the label with most votes, its share."""

        @F.pandas_udf("prediction int, confidence double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = np.zeros((len(batch), len(self.labels)))
                if len(batch):
                    bins = binned(np.stack(batch.to_list()), self.bounds)
                    for tree in self.trees():
                        out += votes(tree, bins, self.weight)
                total = out.sum(axis=1)
                share = np.divide(out.max(axis=1), total, out=np.zeros(len(out)), where=total > 0)
                yield pd.DataFrame({"prediction": out.argmax(axis=1).astype(np.int32), "confidence": share})

        return predict(features)


def grow_forest(rows: DataFrame, label: str, trees: int, depth: int, seed: int) -> Forest:
    """A forest from ``label``, array ``_x`` and ``_weight``, one for each class."""
    spark = rows.sparkSession
    rows = written(rows, clean=True)  # read for the classes, the bounds and the blocks
    classes = rows.groupBy(label).agg(F.first("_weight")).orderBy(label).collect()
    labels, weight = [str(c[0]) for c in classes], np.array([c[1] for c in classes], dtype=float)
    if not labels:
        raise ValueError("no rows to train on")
    sample = rows.select("_x", "_weight", F.xxhash64(F.lit(seed), "_x").alias("_h")).orderBy("_h").limit(SAMPLED).toArrow()
    x = stacked(sample.column("_x").combine_chunks())
    own = sample.column("_weight").to_numpy()
    bounds = [bin_bounds(x[:, f], own) for f in range(x.shape[1])]
    width, tries = len(bounds), math.ceil(math.sqrt(len(bounds)))
    data, out = shared_folder(spark, "bins"), shared_folder(spark, "trees")
    number = {v: i for i, v in enumerate(labels)}

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            y = np.array([number[str(v)] for v in batch.column(0).to_pylist()], dtype=np.int32)
            block = binned(stacked(batch.column(1)), bounds)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([i], pa.int32()), "y": [y.tobytes()], "bins": [block.tobytes()]})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in (t for batch in batches for t in batch.column(0).to_pylist()):
            drawn = []
            for name in parquet_files(data):
                with open_file(data, name) as f:
                    for row in (r for b in pq.ParquetFile(f).iter_batches(batch_size=1) for r in b.to_pylist()):
                        y = np.frombuffer(row["y"], dtype=np.int32)
                        n = np.random.default_rng([seed % (1 << 63), tree, row["part"], row["block"]]).poisson(1.0, len(y))
                        drawn.append((np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, width)[n > 0], y[n > 0], n[n > 0]))
            made = grown_tree(*map(np.concatenate, zip(*drawn)), weight, depth, tries, np.random.default_rng([seed % (1 << 63), tree]))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), **{c: [v.tobytes()] for c, v in made.items()}})

    blocks = rows.select(label, "_x").mapInArrow(cut_up, "part int, block int, y binary, bins binary")
    try:
        blocks.write.parquet(data)
        numbers = spark.range(0, trees, 1, trees).select(F.col("id").cast("int").alias("tree"))
        numbers.mapInArrow(grow, "tree int, feature binary, cut binary, left binary, counts binary").write.parquet(out)
    finally:
        remove_folder(data)
    return Forest(labels, weight, bounds, out)


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of finite numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(values) % max(1, len(column)) or not np.isfinite(values).all():
        raise ValueError("features must be arrays of one length, without NULL, NaN or infinity")
    if len(set(np.unique(column.value_lengths().to_numpy(zero_copy_only=False)))) > 1:
        raise ValueError("features must be arrays of one length, without NULL, NaN or infinity")
    return values.reshape(len(column), -1)
