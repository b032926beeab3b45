"""Isolation forest per record (Liu, Ting and Zhou, 2008), grown inside Spark tasks.

Every record gets its own forest, and every tree its own draw from all valid windows
of the record. Draws are made by hash, and are therefore the same on every run and
partitioning. Records of one chunk are grown and scored many at a time by the task that
holds them. Of longer ones only drawn windows are shuffled to where the record's forest is
grown, once, as a table of nodes. The nodes travel to each chunk of the record, so a hot
record is scored by as many tasks as it has chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.functions.guards import dbl, gt_num
from wardwatch.operators.vitals import FEATURES, KEYS
from wardwatch.plans.materialise import written
from wardwatch.plans.quantiles import exact_quantile

MIN_WINDOWS = 10
TREES = 100
SUBSAMPLE = 256
SPARE = 8.0  # standard deviations drawn beyond the subsample
CHUNK_WINDOWS = 20_000
TOGETHER = 4096  # windows of short records grown and scored at a time
ROWS_PER_TASK = 100_000


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    m = n[big] - 1
    out[big] = 2.0 * (np.log(m) + np.euler_gamma) - 2.0 * m / n[big]
    return out


def mix(v: np.ndarray) -> np.ndarray:
    """Splitmix64 of unsigned integers."""
    with np.errstate(over="ignore"):
        v = (np.asarray(v, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def unit(v: np.ndarray) -> np.ndarray:
    return (mix(v) >> np.uint64(11)) * 2.0**-53


def tree_roots(record: str, seed: int, trees: int) -> np.ndarray:
    """What the draws of each tree of a record start from, wherever it is grown."""
    own = int.from_bytes(hashlib.sha256(f"{seed}|{record}".encode()).digest()[:8], "little")
    return mix(np.uint64(own) ^ mix(np.arange(trees, dtype=np.uint64)))


def grow(x: np.ndarray, tree: np.ndarray, roots: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of forests: feature, cut, left child (-1 at a leaf; the right one follows
    it) and the path length that a row ending there has. Node i is the root of tree i.

    All trees are grown together, of any number of records, one level per step: points
    carry the number of their node, and a level draws a feature and a cut per node from the
    number that its tree and the turns to it give. ``depth`` is that of each tree.
    """
    node, own, deep, n_nodes, base = tree, roots, depth, len(roots), 0
    made: dict[str, list[np.ndarray]] = {"feature": [], "cut": [], "left": [], "path": []}
    for level in range(int(depth.max(initial=0)) + 1):
        size = np.bincount(node, minlength=n_nodes)
        low = np.full((n_nodes, x.shape[1]), np.inf)
        high = np.full((n_nodes, x.shape[1]), -np.inf)
        filled = np.flatnonzero(size)
        if len(filled):
            order = np.argsort(node, kind="stable")
            starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
            low[filled] = np.minimum.reduceat(x[order], starts, axis=0)
            high[filled] = np.maximum.reduceat(x[order], starts, axis=0)
        varies = high > low
        n_var = varies.sum(axis=1)
        splits = (size > 1) & (n_var > 0) & (level < deep)
        nth = (unit(own) * np.maximum(n_var, 1)).astype(int)
        feature = np.argmax(np.cumsum(varies, axis=1) > nth[:, None], axis=1)
        lo, hi = low[np.arange(n_nodes), feature], high[np.arange(n_nodes), feature]
        cut = np.where(splits, lo + unit(~own) * np.where(splits, hi - lo, 0.0), 0.0)
        child = np.full(n_nodes, -1)
        child[splits] = 2 * np.arange(splits.sum())
        made["feature"].append(feature)
        made["cut"].append(cut)
        made["left"].append(np.where(splits, base + n_nodes + child, -1))
        made["path"].append(level + average_path(size))
        keep = splits[node]
        x, node = x[keep], node[keep]
        node = child[node] + (x[np.arange(len(x)), feature[node]] > cut[node])
        own = mix(np.repeat(mix(own[splits]), 2) ^ np.tile(np.array([0, 1], dtype=np.uint64), int(splits.sum())))
        deep = np.repeat(deep[splits], 2)
        base += n_nodes
        n_nodes = 2 * int(splits.sum())
        if not n_nodes:
            break
    return {name: np.concatenate(parts) for name, parts in made.items()}


def score(nodes: dict[str, np.ndarray], rows: np.ndarray, trees: int, psi: np.ndarray, first: np.ndarray, block: int = 2048) -> np.ndarray:
    """Anomaly score of each row by the ``trees`` trees from its ``first`` on, in blocks of rows."""
    out = [np.array([], dtype=float)]
    for start in range(0, len(rows), block):
        part = rows[start : start + block]
        at = np.arange(trees)[:, None] + first[None, start : start + block]
        t, r = np.nonzero(nodes["left"][at] >= 0)
        while len(t):
            here = at[t, r]
            at[t, r] = nodes["left"][here] + (part[r, nodes["feature"][here]] > nodes["cut"][here])
            inner = nodes["left"][at[t, r]] >= 0
            t, r = t[inner], r[inner]
        out.append(np.power(2.0, -nodes["path"][at].mean(axis=0) / average_path(psi[start : start + block])))
    return np.concatenate(out)


def grown(rows: pd.DataFrame, record: np.ndarray, names: list[str], sizes: np.ndarray, seed: int, trees: int, subsample: int):
    """Nodes of the forests of some records and the points that a tree of each takes.
    ``rows`` hold ``k``, features and ``_trees``; ``record`` is the place of a row's record in ``names``."""
    roots = np.concatenate([tree_roots(n, seed, trees) for n in names])
    lists = rows["_trees"].to_list()
    at = np.repeat(np.arange(len(rows)), [len(t) for t in lists])
    tree = record[at] * trees + np.concatenate(lists).astype(int)
    order = np.lexsort((mix(roots[tree] ^ mix(rows["k"].to_numpy(dtype=np.uint64)[at])), tree))
    at, tree = at[order], tree[order]
    kept = np.arange(len(tree)) - np.searchsorted(tree, tree) < subsample
    psi = np.minimum(subsample, sizes)
    most = int(np.ceil(np.log2(max(subsample, 2))))
    depth = np.minimum(most, np.ceil(np.log2(np.maximum(psi, 2)))).astype(int)
    nodes = grow(rows[FEATURES].to_numpy(dtype=float)[at[kept]], tree[kept], roots, np.repeat(depth, trees))
    return nodes, psi


def with_draws(known: DataFrame, seed: int, trees: int, subsample: int) -> DataFrame:
    """Adds ``_trees``, the trees that may use a window. Each tree draws every window of a
    record (``_n`` of them) by its own hash, a few more than ``subsample`` on average, so
    that enough remain after chance has played."""
    wanted = dbl(subsample + SPARE * subsample**0.5)
    own = known.withColumn("_h", F.xxhash64(*KEYS, "k", F.lit(seed)))
    drawn = lambda t: F.pmod(F.xxhash64("_h", t), F.lit(1 << 53)) / dbl(1 << 53)
    numbers = F.array(*[F.lit(t).cast("short") for t in range(trees)])
    return own.withColumn("_trees", F.filter(numbers, lambda t: drawn(t) * F.col("_n") < wanted)).drop("_h")


def drawn_windows(known: DataFrame, seed: int, trees: int, subsample: int) -> DataFrame:
    """Windows that at least one tree may use, with those trees in ``_trees``."""
    return with_draws(known, seed, trees, subsample).filter(F.size("_trees") > 0)


def isolation_forest(
    features: DataFrame,
    contamination: float = 0.1,
    seed: int = 42,
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    chunk: int = CHUNK_WINDOWS,
) -> DataFrame:
    """Adds ``score`` (higher is more anomalous) and ``flag``: above the record's
    ``1 - contamination`` quantile. Fewer than ten valid windows give NULL.

    Records within one chunk stream through tasks, many grown and scored at a time;
    longer ones are grown by a task each and scored by a task a chunk.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    features = written(features)
    counts = (
        features.filter("valid").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max("k").alias("_last"))
    )
    known = features.join(counts, list(KEYS), "left")
    trained = F.col("valid") & (F.coalesce("_n", F.lit(0)) >= MIN_WINDOWS)
    names = features.columns
    types = {f.name: f.dataType.simpleString() for f in features.schema}
    keys = ", ".join(f"`{c}` {types[c]}" for c in KEYS)
    called = lambda row: "|".join(str(v) for v in row)

    def score_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole records, in order, as many at a time as make ``TOGETHER`` rows."""

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            fresh = (rows[list(KEYS)] != rows[list(KEYS)].shift()).any(axis=1).to_numpy()
            record, firsts = np.cumsum(fresh) - 1, rows[fresh]
            named = [called(r) for r in firsts[list(KEYS)].itertuples(index=False)]
            nodes, psi = grown(rows, record, named, firsts["_n"].to_numpy(dtype=int), seed, trees, subsample)
            made = score(nodes, rows[FEATURES].to_numpy(dtype=float), trees, psi[record], record * trees)
            return rows[names].assign(score=made)

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TOGETHER:
                continue
            rows = pd.concat(held, ignore_index=True)
            ends = np.flatnonzero((rows[list(KEYS)] != rows[list(KEYS)].shift()).any(axis=1).to_numpy())  # starts of records
            start = 0
            for end in ends.tolist():
                if end - start >= TOGETHER or (end == ends[-1] and end > start):
                    yield done(rows.iloc[start:end])
                    start = end
            held = [rows.iloc[start:]]
        if held and sum(map(len, held)):
            yield done(pd.concat(held, ignore_index=True))

    def grow_record(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        nodes, psi = grown(pdf, np.zeros(len(pdf), dtype=int), [called(first[c] for c in KEYS)], np.array([int(first["_n"])]), seed, trees, subsample)
        return pd.DataFrame([{**{c: first[c] for c in KEYS}, "_last": first["_last"], "psi": int(psi[0]), **nodes}])

    def score_part(own: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own[names].assign(score=0.0)
        one = forest.iloc[0]
        nodes = {c: np.asarray(one[c]) for c in ("feature", "cut", "left", "path")}
        made = score(nodes, own[FEATURES].to_numpy(dtype=float), trees, np.full(len(own), int(one["psi"])), np.zeros(len(own), dtype=int))
        return own[names].assign(score=made)

    # small inputs are not coalesced into few Python workers, and tasks do not grow with the input
    parts = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), features.count() // ROWS_PER_TASK)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "score double"])
    used = known.filter(trained)
    short = with_draws(used.filter(F.col("_last") < chunk).select(*names, "_n"), seed, trees, subsample)
    together = short.repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "k").mapInPandas(score_records, schema)
    long = used.filter(F.col("_last") >= chunk)
    drawn = drawn_windows(long.select(*KEYS, "k", *FEATURES, "_n", "_last"), seed, trees, subsample).repartition(parts, *KEYS)
    forests = drawn.groupBy(*KEYS).applyInPandas(
        grow_record, f"{keys}, _last long, psi int, feature array<int>, cut array<double>, left array<int>, path array<double>"
    )
    forests = forests.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / chunk).cast("long"))))
    own = long.select(*names, F.floor(F.col("k") / chunk).cast("long").alias("_part")).repartition(parts, *KEYS, "_part")
    apart = own.groupBy(*KEYS, "_part").cogroup(forests.groupBy(*KEYS, "_part")).applyInPandas(score_part, schema)
    scored = written(together.unionByName(apart))
    limit = exact_quantile(scored, KEYS, "score", 1.0 - contamination)
    scored = scored.join(limit, list(KEYS)).select(*names, "score", gt_num(F.col("score"), F.col("quantile")).alias("flag"))
    rest = known.filter(~trained).select(
        *names, F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("flag")
    )
    return scored.unionByName(rest)


def forest_faults(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    """What must never happen, counted per record: a score outside (0, 1], a window with a
    score that should have none or the other way round, a flagged window that scores no
    higher than an unflagged one, and more flags than the quantile leaves room for."""
    n = F.sum(F.col("valid").cast("long"))
    due = F.when(n >= MIN_WINDOWS, n).otherwise(0)
    score, flag = F.col("score"), F.coalesce("flag", F.lit(False))
    room = F.greatest(due - 1 - F.floor(F.greatest(due - 1, F.lit(0)) * (1.0 - contamination)), F.lit(0))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = scored.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("windows"),
        due.alias("scored"),
        count((score <= 0) | (score > 1)).alias("outside"),
        (F.count(score) - due).alias("unexpected"),
        F.greatest(count(flag) - room, F.lit(0)).cast("long").alias("extra"),
        (F.min(F.when(flag, score)) <= F.max(F.when(~flag, score))).alias("_mixed"),
    )
    return counts.withColumn("mixed", F.coalesce("_mixed", F.lit(False))).drop("_mixed")
