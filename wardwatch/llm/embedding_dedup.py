"""Near duplicates among embeddings: spherical k-means cells, bounds, blocked cosine products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardwatch.llm.components import components
from wardwatch.llm.shared import stored


def unit_rows(vectors: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors have a direction, those scaled to length 1, in double precision).
    Null, empty and zero vectors and those with null or non-finite parts have none."""
    rows, good = [], np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top  # no overflow in the squares
            good[i] = True
            rows.append(x / np.sqrt(x @ x))
    return good, rows


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres; an empty cell keeps its last centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def distinct_centres(centres: np.ndarray, threshold: float) -> np.ndarray:
    """Centres of which no two are nearer than the threshold, the first of such staying: a
    group of near copies falls in few cells. Each is followed by its nearest one left."""
    apart: list[int] = []
    for i, c in enumerate(centres):
        if not apart or (centres[apart] @ c).max() < threshold:
            apart.append(i)
    left, chain = np.ones(len(apart), bool), [0]
    centres = centres[apart]
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, centres @ centres[chain[-1]], -2).argmax()))
        left[chain[-1]] = False
    return centres[chain]


def fit_cells(usable: DataFrame, threshold: float, cell_rows: int, max_cells: int, sample_rows: int, rounds: int, seed: int) -> dict[int, np.ndarray]:
    """Centres by vector length: about one per ``cell_rows`` vectors, ``max_cells`` at most,
    fitted on at most ``sample_rows`` vectors of the smallest seeded hashes, near ones merged."""
    counts = usable.groupBy(F.size("embedding").alias("d")).count().collect()  # one row per dimension in use
    found = {}
    for d, n in counts:
        sample = usable.filter(F.size("embedding") == d).orderBy(F.xxhash64("vec_id", "rid", F.lit(seed))).limit(sample_rows)
        good, rows = unit_rows([r[0] for r in sample.select("embedding").collect()])
        if rows:
            x = np.stack(rows)
            found[d] = distinct_centres(spherical_kmeans(x, min(max_cells, len(x), -(-n // cell_rows)), rounds, seed), threshold)
    return found


def assign_cells(usable: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(rid, label, d, vec, home, angle): unit vectors as bytes, their nearest cell and the
    angle to its centre; vectors without a direction are left out."""

    def assign(batches):
        for batch in batches:
            keep, size, out, home, angle = [], [], [], [], []
            good, rows = unit_rows(batch.column(2).to_pylist())
            for i, x in zip(np.flatnonzero(good), rows, strict=True):
                c = centres.get(len(x))
                if c is None:
                    # no vector of this length had a direction when the cells were fitted
                    home.append(0)
                    angle.append(np.pi)
                else:
                    near = c @ x
                    home.append(int(near.argmax()))
                    angle.append(float(np.arccos(np.clip(near[home[-1]], -1, 1))))
                keep.append(int(i))
                size.append(len(x))
                out.append(x.tobytes())
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(taken) for i in range(2)] + [pa.array(size, pa.int32()), pa.array(out, pa.binary()), pa.array(home, pa.int32()), pa.array(angle, pa.float64())],
                names=["rid", "label", "d", "vec", "home", "angle"],
            )

    return usable.select("rid", "label", "embedding").mapInArrow(assign, "rid long, label string, d int, vec binary, home int, angle double")


def cells_in_reach(x: np.ndarray, home: np.ndarray, centres: np.ndarray, radius: np.ndarray, threshold: float) -> np.ndarray:
    """Cells that can hold a vector at cosine >= ``threshold`` to any of ``x``, by two bounds.

    Such a vector is at most arccos(threshold) from x, so x is at most that and the cell's
    radius from its centre (triangle inequality). It is no nearer to the centre of x's own
    cell than to its own, so the plane midway between both is at most that angle from x.
    """
    slack = 1e-6  # far above the rounding of angles and products
    reach = np.arccos(np.clip(threshold, -1, 1)) + slack
    gap = np.sqrt(np.maximum(2 - 2 * np.clip(centres @ centres.T, -1, 1), 0))
    found = np.zeros(len(centres), bool)
    for at in range(0, len(x), 512):
        near, own = x[at : at + 512] @ centres.T, home[at : at + 512]
        inside = np.arccos(np.clip(near, -1, 1)) <= radius + reach
        if reach < np.pi / 2:
            beyond = near[np.arange(len(own)), own][:, None] - near
            inside &= beyond <= np.sin(reach) * gap[own] + slack
        found |= inside.any(axis=0)
    found[home] = True
    return np.flatnonzero(found)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    cell_rows: int = 400,
    max_cells: int = 1024,
    sample_rows: int = 40_000,
    block_rows: int = 1500,
    rounds: int = 12,
    seed: int = 17,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors of equal, not null label link at cosine >= ``threshold``; every such pair is
    found. Cells only save comparisons: a vector is compared with all cells that
    ``cells_in_reach`` cannot rule out, which for vectors without clusters are all of its
    label. Members of a cell, or of some small ones, form blocks of about ``block_rows``
    rows (a large cell is cut by a hash); a task holds the two blocks it compares. A block
    is one row, so comparing costs few rows, and links leave as counts and as one edge per
    vector, never as all pairs.

    Vectors that are null, empty or zero or hold null or non-finite parts, and those
    without label, link with nothing. Repeated vec_ids are separate rows that may link,
    and share one component. kept marks the row of the smallest vec_id of its component;
    repeated rows of that id are all kept. A null vec_id is named by the others of its
    component, and null (not kept) without any. Other columns are ignored; an empty
    table gives an empty result.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    base = stored(base.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    usable = base.filter("label is not null and size(embedding) > 0")
    centres = fit_cells(usable, threshold, cell_rows, max_cells, sample_rows, rounds, seed)
    placed = stored(assign_cells(usable, centres), "cells")
    radii = {d: np.zeros(len(c)) for d, c in centres.items()}
    for d, cell, most in placed.groupBy("d", "home").agg(F.max("angle")).collect():  # a row per cell
        if d in radii:
            radii[d][cell] = most

    key = ["label", "d"]
    n = placed.groupBy(*key, "home").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") <= block_rows
    before = Window.partitionBy(key).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # at most max_cells rows
    n = n.withColumn("_before", F.coalesce(F.sum(F.when(small, F.col("n")).otherwise(0)).over(before), F.lit(0)))
    n = n.select(*key, "home", F.when(small, F.lit(1)).otherwise(F.ceil(F.col("n") / block_rows)).alias("parts"), F.when(small, F.floor(F.col("_before") / block_rows)).otherwise((F.col("home") + 1) * F.lit(1 << 32)).alias("first"))
    dealt = placed.join(n, [*key, "home"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts")))

    def pack(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, d, block = group
        pdf = pdf.sort_values("rid", ignore_index=True)
        home, vec = pdf["home"].to_numpy(), b"".join(pdf["vec"])
        near = np.unique(home)
        if d in centres:
            near = cells_in_reach(np.frombuffer(vec).reshape(-1, int(d)), home, centres[d], radii[d], threshold)
        row = {"label": label, "d": d, "block": block, "rids": pdf["rid"].to_numpy(np.int64).tobytes(), "vecs": vec, "cells": np.unique(home), "near": near}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    packed = dealt.select(*key, "block", "rid", "home", "vec").groupBy(*key, "block")
    packed = stored(packed.applyInPandas(pack, "label string, d int, block long, rids binary, vecs binary, cells array<int>, near array<int>"), "blocks")
    holds = packed.select(*key, F.explode("cells").alias("cell"), F.col("block").alias("b"))
    pairs = packed.select(*key, F.explode("near").alias("cell"), F.col("block").alias("a")).join(holds, [*key, "cell"])
    pairs = pairs.select(*key, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    sides = sides.join(packed.select(*key, "block", "rids", "vecs"), [*key, "block"])

    def compare(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, d, i, j = group
        at = {int(b): k for k, b in enumerate(pdf["block"])}
        sets = [(np.frombuffer(pdf["rids"][at[b]], np.int64), np.frombuffer(pdf["vecs"][at[b]]).reshape(-1, int(d))) for b in sorted({int(i), int(j)})]
        rid, x = np.concatenate([r for r, _ in sets]), np.concatenate([v for _, v in sets])
        size, split = len(rid), 0 if i == j else len(sets[0][0])
        root, links, found = np.arange(size), np.zeros(size, np.int64), []
        for start in range(0, split or size, 512):
            stop = min(start + 512, split or size)
            p, q = np.nonzero(x[start:stop] @ x[split or start :].T >= threshold)
            p, q = p + start, q + (split or start)
            p, q = p[p < q], q[p < q]
            links += np.bincount(p, minlength=size) + np.bincount(q, minlength=size)
            found.append((p, q))
            _join(root, p, q)
        while True:  # until no link joins two roots
            before = root.copy()
            for p, q in found:
                _join(root, p, q)
            if (before == root).all():
                break
        hit = links > 0
        return pd.DataFrame({"rid": rid[hit], "links": links[hit], "root": rid[root[hit]]})

    counted = stored(sides.groupBy(*key, "i", "j").applyInPandas(compare, "rid long, links long, root long"), "links")
    roots = components(counted, "rid", "root")
    links = counted.groupBy("rid").agg(F.sum("links").alias("n_links"))
    named = base.select("rid", "vec_id").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    result = named.join(least, "root").select("vec_id", "n_links", "component_id")
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Lower the roots of linked rows to the smaller one, and follow roots to their end."""
    if not len(p):
        return
    least = np.minimum(root[p], root[q])
    np.minimum.at(root, root[p], least)
    np.minimum.at(root, root[q], least)
    while True:
        up = root[root]
        if (up == root).all():
            return
        root[:] = up
