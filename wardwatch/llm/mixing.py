"""Mixing to target weights with soft domain membership."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch.llm.shared import stored
from wardwatch.llm.vocabulary import release_memory

CLASSES = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
PLAIN = bytes([*range(97, 123), *range(128, 256)])


class FeatureCells(dict):
    """The two cells of a word as one number: that of its lower-case form, and that of
    its shape (first and last three of its capitals, digits and other characters, without
    small letters; a capital counts as A, a digit as 0)."""

    def __init__(self, bits: int, limit: int = 150_000):
        super().__init__()
        self.bits, self.limit = bits, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        shape = word.translate(CLASSES, PLAIN)
        shift = 64 - self.bits
        own = xxhash.xxh3_64_intdigest(word.lower()) >> shift
        value = self[word] = own << self.bits | xxhash.xxh3_64_intdigest(b"\0" + shape[:1] + shape[-3:]) >> shift
        return value


def features(text: str | None, cells: FeatureCells) -> tuple[np.ndarray, int]:
    """(distinct cells, number of words) of a text; null has none."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    distinct = set(words)
    both = np.fromiter(map(cells.__getitem__, distinct), np.int64, len(distinct))
    return np.unique(np.concatenate([both >> cells.bits, both & ((1 << cells.bits) - 1)])), len(words)


@dataclass
class DomainModel:
    """Softmax weights, one row per cell and one column per domain."""

    weights: np.ndarray
    bias: np.ndarray
    domains: list[str]
    bits: int

    def posterior(self, cells: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[cells].sum(axis=0, dtype=np.float64)
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int = 3000, bits: int = 18, steps: int = 150, l2: float = 3e-4, least: int = 3, seed: int = 11) -> DomainModel:
    """A softmax classifier of the documents that a labelled table (doc_id, domain) names,
    on at most ``max_rows`` ids of each domain, those of the smallest seeded id hashes.

    Only ids are joined to choose them; the chosen ids, a table of fixed size, go to the
    documents. Features are made by the executors and only distinct cells reach the
    driver, 2**bits a row at most. Rows weigh what their domain has per chosen row, so
    posteriors keep the shares of the labelled rows. Cells in fewer than ``least`` rows
    keep weight zero.
    """

    def rows(batches):
        cells = FeatureCells(bits)
        for batch in batches:
            found = [features(t.as_py(), cells)[0].astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["domain", "cells"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").filter(F.col("domain").isin(domains)).distinct()
    known = stored(ids.join(known, "doc_id"), "labelled")
    counts = dict(known.groupBy("domain").count().collect())
    chosen = None
    for name in domains:
        some = known.filter(F.col("domain") == name).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = stored(chosen.distinct(), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taken = texts.join(F.broadcast(chosen), "doc_id").select("domain", "text").mapInArrow(rows, "domain string, cells binary").collect()
    k, dims = len(domains), 1 << bits
    weights, bias = np.zeros((dims, k)), np.zeros(k)
    if not taken:
        return DomainModel(weights.astype(np.float32), bias, domains, bits)
    taken.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([domains.index(d) for d, _ in taken], np.int32)
    row = np.repeat(np.arange(len(taken), dtype=np.int32), [len(c) // 4 for _, c in taken])
    cell = np.frombuffer(b"".join(bytes(c) for _, c in taken), "<i4")
    del taken  # ids of cells stay bytes until here: lists of numbers take ten times the room
    common = np.bincount(cell, minlength=dims)[cell] >= least
    cell, place = np.unique(cell[common], return_inverse=True)
    row, used = row[common], len(cell)
    weight = np.array([counts.get(d, 0) for d in domains], float)[y] / np.bincount(y, minlength=k)[y]
    weight /= weight.sum()
    hot = np.eye(k)[y]
    w, m, v = (np.zeros((used, k)) for _ in range(3))
    mb, vb = np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        z = np.stack([bias[j] + np.bincount(row, w[place, j], minlength=len(y)) for j in range(k)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - hot) * weight[:, None]
        grad = np.stack([np.bincount(place, g[row, j], minlength=used) for j in range(k)], axis=1) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(axis=0), 0.99 * vb + 0.01 * g.sum(axis=0) ** 2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-5)
        bias = bias - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-5)
    weights[cell] = w
    return DomainModel(weights.astype(np.float32), bias, domains, bits)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row; tokens are white-space words. A text
    without words has the model's prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x domains, fixed

    def rows(batches):
        release_memory()
        m = shared.value
        cells = FeatureCells(m.bits)
        for batch in batches:
            found = [features(t.as_py(), cells) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([n for _, n in found], pa.int64()),
                    "posterior": pa.array([m.posterior(c) for c, _ in found], pa.list_(pa.float64())),
                }
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(rows, "doc_id long, n_tokens long, posterior array<double>")


def _rates(p: np.ndarray, history: list[tuple[np.ndarray, float, float]], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(rate, extrapolated point) of each document after the steps so far. A step is
    (gradient by domain, step length, momentum); it needs the document's own posterior
    and rate alone, so no per-document state has to be kept between passes."""
    rate = point = np.ones(len(p))
    for gradient, length, momentum in history:
        new = np.maximum(point - length * (p @ gradient + ridge * (point - 1)), 0)
        rate, point = new, new + momentum * (new - rate)
    return rate, point


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, k)


def fit_rates(docs: DataFrame, targets: np.ndarray, ridge: float = 1e-3, steps: int = 40, tolerance: float = 1e-5) -> list[tuple[np.ndarray, float, float]]:
    """Steps of accelerated projected gradient for nonnegative rates r that minimise

        1/2 sum_k ((S_k - T_k) / T)^2 + ridge/2 sum_i w_i (r_i - 1)^2,
        S_k = sum_i r_i t_i p_ik,  T = sum_k T_k,  w_i = t_i / sum t.

    Each step is one pass over (n_tokens, posterior) that returns a domain vector per
    batch, summed map-side; gradients are scaled by w_i, so the step length follows from
    the domains' Gram matrix. Ends when domain totals move by less than ``tolerance``.
    """
    k = len(targets)
    total = float(targets.sum())
    names = [f"s{j}" for j in range(k)]

    def gram(batches):
        for b in batches:
            p, t = _matrix(b.column("posterior"), k), np.asarray(b.column("n_tokens"), np.float64)
            g = (p * t[:, None]).T @ p
            yield pa.RecordBatch.from_pydict({"t": [float(t.sum())]} | {f"g{i}": [float(x)] for i, x in enumerate(g.ravel())})

    schema = ", ".join(["t double", *[f"g{i} double" for i in range(k * k)]])
    made = docs.mapInArrow(gram, schema).agg(*[F.sum(c).alias(c) for c in ["t", *[f"g{i}" for i in range(k * k)]]]).first()
    if not made or not made["t"] or not total:
        return []
    tokens = made["t"]
    scale = tokens / total
    lipschitz = float(np.linalg.eigvalsh(np.array(made[1:]).reshape(k, k) / tokens)[-1]) * scale**2 + ridge
    history: list[tuple[np.ndarray, float, float]] = []
    before, speed = None, 1.0
    for _ in range(steps):
        now = list(history)

        def sums(batches, now=now):
            for b in batches:
                p, t = _matrix(b.column("posterior"), k), np.asarray(b.column("n_tokens"), np.float64)
                _, point = _rates(p, now, ridge)
                yield pa.RecordBatch.from_pydict({n: [float(x)] for n, x in zip(names, (point * t) @ p, strict=True)})

        s = np.array(docs.mapInArrow(sums, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first(), float)
        if before is not None and np.abs(s - before).max() <= tolerance * total:
            break
        before = s
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        history.append(((s - targets) / total * scale, 1 / lipschitz, (speed - 1) / faster))
        speed = faster
    return history


@dataclass
class Mixture:
    """A fitted mixture; ``rate`` gives the rates of posteriors."""

    model: DomainModel
    history: list[tuple[np.ndarray, float, float]]
    ridge: float

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        return _rates(posterior, self.history, self.ridge)[0]


def fit_mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str, ridge: float, steps: int, max_rows: int, seed: int) -> tuple[Mixture, DataFrame]:
    """The mixture, and (doc_id, n_tokens, posterior) of every row."""
    model = fit_domains(docs, labels, list(weights), max_rows=max_rows, seed=seed)
    seen = stored(posteriors(docs, model), "posteriors")
    at = list(weights).index(anchor)
    available = seen.agg(F.sum(F.col("n_tokens") * F.col("posterior")[at])).first()[0] or 0.0
    share = np.array(list(weights.values()), float)
    return Mixture(model, fit_rates(seen, available * share / share[at], ridge, steps), ridge), seen


def _unit(seed: int):
    """A fixed number in [0, 1) for each doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str, ridge: float = 1e-3, steps: int = 40, max_rows: int = 3000, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) per row of ``docs``.

    ``weights`` gives each domain's share of the mixture; totals are scaled so that
    ``anchor``'s target is what the corpus is expected to hold of it. ``rate`` is the
    fitted number of times a document is used; ``copies`` rounds it up or down by a fixed
    hash of doc_id, so that its expectation is the rate.

    Null and empty texts have no tokens and the rate of the prior. Repeated rows are
    rated each; labels of other domains are ignored; without labelled documents all
    posteriors are equal; other columns are ignored; an empty table gives no row.
    """
    fitted, seen = fit_mixture(docs, labels, weights, anchor, ridge, steps, max_rows, seed)
    k = len(weights)

    def rows(batches):
        for b in batches:
            yield b.append_column("rate", pa.array(fitted.rate(_matrix(b.column("posterior"), k)), pa.float64()))

    rated = seen.mapInArrow(rows, "doc_id long, n_tokens long, posterior array<double>, rate double")
    return rated.withColumn("copies", F.floor(F.col("rate") + _unit(seed)).cast("long"))


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], anchor: str, ridge: float = 1e-3, steps: int = 40, max_rows: int = 3000, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that the mixture uses, each once: a rate below one is the
    chance to stay, a higher one is not repeated. A second pass rates each row with its
    columns beside it, so texts are not shuffled; null doc_ids share one chance. Null and
    empty texts have the prior's rate; extra columns may have any name; an empty table
    gives no row."""
    fitted, _ = fit_mixture(docs, labels, weights, anchor, ridge, steps, max_rows, seed)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**bits x domains, fixed
    columns = docs.columns
    own = next((i for i, c in enumerate(docs.schema) if c.name == "text" and c.dataType == T.StringType()), None)

    def rows(batches):
        release_memory()
        f = shared.value
        cells = FeatureCells(f.model.bits)
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column("row").flatten()
            p = np.stack([f.model.posterior(features(t.as_py(), cells)[0]) for t in (b.column("text") if own is None else row[own])])
            stays = f.rate(p) + np.asarray(b.column("unit"), float) >= 1
            yield pa.RecordBatch.from_arrays(row, names=columns).filter(pa.array(stays))

    # a text goes to the task once: it is in its row already, unless it has another type
    given = docs.select(F.struct(*columns).alias("row"), *([F.col("text").cast("string").alias("text")] if own is None else []), F.coalesce(_unit(seed), F.lit(0.0)).alias("unit"))
    return given.mapInArrow(rows, docs.schema)
