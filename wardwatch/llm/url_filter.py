"""URL filter: host and path rules, and logistic regression on hashed n-grams elsewhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.words import mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one; of rules of one
    length the first in alphabetical order."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def gram_cells(texts: list[bytes], sizes: tuple[int, ...], bits: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of every character n-gram of every text; ^ and $ mark its ends."""
    marked = [b"^" + t + b"$" for t in texts]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(marked)), lengths)
    rows, cells = [], []
    for n in sizes:
        count = len(data) - n + 1
        if count <= 0:
            continue
        h = np.full(count, salt * 1000 + n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[j : j + count] + np.uint64(1)
        inside = row[:count] == row[n - 1 :]
        rows.append(row[:count][inside])
        cells.append((mixed(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


@dataclass
class UrlModel:
    """Weights of 2**bits cells and a bias; ``block_probability`` judges hosts and paths."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        rows, cells, values = url_features(hosts, paths, self.sizes, self.bits)
        z = self.bias + np.bincount(rows, self.weights[cells] * values, minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def url_features(hosts: list[str], paths: list[str], sizes: tuple[int, ...], bits: int):
    """(row, cell, value): n-grams of host and path in cells of their own, each url
    scaled to length 1."""
    found = [gram_cells([t.encode("utf-8", "surrogatepass") for t in texts], sizes, bits, salt) for salt, texts in ((1, hosts), (2, paths))]
    rows, cells = (np.concatenate(x) for x in zip(*found, strict=True))
    count = np.bincount(rows, minlength=len(hosts)).astype(float)
    return rows, cells, 1 / np.sqrt(np.maximum(count, 1))[rows]


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, sizes=(3, 4, 5), bits: int = 16, steps: int = 200, l2: float = 1e-4) -> UrlModel:
    """Full-batch logistic regression with momentum; the two classes weigh the same.
    Without rows, or with one class only, the model is the bias of that class."""
    y = np.asarray(blocked, float)
    weights, bias = np.zeros(1 << bits), 0.0
    if not len(y) or y.min() == y.max():
        return UrlModel(weights, 0.0 if not len(y) else (4.0 if y[0] else -4.0), sizes, bits)
    rows, cells, values = url_features(hosts, paths, sizes, bits)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    speed, bias_speed = np.zeros_like(weights), 0.0
    for _ in range(steps):
        z = bias + np.bincount(rows, weights[cells] * values, minlength=len(y))
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        speed = 0.9 * speed - 4.0 * (np.bincount(cells, g[rows] * values, minlength=1 << bits) + l2 * weights)
        bias_speed = 0.9 * bias_speed - 0.4 * g.sum()
        weights, bias = weights + speed, bias + bias_speed
    return UrlModel(weights, float(bias), sizes, bits)


def fit_table(labelled: DataFrame, max_rows: int = 4000, seed: int = 5, **options) -> UrlModel:
    """A model of a labelled table (url, blocked), on at most ``max_rows`` rows of each
    label, those of the smallest seeded url hashes. Rows with a null are left out."""
    taken = []
    for label in (False, True):
        rows = labelled.filter(F.col("url").isNotNull() & (F.col("blocked").cast("boolean") == F.lit(label)))
        rows = rows.select(host_of(F.col("url")), path_of(F.col("url")), "url").orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(max_rows)
        taken += [(h, p, label) for h, p, _ in rows.collect()]
    return fit([h for h, _, _ in taken], [p for _, p, _ in taken], np.array([x for _, _, x in taken]), **options)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every row.

    A url that is null or has no ``://`` has empty host and path; it fits no rule and is
    judged by the model's bias. The rule's verdict stands before the model's. Repeated
    rows are judged each; other columns are ignored; an empty table gives no row.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2**bits weights

    def score(batches):
        for batch in batches:
            p = shared.value.block_probability(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield batch.append_column("block_probability", pa.array(p, pa.float64()))

    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    scored = parts.mapInArrow(score, f"page_id {kind}, host string, path string, block_probability double")
    fitting = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return scored.withColumn("_rule", fitting).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), "block_probability"
    )


def labelled_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """A labelled url table from rules: (url, blocked) of the urls that a rule decides."""
    url = F.col("url").cast("string")
    found = pages.select(url.alias("url"), rule_of(host_of(url), path_of(url), rules).alias("_rule")).filter("_rule is not null")
    return found.select("url", (F.col("_rule.verdict") == "block").alias("blocked"))
