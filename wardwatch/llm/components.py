"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node reachable.

    Each step is a map-side combined minimum and a join back to the links, written to
    the shared folder; hubs stay rows, never one group in one task. Steps end when the
    links no longer change (every node then points at its root). Null ends are ignored;
    an empty table gives an empty result.
    """
    edges = stored(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links"
    )
    nodes = edges.select("u").union(edges.select("v")).distinct()
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        step = _large_star(edges).filter("u <> v").distinct()
        edges = stored(_small_star(step).filter("u <> v").distinct(), "links")
    return nodes.join(edges, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
