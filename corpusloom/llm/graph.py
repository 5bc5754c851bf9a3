"""Connected components of a table of links, by alternating large and small stars over DataFrames.

Each step sends every node to the smallest of its neighbours; the links shrink to one star per component. A node with
very many links is never gathered: minima are pre-aggregated sums and the links join them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links u > v. Large: neighbours above u go to the least neighbour of u. Small: u and those below go to the least below."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


#: Links that one task may join by itself (some 100 MB); more go through the stars.
FEW = 1_000_000


def _joined(links: DataFrame) -> DataFrame:
    """Few links, in one task of an executor: union by least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array(list(map(root, parent)), pa.int64())], names=["node", "root"])

    return links.select("u", "v").repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, most: int = 40, few: int = FEW) -> DataFrame:
    """links: a, b long. Gives node, root for every node with a link: root is the least node of its component."""
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    if now.count() <= few:
        return _joined(now)
    last = None
    for _ in range(most):
        now = stored(_star(_star(now, True), False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("links did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
