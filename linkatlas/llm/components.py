"""Connected components of a link table, with no step that gathers a component."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkatlas.session import durable


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: every node with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _stars(links: DataFrame, upward: bool) -> DataFrame:
    """One star step: the larger (``upward``) or smaller neighbours of each node are tied to the least node it knows."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if upward:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if upward:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)`` that is not the least of its component.

    Union-find inside partitions first, then large-star and small-star steps until nothing changes; the
    result has one row per node, so joins against it only repeat small rows. Nulls must not occur; loops and
    repeated links are harmless; no links give no rows.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    now = durable(ordered.mapInArrow(_forest, "a bigint, b bigint").distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.col("a") != F.col("b")).cast("int"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        now = durable(_stars(_stars(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
