"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.hot import join_hot
from helixframe.runtime import discard, settle


#: Nodes that a task holds before it passes its stars on.
FLUSH = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as stars around its least nodes; a large one's in several parts."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def stars() -> pa.RecordBatch:
        out = [(x, r) for x in up if x != (r := root(x))]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["u", "v"])

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(a), root(c)
            if a != c:
                up[max(a, c)] = min(a, c)
        if len(up) >= FLUSH:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b: longs); root is the least node reachable.

    Self-loops and repeated edges do no harm; an empty table gives no rows. Work is shared out by
    node, and no component is gathered in one place.
    """
    e = settle(edges.select("a", "b").mapInArrow(_forest, "u long, v long"), "edges")  # u > v
    total, before = e.count(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = join_hot(both, least, "u", "n", 2 * total, "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # every larger neighbour to the least
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        old, e = e, settle(large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct(), "edges")
        discard(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        total, before = now[0], now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out = settle(roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(e)
    return out
