"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, materialise


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


#: Edges that a task contracts at a time.
LOCAL_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces runs of edges by stars with the same components."""
    forest, seen = Forest(), 0

    def stars() -> pa.RecordBatch:
        rows = [(x, forest.root(x)) for x in list(forest.parent)]
        return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        seen += batch.num_rows
        if seen >= LOCAL_EDGES:
            yield stars()
            forest, seen = Forest(), 0
    yield stars()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots, which are the smallest nodes.

    Nulls are not allowed, loops and repeated edges are. Each round is written
    as Parquet; nodes with very many neighbours are only aggregated and joined.
    """
    now = arrow_map(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), _contract, "a long, b long")
    now = materialise(now, f"{name}-0")
    mark = None
    for turn in range(1, 100):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.where("a <> b").join(low, F.col("a") == F.col("c"))
        pair = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = materialise(small.select(pair.alias("e")).select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{turn}")
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
