"""Connected components over edges: each task contracts its own, and alternating large-star and small-star steps join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, discard, lean, spread_join


def _sum(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and an order-independent hash."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Nodes that a task holds while it contracts edges.
HELD = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect what the given ones do: each task finds components among its own by union-find and
    keeps a star for each, from HELD nodes on in several portions. The smaller of two roots stays the root."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        arrow = None

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            nodes = [n for n in list(parent) if find(n) != n]
            roots = [parent[n] for n in nodes]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array(roots, arrow)], ["a", "b"])

        for batch in batches:
            arrow = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield stars()
        if parent:
            yield stars()

    return edges.mapInArrow(lean(run), f"a {kind}, b {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any one orderable type -> (node, root): the smallest node that each node reaches.

    Each step links nodes to the smallest node they know of, so an edge list never grows beyond its first
    number of edges, whatever the degree of a node; the edges of a hub are spread over all tasks. Nodes without an edge to another node do not appear. Loops,
    repeated edges and null ends are ignored. Every step's edges are checkpointed.
    """
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(_contracted(edges))
    before = _sum(edges)
    while before[0]:
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("on"), F.least("a", "m").alias("m"), "n")
        large = spread_join(both, least.select("on", "m"), "a", least, 2 * before[0]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("on"), "m", "n")
        small = spread_join(large, least.select("on", "m"), "a", least, before[0]).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(_contracted(small.unionByName(least.select(F.col("on").alias("a"), F.col("m").alias("b"))).distinct()))
        after = _sum(now)
        discard(edges)
        discard(large)
        edges = now
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
