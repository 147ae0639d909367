"""Connected components of an edge table: one task for what fits one, alternating large-star and small-star steps beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task holds at once, about 100 bytes each; a hub has over a HUBS-th of all, so there are at most 2 x HUBS.
TASK_EDGES, HUBS = 500_000, 5_000


def with_least(edges: DataFrame, least: DataFrame, bar: int) -> DataFrame:
    """edges(a, b) with m of least(a, m, n); rows with more than `bar` edges are hubs."""
    hubs = least.where(F.col("n") > bar).select("a", "m")
    rest = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= bar).select("a", "m"), "a")
    return edges.join(F.broadcast(hubs), "a").unionByName(rest)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task -> (node, smallest node of its tree) for each node that isn't the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([find(x) for x in part], pa.int64())})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of edges(a, b), both long: root is the smallest node reachable.

    As many edges as a task holds are joined up in one. More go through rounds:
    each ties every node to the smallest of its neighbourhood, first for the
    larger neighbours, then for the smaller ones, until no edge changes; the
    number of rounds grows as the logarithm of the longest path.
    Neighbourhoods are reduced to their minimum before any shuffle. The minima of
    nodes with more than a HUBS-th of the edges, of which there are few, go to the
    edges; only other nodes' edges are shuffled to their minimum, so no hub's
    edges meet in one task. Every round is written to the
    shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    count = now.count()
    if count <= task_edges:
        now = written(now.coalesce(1).mapInArrow(forest, "a long, b long"), "edges") if count else now
        return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    # trees of each task's edges say the same with fewer
    now = written(now.repartition(-(-count // task_edges)).mapInArrow(forest, "a long, b long").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        bar = -(-state[0] // HUBS)
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both, least, bar).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least, bar).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
