"""Connected components of links between 64-bit node ids, by rounds of contraction.

Every round each node follows its neighbour of the smallest hash, pointers are followed two
steps, and the graph is rewritten on the nodes that are left; hashed order keeps the chains
short, so a few rounds do whatever the ids look like.  All rounds are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize, shuffle_width

#: A task contracts so many links at a time on its own before it sends them anywhere.
LOCAL_LINKS = 400_000


class Forest:
    """Union-find over the ids it meets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def contract(links: DataFrame) -> DataFrame:
    """Fewer links ``a, b`` with the same components, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, seen = Forest(), 0

        def out() -> pa.RecordBatch:
            a, b = forest.stars()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for x, y in zip(a.tolist(), b.tolist()):
                forest.join(x, y)
            seen += len(a)
            if seen >= LOCAL_LINKS:
                yield out()
                forest, seen = Forest(), 0
        yield out()

    return links.select("a", "b").filter("a <> b").mapInArrow(run, "a bigint, b bigint")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is named by one of its nodes.

    Links of a node with itself are left out, so such a node alone does not appear.
    """
    width = shuffle_width(links)
    # Contracted where the links are, and again where those of a node meet.  A task has one link a node that
    # is no root, so no node has many; a root can have very many.
    fewer = lambda some: materialize(contract(contract(some).repartition(width, "a")))
    edges, steps = fewer(links), []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("u").agg(F.min(ranked("v")).alias("near"))
        up = materialize(near.select("u", F.least(ranked("u"), "near")["n"].alias("p")))
        above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = materialize(up.join(above, "p").select("u", F.col("q").alias("p")))
        steps.append(up)
        moved = edges.join(up.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
        moved = moved.join(up.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        edges = fewer(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for up in reversed(steps[:-1]):
        last = found.select(F.col("node").alias("p"), F.col("component").alias("c"))
        found = up.join(last, "p", "left").select(F.col("u").alias("node"), F.coalesce("c", "p").alias("component"))
    return materialize(found)


def node_ids(task: int, first: int, count: int) -> np.ndarray:
    """Ids of rows a task makes: unique while a task makes fewer than 2**40."""
    return (np.int64(task) << np.int64(40)) + np.arange(first, first + count, dtype=np.int64)
