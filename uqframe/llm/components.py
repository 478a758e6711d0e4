"""Connected components of links between ids, without bringing them together anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import slices
from uqframe.sources.session import cut_lineage


class Forest:
    """Union-find that always keeps the smallest id as the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Nodes that a task holds before it hands on what it has: bounds its memory.
MOST_NODES = 500_000


def contract(edges: DataFrame) -> DataFrame:
    """Links (a, b) of each task replaced by links to the roots that they lead to."""
    def run(batches):
        forest = Forest()

        def rows():
            found = [(x, forest.find(x)) for x in forest.parent]
            return pa.RecordBatch.from_pydict(
                {"a": [x for x, r in found if x != r], "b": [r for x, r in found if x != r]},
                schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for part in slices(batches, 4096):
            for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist()):
                forest.union(a, b)
            if len(forest.parent) > MOST_NODES:
                yield rows()
                forest = Forest()
        yield rows()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every id that some link (a, b) holds; a component is its smallest
    id. Labels spread over links and then jump to the label of their label, until none changes."""
    edges = contract(edges)
    both = edges.union(edges.select("b", "a")).distinct()
    both = cut_lineage(both.select(F.col("a").alias("node"), F.col("b").alias("other")), "links")
    labels = cut_lineage(both.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        least = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        moved = labels.join(least, "node").select(
            "node", F.col("component").alias("old"),
            F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = moved.join(jump, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        moved = cut_lineage(moved, "labels")
        labels = moved.drop("old")
        if not moved.where("old <> component").limit(1).count():
            return labels
