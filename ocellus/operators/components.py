"""Connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.sources.scratch import written


def union_find(a, b) -> dict:
    """Smallest member of each node's component."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def components_by_slide(edges: DataFrame, on: str = "slide_id") -> DataFrame:
    """(on, node, component) where no component crosses ``on``: one pass per slide over its edges alone."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        roots = union_find(part["a"].tolist(), part["b"].tolist())
        return pd.DataFrame({on: part[on].iloc[0], "node": list(roots), "component": list(roots.values())})

    return edges.select(on, "a", "b").groupBy(on).applyInPandas(solve, f"{on} long, node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for graphs of any size and shape: labels fall to the least neighbour's and jump to their label's label.

    Ends when a round changes nothing; each round is written, so no lineage grows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = written(labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("label")))
        if not step.filter("label <> old").limit(1).count():
            return labels
        ahead = step.select(F.col("node").alias("k"), F.col("label").alias("jump"))
        labels = written(step.join(ahead, step.label == ahead.k).select("node", F.least("label", "jump").alias("component")))
