"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.tables import materialize


#: Edges that one task takes on rather than rounds of jobs.
FEW_EDGES = 20_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a few edges by union-find, the smaller root on top."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            root.setdefault(a, a), root.setdefault(b, b)
            one, other = find(a), find(b)
            if one != other:
                root[max(one, other)] = min(one, other)
    if root:
        nodes = list(root)
        yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star contraction: a node's neighbours are linked to the smallest of them, first
    the larger ones, then the smaller ones, until nothing moves. Edges never exceed the input's number, and what a step has
    found is written to the shared folder. Minima of a node are written before they are joined to its edges, so that both
    sides of the join come from a shuffle and the adaptive plan can split a node of any degree over many tasks.
    Null ends are ignored; self-loops give a component of one node. Up to ``few`` edges between longs are joined in one task."""
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and ends.count() <= few:
        return ends.coalesce(1).mapInPandas(_joined, "node long, component long")
    now, last = ends.where("a <> b"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(moved.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy("a").agg(F.min("b").alias("component"))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return nodes.join(root, "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
