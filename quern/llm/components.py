"""Distributed union-find: connected components of an edge table by minimum labels, pointer jumping and contraction.

Each round gives every node the least of itself and its neighbours as parent, follows parents to the root (doubling the
distance each step), and replaces the edges by edges between roots. Rounds and steps grow with the logarithm of the longest
path. Every step is a join or an aggregation with map-side combining and is written to the shared folder; nothing but counts
comes to the driver. A node that very many others point at is joined by broadcast of the few such nodes (``spread_join``), so no
task gets all of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import tables
from quern.llm.tables import spread_join, stage


def _compress(parents: DataFrame) -> DataFrame:
    """Follow parents to the root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
        moved = stage(spread_join(parents, up, "parent", "left", small=0).select("node", F.coalesce("_p", "parent").alias("parent"), (F.col("_p") < F.col("parent")).alias("moved")), "jump")
        parents = moved.select("node", "parent")
        if moved.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge: comp is the least node of its component. Loops and repeats do no harm."""
    edges = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "edges")
    result = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        roots = _compress(stage(parents, "parents"))
        if result is None:
            result = roots
        else:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
            result = stage(spread_join(result, up, "parent", "left", small=0).select("node", F.coalesce("_p", "parent").alias("parent")), "labels")
        # every end of an edge has a root
        left, right = roots.select(F.col("node").alias("a"), F.col("parent").alias("_a")), roots.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        half = spread_join(edges, left, "a", small=0)
        if edges.count() > tables.SPREAD_ROWS:
            half = stage(half, "half")
        edges = stage(spread_join(half, right, "b", small=0).where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return result.select("node", F.col("parent").alias("comp"))
