"""Connected components of links in rounds of joins; nothing but counts goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import common


def _written(df: DataFrame, name: str) -> DataFrame:
    return common.materialize(df, name, "uncompressed")


@common.finished
def components(links: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node that each linked node reaches. links: a, b (long).

    found: components of other links, which count too; only what the new links join is gone through.

    In each round every node points to the least of itself and its neighbours, pointers are followed to
    their ends, three times as far in each step, and links are carried over to what their ends point to, where those
    differ. What is left after two rounds are nodes that were the least among all their neighbours' neighbours, half
    of a component at most, so rounds grow with the logarithm of a component's nodes, as do the steps with that of the
    longest chain, whatever the order of ids. A node with very many links is a skewed key of a plain sort-merge
    join, which adaptive execution splits.
    """
    if found is not None:
        fa, fb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        links = links.join(fa, "a", "left").join(fb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = _written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    at = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = _followed(_written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents"))
        if at is None:
            at = parent.withColumnRenamed("parent", "component")
        else:
            moved = at.join(parent, at["component"] == parent["node"], "left")
            at = _written(moved.select(at["node"], F.coalesce("parent", "component").alias("component")), "components")
        a = edges.join(parent, edges["a"] == parent["node"]).select(F.col("parent").alias("pa"), "b")
        b = a.join(parent, a["b"] == parent["node"]).select("pa", F.col("parent").alias("pb"))
        edges = _written(b.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if at is None:
        return found if found is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    if found is None:
        return at
    moved = found.join(at.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
    alone = at.join(found.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("new", "component").alias("component")).unionByName(alone)


def _followed(parent: DataFrame) -> DataFrame:
    """node, parent, the parent being the end of the node's chain of parents."""
    while True:
        second = parent.select(F.col("node").alias("n2"), F.col("parent").alias("p2"))
        third = parent.select(F.col("node").alias("n3"), F.col("parent").alias("p3"))
        far = _written(parent.join(second, parent["parent"] == second["n2"]).join(third, F.col("p2") == F.col("n3")).select("node", "parent", "p2", "p3"), "parents")
        if far.where("p2 <> parent").isEmpty():
            return parent
        parent = far.select("node", F.col("p3").alias("parent"))
