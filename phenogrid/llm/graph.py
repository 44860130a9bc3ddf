"""Connected components of a link table, with nothing of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import stored


def _pointed(pairs: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace a node by its parent where it has one."""
    lookup = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    return pairs.join(lookup, pairs[column] == F.col("__node"), "left").withColumn(column, F.coalesce("__parent", column)).drop("__node", "__parent")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in ``links`` (columns a, b of type long).

    Each round hooks every node to its smallest smaller neighbour, shortens the pointers by doubling, and contracts the
    links to what still joins different roots. Rounds grow with the logarithm of the longest path.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        parents = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        while True:
            further = stored(_pointed(parents.withColumn("was", F.col("parent")), "parent", parents), "parents")
            done = further.where("was <> parent").isEmpty()
            parents = further.drop("was")
            if done:
                break
        labels = stored(_pointed(labels, "component", parents), "labels")
        edges = _pointed(_pointed(edges, "a", parents), "b", parents)
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    return labels
