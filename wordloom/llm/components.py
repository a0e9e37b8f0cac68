"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for each end of an edge (``a``, ``b``);
    ``component`` is the smallest node reachable.

    Each round moves every node to its smallest neighbour and contracts the
    edges; stars vanish in one round and chains shrink at least by half.
    Edges and labels are written to the shared folder in each round and never
    reach the driver.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = materialize(both.groupBy(F.col("a").alias("from")).agg(F.least(F.col("from"), F.min("b")).alias("to")), "moved")
        if labels is None:
            labels = moved.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(moved, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        start, end = moved.select(F.col("from").alias("a"), F.col("to").alias("x")), moved.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(start, "a").join(end, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
