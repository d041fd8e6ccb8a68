"""Connected components of an edge table, without gathering a component.

Every node points at its smallest neighbour, pointers are shortened until each
ends at a root, and edges between roots form the next, smaller graph. Chains
shrink geometrically; a hub's edges are only ever combined by aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.storage import Workspace, join_checked

#: Label tables are broadcast up to this number of rows (under 8 MB).
MOST_BROADCAST_ROWS = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is its least node.

    Direction, repetition and self loops don't matter; edges with a null end are
    ignored; without edges the result is empty.
    """
    space = Workspace(edges.sparkSession, "components")
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    labels, step = None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
        roots = space.keep(roots, f"roots{step}")
        jump = 0
        while True:
            further = roots.select(F.col("u").alias("root"), F.col("root").alias("next"))
            jumped = join_checked(roots, further, "root", "inner", MOST_BROADCAST_ROWS).select("u", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = space.keep(jumped, f"jumped{step}_{jump}")
            roots, jump = jumped.select("u", "root"), jump + 1
            if not jumped.where("moved").limit(1).count():
                break
        ends = roots.withColumnRenamed("root", "to")
        if labels is None:
            labels = roots
        else:
            ahead = ends.select(F.col("u").alias("root"), "to")
            moved = join_checked(labels, ahead, "root", "left", MOST_BROADCAST_ROWS)
            labels = space.keep(moved.select("u", F.coalesce("to", "root").alias("root")), f"labels{step}")
        left = join_checked(current, ends, "u", "inner", MOST_BROADCAST_ROWS).select(F.col("to").alias("p"), "v")
        right = ends.select(F.col("u").alias("v"), "to")
        linked = join_checked(left, right, "v", "inner", MOST_BROADCAST_ROWS).select(F.col("p").alias("u"), F.col("to").alias("v")).where("u <> v").distinct()
        current, step = space.keep(linked, f"edges{step}"), step + 1
        if not current.limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("root").alias("component"))
