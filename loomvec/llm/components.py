"""Connected components of a link table by contraction to smallest neighbours.

In a round every vertex with a smaller neighbour takes its smallest one as
parent, an aggregation with a map-side combine; pointer jumping brings each
vertex to its tree's root, and the links between different roots are the next
round's table. Joins have one side that is unique by key, so a vertex with a
third of all links is split by the planner's skew handling and never gathered.
Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.session import materialize


def _jump(parents: DataFrame) -> DataFrame:
    """(id, root): parents followed to the end; paths halve with every step."""
    while True:
        up = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
        found = materialize(parents.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jump", small=True)
        parents = found.select("id", "root")
        if not found.where("moved").limit(1).count():
            return parents


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v) but those that are their component's smallest.

    ``component`` is the smallest vertex of the component. Loops and repeated
    links don't matter; no links, no rows.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links", small=True)
    labels = None
    for _ in range(rounds):
        if not edges.limit(1).count():
            break
        roots = _jump(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root")))
        if labels is None:
            labels = roots
        else:
            to = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
            labels = labels.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root")).unionByName(roots)
        ends = edges
        for side in ("u", "v"):
            ends = ends.join(roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        edges = materialize(ends.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links", small=True)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return materialize(labels.select("id", F.col("root").alias("component")), "components", small=True)
