"""Connected components of an edge table, as a loop of joins with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.llm.store import drop, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id that has an edge (a, b); component is the smallest id that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label. Long paths get shorter by
    the jump, about by half a round; at worst a round still moves a label by one edge. Labels are written to the shared
    folder each round and the ones before are deleted; nothing comes to the driver but whether a label changed. No edges
    give no rows. Raises if max_rounds don't suffice.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select("id", "component"), both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.select("id", "component").join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = lower.join(up, "component", "left").select("id", F.least("component", "up").alias("component"), "old")
        now = materialize(jumped, "labels")
        settled = now.where("component <> old").isEmpty()
        drop(labels)
        if settled:
            drop(both)
            return now.select("id", "component")
        labels = now
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
