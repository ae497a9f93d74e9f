"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, release


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for nodes with any link.

    Every round hooks each node's label to the smallest label among its neighbours and then follows labels one step further, so long chains
    shrink by half or more. Sums are combined before the shuffle and each round is written to the shared folder.
    """
    edges = links.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        # Besides the node itself, the node that labelled it takes the smaller label over, which joins whole trees at once.
        roots = hooked.where("next < component").groupBy("component").agg(F.min("next").alias("root_next")).withColumnRenamed("component", "root")
        moved = hooked.join(roots, F.col("node") == F.col("root"), "left").select("node", "component", F.least("next", F.coalesce("root_next", "next")).alias("next"))
        moved = materialize(moved, "labels")
        target = moved.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        jumped = materialize(
            moved.join(target, F.col("next") == F.col("via"), "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("beyond", "next")).alias("component")), "labels"
        )
        changed = jumped.where("old != component").limit(1).count()
        release(labels, moved)
        labels = jumped.select("node", "component")
        labels.quarry_path = jumped.quarry_path
        if not changed:
            release(edges)
            return labels
    raise RuntimeError("components did not settle")
