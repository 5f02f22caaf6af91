"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(a, b)`` edges -> ``(node, label)``, label = smallest node of the component.

    ``edges`` are read in every round, so they should be a written table.  Every round takes the smallest label among a node's neighbours, then the
    label of that label; each round is written to the shared folder.  The
    rounds needed grow with the logarithm of the longest path for star-like
    edge sets.  Isolated nodes don't appear.  An empty edge table gives an
    empty result.
    """
    # repeated edges change no minimum, so they needn't be found
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(
            step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels"
        )
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
