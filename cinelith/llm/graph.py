"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for every id in edges (a, b).

    Every round a label becomes the least of its neighbours' labels, then the
    label of that label; rounds grow with the logarithm of the longest path.
    Labels are written each round, so lineage stays short.  A hub's edges are
    reduced by a partial minimum before they are shuffled.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        parent = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        after = materialize(lower.join(parent, "label").select("id", "was", F.least("label", "above").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.where("was <> label").isEmpty():
            return labels
