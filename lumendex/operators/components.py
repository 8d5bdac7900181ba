"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable from every id in edges (a, b).

    Each round takes the least label around a vertex and then that label's own
    label; labels only fall, and the rounds are logarithmic in the longest path.
    Every round is a written table, so the plan stays short and a lost executor
    costs one round.  Self-loops make isolated vertices appear.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "components-edges")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "components")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        step = saved(step.join(roots, "label").select("id", "old", F.least("label", "root").alias("label")), "components")
        labels = step.select("id", "label")
        if step.filter("label <> old").isEmpty():
            return labels
