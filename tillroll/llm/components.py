"""Connected components of a link table, by least label with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (least node) for links (u, v).

    Each round takes the least label around a node and then that label's own
    label; rounds are written tables, so lineage stays short and survives lost
    executors.  The number of rounds grows with the logarithm of the longest
    chain.  Sums over a node's links are combined before the shuffle.
    """
    both = written(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
                   "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = written(stepped.join(jump, "next").select("node", F.col("label").alias("old"),
                                                          F.least("next", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
