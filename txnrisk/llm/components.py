"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.shared import forget, written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node it is joined to) for each node of an edge.

    Each round hands every node the least label among its neighbours and then the label of that label, so labels travel in
    leaps and a chain needs a number of rounds that grows with the logarithm of its length. Labels and edges stay in Spark.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = written(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        least = labels.select("node", "component").join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        least = written(least)
        leap = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = written(least.join(leap, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        forget(least, labels)
        if after.filter("component != was").isEmpty():
            forget(both)
            return after.select("node", "component")
        labels = after
