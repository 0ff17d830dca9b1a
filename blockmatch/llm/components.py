"""Connected components of an undirected graph, as DataFrames.

Every node takes the smallest label among its own and its neighbours', then the
label of its label, until nothing changes; the second step halves the distance
to the root each time, so the number of rounds grows with the logarithm of a
component's diameter.  Each round is written to the shared folder.  Nothing but
the question whether a label changed comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmatch.storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes of ``edges`` (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("r_node"), F.col("label").alias("r_label"))
        labels = own.join(root, F.col("label") == F.col("r_node")).select("node", F.least("label", "r_label").alias("label"), (F.least("label", "r_label") != F.col("old")).alias("changed"))
        labels = materialise(labels, "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
