"""Connected components of large graphs, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for each vertex of ``edges`` (a, b): the least vertex that it reaches.

    Each round takes the least label among a vertex and its neighbours and then the label of that label. Every round's labels
    are written, so lost executors cost no more than that round. Loops and repeated edges change nothing.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).where("v <> u").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("v").agg(F.least("v", F.min("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "u"}), "u").groupBy("v").agg(F.min("c").alias("near"))
        new = labels.join(near, "v").select("v", F.least("c", "near").alias("m"), F.col("c").alias("was"))
        jumped = new.join(labels.select(F.col("v").alias("m"), F.col("c").alias("over")), "m", "left").select("v", F.least("m", F.coalesce("over", "m")).alias("c"), "was")
        after = written(jumped, "labels")
        moved = after.where("c <> was").limit(1).count()
        discard(labels)
        labels = after.drop("was")
        if not moved:
            return labels.withColumnRenamed("c", "component")
