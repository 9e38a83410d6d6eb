"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import mark, removed, written


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for all nodes of `edges(a, b)`; a component's name is its smallest node.

    Labels only fall: each round takes the least label of the neighbours, then the label of the label, so
    long chains halve. Every round is written to the shared folder, and the driver sees one sum a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    last, begun = None, mark() - 1
    while True:
        removed(edges.sparkSession, begun, keep=1)  # labels of earlier rounds
        now = tuple(labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first())
        if now == last or not now[1]:
            return labels
        last = now
        told = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(told, "node").select("node", F.least("component", "m").alias("component"))
        names = labels.join(told, "node").select(F.col("node").alias("component"), F.least("component", "m").alias("root"))
        labels = written(least.join(names, "component").select("node", F.col("root").alias("component")), "labels")
