"""Connected components of a links table, by least labels with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (least node that it is linked with, through others too) for every node of links (a, b: long)."""
    links = links.filter("a <> b").select("a", "b")
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    # A first label comes with the edges: the least neighbour.
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = written(lower.join(far, "comp").select("node", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.filter("comp <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
