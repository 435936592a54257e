"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node reaches; every node of ``edges`` appears.

    Labels move along edges and then jump to their label's label, so rounds grow
    with the logarithm of the longest path.  Each round is written out, which
    keeps lineage short and lets a lost executor's part be read again.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    loops = edges.select(F.col(src).alias("a")).union(edges.select(F.col(dst).alias("a"))).select("a", F.col("a").alias("b"))
    both = written(both.union(both.select("b", "a")).union(loops).distinct(), "edges")
    labels = both.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old"))
        hop = near.select(F.col("a").alias("at"), F.col("low").alias("next"))
        new = written(near.join(hop, near.low == hop["at"]).select(F.col("a").alias("node"), "old", F.least("low", "next").alias("component")), "labels")
        done = new.where("old <> component").isEmpty()
        labels = new.select("node", "component")
        if done:
            return labels
