"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: Every so many rounds labels jump to their label's label, so that long paths halve; short ones end before that.
JUMP_EVERY = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it can reach.

    Each round sends labels along the edges and keeps a node's smallest: one join and one pre-aggregated minimum.
    A hot node is an ordinary skewed join; nothing is collected but whether a label changed.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    held = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    turn = 0
    while True:
        turn += 1
        sent = both.join(held, both.u == held.node).select(F.col("v").alias("node"), "label", F.lit(None).cast(held.schema["node"].dataType).alias("old"))
        every = sent.unionByName(held.withColumn("old", F.col("label")))
        new = every.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        if turn % JUMP_EVERY == 0:
            up = held.select(F.col("node").alias("m"), F.col("label").alias("top"))
            new = new.join(up, new.label == up.m).select("node", F.least("label", "top").alias("label"), "old")
        new = cut(new, "labels")
        if not new.filter("label < old").limit(1).count():
            return new.select("node", "label")
        held = new.select("node", "label")
