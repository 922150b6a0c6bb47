"""Connected components of a graph of links: trees whose roots are hooked to smaller labels around them, and that are made shallower as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import remove, written


def components(edges: DataFrame, root: str) -> DataFrame:
    """(id, component) of every end of edges (a, b); component is the least id that can be reached.

    Every node has a parent, at first the least of itself and its neighbours, and knows its parent's parent. In each round it takes the least of its
    neighbours' grandparents (summed up before they shuffle), writes that to its parent as well, so whole trees are hooked, and goes to its grandparent if that is
    less. The ways to the roots of long paths halve in each round: paths of 1,000 nodes, whatever the order of their ids, end within 20 rounds (tested).
    Labels are written in each round, so lineage stays short.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{root}/edges")

    def grown(parents: DataFrame, path: str) -> DataFrame:
        """parents (id, parent, was) with the parents' parents, and whether those are new; was is the grandparent before."""
        above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
        return written(parents.join(above, "parent").select("id", "parent", "top", F.coalesce(F.col("top") != F.col("was"), F.lit(True)).alias("moved")), path)

    first = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("parent"), F.lit(None).cast("long").alias("was"))
    path, turn = f"{root}/labels0", 0
    labels = grown(written(first, f"{root}/parents0"), path)
    remove(spark, f"{root}/parents0")
    while labels.where("moved").limit(1).count():
        turn += 1
        near = both.join(labels.select(F.col("id").alias("b"), "top"), "b").groupBy(F.col("a").alias("id")).agg(F.min("top").alias("least"))
        met = labels.select("id", "parent", "top").join(near, "id")
        own, up = F.struct("id", F.least("parent", "top", "least").alias("new"), F.col("top").alias("was")), F.struct(F.col("parent").alias("id"), F.col("least").alias("new"), F.lit(None).cast("long").alias("was"))
        told = met.select(F.explode(F.array(own, up)).alias("t")).groupBy("t.id").agg(F.min("t.new").alias("parent"), F.max("t.was").alias("was"))
        parents = written(told, f"{root}/parents{turn}")
        old, path = path, f"{root}/labels{turn}"
        labels = grown(parents, path)
        remove(spark, old)
        remove(spark, f"{root}/parents{turn}")
    return labels.select("id", F.col("top").alias("component"))
