"""Connected components of a large sparse graph, by DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, heavy_light_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that can be reached.

    Rounds of hooking and pointer jumping: every node takes the smallest label among its own and its neighbours', then
    the label of its label, until none changes.  Labels are written to the shared folder each round, so that a lost executor costs one
    round at most.  Minima are combined before they are shuffled.  A hub's neighbours and a large component's members aren't
    brought together: labels of both are broadcast, of which there are few.  Rounds grow with the logarithm of the longest chain.
    """
    name = f"components-{uuid.uuid4().hex}"
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"), F.count(F.lit(1)).alias("degree")), f"{name}-labels-0")
    nodes, links = (int(x or 0) for x in labels.agg(F.count("node"), F.sum("degree")).first())
    k = 0
    while True:
        k += 1
        near = heavy_light_join(both, labels.withColumnRenamed("node", "b"), "b", "degree", links, F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = scratch.table(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"), "degree"), f"{name}-hooked")
        # A label's own label: roots are nodes too.
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next")).join(hooked.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")
        new = heavy_light_join(hooked, jump, "root", "members", nodes, F.col("node")).select("node", F.least("root", "next").alias("root"), "degree", "was")
        new = scratch.table(new, f"{name}-labels-{k}")
        changed = not new.where("root <> was").isEmpty()
        scratch.drop(f"{name}-labels-{k - 1}", f"{name}-hooked")
        labels = new.select("node", "root", "degree")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels.select("node", "root")
