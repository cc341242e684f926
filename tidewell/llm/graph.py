"""Connected components over edge tables, by repeated joins: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import drop, stash


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node, component`` (smallest node reachable) for every node of ``edges(a, b)``; isolated nodes don't occur.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks for a few steps and contracts the edges
    to what is still apart, so the edges shrink from round to round and a chain of n nodes takes about log n rounds. Nulls
    in edges are ignored, loops and repeated edges change nothing, and no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    live = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = stash(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not live.isEmpty():
        hooks = live.groupBy("b").agg(F.min("a").alias("to"))
        for _ in range(3):  # a hook's own target may be hooked further; chains always lead down
            onward = hooks.select(F.col("b").alias("to"), F.col("to").alias("next"))
            old, hooks = hooks, stash(hooks.join(onward, "to", "left").select("b", F.coalesce("next", "to").alias("to")), "hooks")
            drop(old)
        old, label = label, stash(label.join(hooks, label.component == hooks.b, "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        drop(old)
        ends = live
        for side in "ab":
            moved = hooks.select(F.col("b").alias(side), F.col("to").alias("to_" + side))
            ends = ends.join(moved, side, "left")
        ends = ends.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).where("x <> y")
        old, live = live, stash(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(old, hooks)
    drop(live)
    return label


def merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``label``, as ``components`` gives it, with more ``edges(a, b)``: only what they bring together is worked on."""
    for side in "ab":
        edges = edges.join(label.toDF(side, f"of_{side}"), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    more = components(edges.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    to = more.toDF("old", "new")
    moved = label.join(to, label.component == to.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    out = stash(moved.unionByName(more.join(label, "node", "left_anti")), "labels")
    drop(label, more)
    return out
