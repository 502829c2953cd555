"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round, a node and its present root take the smallest root among the node's neighbours;
    then every node takes its root's root.  The rounds grow with the logarithm of the longest
    path.  Loops, repeated edges and edges with a null end do no harm.  Each round is written, so
    that a lost executor costs one round at most; the joins have written tables on both sides, so
    that AQE can split a hub's edges.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = stored(known.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                 F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")), "labels")
    while True:
        near = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("label").alias("near"))
        offered = labels.join(near, labels["node"] == near["v"]).select("node", "label", F.least("label", "near").alias("best"))
        pairs = offered.select(F.explode(F.array(F.struct("node", "best"), F.struct(F.col("label").alias("node"), "best"))).alias("x"))
        hooked = stored(pairs.groupBy("x.node").agg(F.min("x.best").alias("label")), "labels")
        roots = hooked.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = stored(hooked.join(roots, hooked["label"] == roots["root"]).select("node", F.col("above").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("old"))
        changed = not jumped.join(old, "node").where("label != old").isEmpty()
        dropped(labels, hooked)
        labels = jumped
        if not changed:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))
