"""Connected components of an edge table, and union-find for driver-side metadata."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir``, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="loomlog-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges(u, v)``; root is the smallest node reachable.

    Each round hangs every node on the least node it sees, then on what that
    one hangs on; rounds grow with the logarithm of a component's size.  Minima
    are taken before the shuffle, so a node with very many edges costs no more
    than one row for each task.
    """
    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while True:
        at = e.join(labels.toDF("u", "ru"), "u").join(labels.toDF("v", "rv"), "v").where("ru <> rv").select(F.least("ru", "rv").alias("low"), F.greatest("ru", "rv").alias("high")).distinct()
        at = cut(at)
        if at.isEmpty():
            return labels
        # every root takes the least root next to it, then that one's choice, until choices stand still
        hop = cut(at.groupBy(F.col("high").alias("root")).agg(F.min("low").alias("to")))
        while True:
            onward = hop.alias("a").join(hop.select(F.col("root").alias("to"), F.col("to").alias("next")), "to", "left")
            moved = cut(onward.select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hop = moved.select("root", "to")
            if moved.where("moved").isEmpty():
                break
        labels = cut(labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def union_find(pairs) -> dict:
    """member -> least member of its class, for metadata that the driver holds."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}
