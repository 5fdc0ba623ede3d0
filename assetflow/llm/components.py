"""Connected components by contraction with random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the smallest node reachable, itself included.

    Every round each node moves to the neighbour (or itself) of least random priority, edges follow,
    and repeated edges and loops go; a constant share of the nodes disappears whatever the graph's shape.
    A node's edges only meet in a minimum, which map tasks take part of, so a node with very many
    links is no hot group.  Rounds are written tables; only whether edges are left reaches the driver.
    Nulls and loops link nothing; an empty table gives an empty one."""
    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    left = written(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    seed = 0
    while not left.isEmpty():
        seed += 1
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("r"), c.alias("id"))
        move = both.groupBy(F.col("e.a").alias("from")).agg(F.min(rank(F.col("e.b"))).alias("m"))
        move = written(move.select("from", F.least(F.col("m"), rank(F.col("from")))["id"].alias("to")), "moves")
        labels = written(
            labels.join(move, labels["label"] == move["from"], "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
        ma, mb = move.toDF("a", "ta"), move.toDF("b", "tb")
        moved = left.join(ma, "a").join(mb, "b").filter("ta <> tb")
        left = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
