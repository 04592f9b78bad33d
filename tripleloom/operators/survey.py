"""Surveying a class hierarchy for seed roots, over edges (child, parent) and instances (item, class)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoint import cut


def capped_count(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, n): rows of each key, counted up to ``cap``."""
    return rows.groupBy(key).agg(F.least(F.count("*"), F.lit(cap)).alias("n"))


def root_candidates(edges: DataFrame, instances: DataFrame, top: str, cap: int) -> DataFrame:
    """Direct children of ``top`` that have subclasses, with capped counts."""
    children = edges.filter(F.col("parent") == top).select(F.col("child").alias("node")).distinct()
    sub = capped_count(edges.withColumnRenamed("parent", "node"), "node", cap).withColumnRenamed("n", "subclasses")
    inst = capped_count(instances.withColumnRenamed("class", "node"), "node", cap).withColumnRenamed("n", "instances")
    return children.join(sub, "node").join(inst, "node", "left").select("node", "subclasses", F.coalesce("instances", F.lit(0)).alias("instances"))


def children_top_k(edges: DataFrame, k: int) -> DataFrame:
    """(parent, child, subclasses, rank): each parent's children with most subclasses, ties by name."""
    sub = edges.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("subclasses"))
    found = edges.join(sub, "child", "left").withColumn("subclasses", F.coalesce("subclasses", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("subclasses"), "child"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def seed_tree(edges: DataFrame, seeds: DataFrame, max_depth: int, top_k: int | None = None, target_n: int | None = None) -> DataFrame:
    """(node, parent, depth) breadth first from seeds (node); the first and then smallest parent wins.

    With ``top_k`` a node is expanded to its children with most subclasses.
    With ``target_n`` the walk ends once there are so many nodes: seeds and
    nodes of a level are taken in the order of their parents, then of their
    places among the children, and a node belongs to the parent that comes first.
    """
    start = seeds.select("node").distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    ranked = edges.select("child", "parent", F.lit(0).alias("rank")) if top_k is None else children_top_k(edges, top_k).select("child", "parent", "rank")
    if target_n is None:
        seen = cut(start.withColumn("pos", F.lit(0)))
    else:
        # At most target_n rows are ever ordered as a whole.
        first = start.orderBy("node").limit(target_n)
        seen = cut(first.withColumn("pos", F.row_number().over(Window.orderBy("node"))))
    for depth in range(1, max_depth + 1):
        room = None if target_n is None else target_n - seen.count()
        if room is not None and room <= 0:
            break
        edge = seen.filter(F.col("depth") == depth - 1).select(F.col("node").alias("parent"), F.col("pos").alias("above"))
        by = F.struct("above", "rank", "parent") if target_n is not None else F.struct("parent", F.lit(0).alias("above"), "rank")
        new = ranked.join(edge, "parent").groupBy(F.col("child").alias("node")).agg(F.min(by).alias("by")).join(seen, "node", "left_anti")
        new = new.select("node", "by.parent", F.lit(depth).alias("depth"), "by.above", "by.rank")
        if room is None:
            new = new.withColumn("pos", F.lit(0))
        else:
            order = ("above", "rank", "node")
            new = new.orderBy(*order).limit(room).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
        after = cut(seen.unionByName(new.drop("above", "rank")))
        if after.filter(F.col("depth") == depth).isEmpty():
            break
        seen = after
    return seen.drop("pos")


def class_like_instances(instances: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Instances that have subclasses themselves, the k with most."""
    sub = edges.groupBy(F.col("parent").alias("item")).agg(F.count("*").alias("subclasses"))
    found = instances.join(sub, "item").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("subclasses"), "item")))
    return found.filter(F.col("rank") <= k)


def expand_accepted(present: DataFrame, accepted: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes to add: accepted roots and their children that are not present."""
    fresh = accepted.select("node").union(edges.join(accepted.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"))).distinct()
    return fresh.join(present.select("node"), "node", "left_anti")
