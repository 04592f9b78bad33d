"""Single-parent forests: closure, common ancestors, metrics and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoint import cut


def closure(edges: DataFrame, nodes: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, ancestor, depth) with depth 0 for the node itself, along edges (child, parent).

    Steps double: after r rounds paths of 2**r edges are known. A malformed
    cycle ends after every node of it has been met once.
    """
    every = nodes.select("node").unionAll(edges.select(F.col("child").alias("node"))).unionAll(edges.select("parent")).distinct()
    single = edges.groupBy("child").agg(F.min("parent").alias("parent")).filter("child <> parent")
    known = every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    known = known.unionAll(single.select("child", "parent", F.lit(1)))
    reach, count = 1, None
    known = cut(known)
    while reach < max_depth:
        longest = known.filter(F.col("depth") == reach)
        onward = known.filter("depth > 0").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        added = longest.join(onward, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = cut(known.unionAll(added).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        now = known.count()
        if now == count:
            break
        reach, count = reach * 2, now
    return known


def lca(members: DataFrame, up: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest common ancestor of each key's members (keys, node); null if they share none."""
    members = members.select(*keys, "node").distinct()
    size = members.groupBy(*keys).agg(F.count("*").alias("n"), F.min("node").alias("any"))
    met = members.join(up, "node").groupBy(*keys, "ancestor").agg(F.count("*").alias("m"), F.min(F.struct("node", "depth")).alias("d"))
    common = met.join(size, keys).filter("m = n")
    best = common.groupBy(*keys).agg(F.min_by("ancestor", F.struct("d.depth", "ancestor")).alias("lca"))
    return size.select(*keys).join(best, keys, "left")


def root_of(up: DataFrame) -> DataFrame:
    """(node, root): the last ancestor."""
    return up.groupBy("node").agg(F.max_by("ancestor", "depth").alias("root"))


def ancestor_paths(up: DataFrame) -> DataFrame:
    """(node, path): from the node to its root."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"])
    return up.groupBy("node").agg(path.alias("path"))


def parent_key(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, tag, key): ("parent", its parent), or ("self", the node) for roots, so that the two never meet."""
    found = nodes.join(edges.select(F.col("child").alias("node"), "parent"), "node", "left")
    return found.select("node", F.when(F.col("parent").isNull(), "self").otherwise("parent").alias("tag"), F.coalesce("parent", "node").alias("key"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and parents that are nobody's child."""
    every = nodes.select("node").unionAll(edges.select(F.col("parent").alias("node"))).distinct()
    return every.join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(parent, children)."""
    return edges.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def subtree(up: DataFrame, node: str | Column) -> DataFrame:
    at = F.lit(node) if isinstance(node, str) else node
    return up.filter(F.col("ancestor") == at).select("node")


def subclass_labels(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(node, subclasses): labels of the first k children placed under each node; ``edges`` has pos, the order of placing."""
    first = edges.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("pos", "child"))).filter(F.col("n") <= k)
    named = first.join(labels.select(F.col("node").alias("child"), "label"), "child", "left")
    listed = F.array_sort(F.collect_list(F.struct("n", F.coalesce("label", "child").alias("label"))))
    return named.groupBy(F.col("parent").alias("node")).agg(F.transform(listed, lambda x: x["label"]).alias("subclasses"))


def examples(mentions: DataFrame, k: int) -> DataFrame:
    """The k shortest distinct names of each type (type_id, name), ties by text."""
    rank = F.row_number().over(Window.partitionBy("type_id").orderBy(F.length("name"), "name"))
    return mentions.select("type_id", "name").distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


def support_split(types: DataFrame, min_support: int) -> DataFrame:
    """Types (node, n) with ``deferred``: rarer than the support asks, if it asks for more than 1."""
    return types.withColumn("deferred", (F.col("n") < min_support) & F.lit(min_support > 1))


def metrics(nodes: DataFrame, edges: DataFrame, up: DataFrame, synthesized: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, roots, orphans (roots without children), orphan_rate, max_depth, mean_depth.

    ``synthesized`` (node) and ``unresolved`` (anchor, node) add their counts.
    """
    deep = up.groupBy("node").agg(F.max("depth").alias("depth"))
    facts = deep.join(edges.select(F.col("parent").alias("node")).distinct().withColumn("has", F.lit(True)), "node", "left")
    root = F.col("depth") == 0
    orphan = root & F.col("has").isNull()
    out = facts.agg(
        F.count("*").alias("nodes"), F.count_if(root).alias("roots"), F.count_if(orphan).alias("orphans"),
        F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("mean_depth"),
        F.round(F.avg(F.when(orphan, 1.0).otherwise(0.0)), 4).alias("orphan_rate"),
    )
    out = out.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    for name, rows in (("synthesized", synthesized), ("unresolved", unresolved)):
        if rows is not None:
            out = out.join(F.broadcast(rows.agg(F.count_distinct(*rows.columns).alias(name))))
    return out


def collapse_duplicate(edges: DataFrame, survivor: str, loser: str) -> DataFrame:
    """The loser's children go to the survivor; its parent edge too unless the survivor has one."""
    child, parent = (F.when(F.col(c) == loser, survivor).otherwise(F.col(c)) for c in ("child", "parent"))
    moved = edges.select(child.alias("child"), parent.alias("parent"), (F.col("child") == loser).cast("int").alias("late")).filter("child <> parent")
    return moved.groupBy("child").agg(F.min(F.struct("late", "parent")).alias("b")).select("child", "b.parent")


def reparent(edges: DataFrame, child: str, parent: str | None) -> DataFrame:
    kept = edges.select("child", "parent").filter(F.col("child") != child)
    if parent is None:
        return kept
    return kept.unionAll(edges.sparkSession.range(1).select(F.lit(child).alias("child"), F.lit(parent).alias("parent")))


def would_cycle(up: DataFrame, child: str, parent: str) -> bool:
    """Whether ``parent`` lies at or below ``child``."""
    return child == parent or not up.filter((F.col("node") == parent) & (F.col("ancestor") == child)).isEmpty()


def refused_moves(moves: DataFrame, up: DataFrame) -> DataFrame:
    """The moves (child, parent) that would make a cycle: ``parent`` lies at or below ``child``."""
    below = up.select(F.col("ancestor").alias("child"), F.col("node").alias("parent")).distinct()
    asked = moves.select("child", "parent").distinct()
    return asked.filter("child = parent").unionAll(asked.filter("child <> parent").join(below, ["child", "parent"], "left_semi"))


def fold_types(items: DataFrame, to_id: DataFrame, minted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add minted types (type_id, label, pos): ids that are new, labels that nobody holds, first wins."""
    new = minted.groupBy("type_id").agg(F.min_by("label", "pos").alias("label"))
    new = new.join(items.select(F.col("item_id").alias("type_id")), "type_id", "left_anti")
    claim = minted.groupBy("label").agg(F.min_by("type_id", "pos").alias("type_id"))
    claim = claim.join(to_id.select(F.col("surface").alias("label")), "label", "left_anti")
    both = items.select("item_id", "canonical_label").unionAll(new.select("type_id", "label"))
    return both, to_id.select("surface", "item_id").unionAll(claim.select("label", "type_id"))


def aggregates(nodes: DataFrame, edges: DataFrame, up: DataFrame) -> DataFrame:
    """(node, own, total, leaves): own count ``n``, sum over the subtree, leaves below (a leaf is one)."""
    leaf = nodes.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(1).alias("leaf"))
    known = nodes.join(leaf, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    sums = up.join(known, "node").groupBy(F.col("ancestor").alias("at")).agg(F.sum("n").alias("total"), F.sum("leaf").alias("leaves"))
    return nodes.join(sums, nodes.node == sums["at"]).select("node", F.col("n").alias("own"), "total", "leaves")


def view_rows(sums: DataFrame, nodes: DataFrame, edges: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """Rows of a drawn tree: (node, parent, label, total, leaves, score, is_seed, is_synth, surfaces, place).

    ``sums`` come from ``aggregates``; ``edges`` may have a score; ``names`` has
    node, label, surfaces, is_seed, is_synth. Siblings, and roots among
    themselves, are placed by most leaves, then by node. At most ``most``
    surface forms other than the label are shown.
    """
    score = F.round(F.col("score"), 2) if "score" in edges.columns else F.lit(None).cast("double")
    up_one = edges.select(F.col("child").alias("node"), "parent", score.alias("score"))
    full = nodes.select("node").join(sums.select("node", "total", "leaves"), "node", "left").join(up_one, "node", "left").join(names, "node", "left")
    others = F.slice(F.filter(F.coalesce("surfaces", F.array().cast("array<string>")), lambda x: ~x.eqNullSafe(F.col("label"))), 1, most)
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("leaves"), "node"))
    full = full.withColumn("label", F.coalesce("label", "node"))
    return full.select("node", "parent", "label", "total", "leaves", "score", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), F.coalesce("is_synth", F.lit(False)).alias("is_synth"), others.alias("surfaces"), place.alias("place"))


def nearest_selected(up: DataFrame, selected: DataFrame) -> DataFrame:
    """(node, group): the nearest ancestor, or the node itself, that is selected; null without one."""
    near = up.join(selected.select(F.col("node").alias("ancestor")), "ancestor").groupBy("node").agg(F.min_by("ancestor", "depth").alias("group"))
    return up.select("node").distinct().join(near, "node", "left")


# What-if edits: each returns a new edge table and leaves its input alone.


def sandbox_reparent(edges: DataFrame, up: DataFrame, child: str, parent: str | None) -> tuple[DataFrame, str]:
    """(edges, reason); an empty reason means that the move was made."""
    now = edges.filter(F.col("child") == child).select("parent").first()
    if (now[0] if now else None) == parent:
        return edges, "no change"
    if parent is not None and would_cycle(up, child, parent):
        return edges, "the move would make a cycle"
    return reparent(edges, child, parent), ""


def delete_subtree(nodes: DataFrame, edges: DataFrame, up: DataFrame, node: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, deleted) without the node and all below it."""
    if nodes.filter(F.col("node") == node).isEmpty():
        raise ValueError(f"unknown node {node}")
    gone = subtree(up, node)
    left = nodes.join(gone, "node", "left_anti")
    kept = edges.join(gone.withColumnRenamed("node", "child"), "child", "left_anti")
    return left, kept, gone


def delete_impact(entity_types: DataFrame, deleted: DataFrame, up: DataFrame) -> DataFrame:
    """(entity_id, effect, new_type): entities (entity_id, type_id) that lose types.

    Losing all, an entity goes to the nearest ancestor that stays (null without
    one); losing some, it is narrowed.
    """
    gone = deleted.select(F.col("node").alias("type_id"), F.lit(True).alias("gone"))
    stay = up.join(deleted.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
    # What stays nearest is settled for each type, so entities are gathered once.
    near = stay.groupBy(F.col("node").alias("type_id")).agg(F.min(F.struct("depth", "ancestor")).alias("near"))
    marked = entity_types.join(gone, "type_id", "left").join(near, "type_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    state = marked.groupBy("entity_id").agg(F.bool_and("gone").alias("all_gone"), F.bool_or("gone").alias("some_gone"), F.min("near").alias("near")).filter("some_gone")
    return state.select("entity_id", F.when(F.col("all_gone"), "reassigned").otherwise("narrowed").alias("effect"), F.when(F.col("all_gone"), F.col("near.ancestor")).alias("new_type"))


def affected_types(up: DataFrame, edges: DataFrame, moved: str, destination: str | None) -> DataFrame:
    """The moved subtree, its ancestors, the destination with its ancestors and its present children."""
    out = subtree(up, moved).unionAll(up.filter(F.col("node") == moved).select("ancestor"))
    if destination is not None:
        out = out.unionAll(up.filter(F.col("node") == destination).select("ancestor"))
        out = out.unionAll(edges.filter(F.col("parent") == destination).select("child"))
    return out.distinct()


def newly_together(old_keys: DataFrame, new_keys: DataFrame, affected: DataFrame) -> DataFrame:
    """(type_a, type_b): types that share a partition now and did not before, at least one of them affected."""

    def together(keys: DataFrame) -> DataFrame:
        at = keys.select("node", F.struct("tag", "key").alias("k"))
        return at.alias("x").join(at.alias("y"), F.col("x.k") == F.col("y.k")).filter("x.node < y.node").select(F.col("x.node").alias("type_a"), F.col("y.node").alias("type_b"))

    fresh = together(new_keys).join(together(old_keys), ["type_a", "type_b"], "left_anti")
    touched = affected.select("node")
    marked = fresh.join(touched.select(F.col("node").alias("type_a"), F.lit(1).alias("ta")), "type_a", "left").join(touched.select(F.col("node").alias("type_b"), F.lit(1).alias("tb")), "type_b", "left")
    return marked.filter("ta = 1 or tb = 1").select("type_a", "type_b")


def new_merge_pairs(entities: DataFrame, old_keys: DataFrame, new_keys: DataFrame, affected: DataFrame) -> DataFrame:
    """Pairs of types with entities that share a parent key now and did not before: (type_a, type_b, pairs).

    Counted from the types' sizes; entity pairs are never enumerated.
    """
    sizes = entities.groupBy(F.col("type_id").alias("node")).agg(F.count_distinct("entity_id").alias("n"))
    fresh = newly_together(old_keys, new_keys, affected)
    return fresh.join(sizes.withColumnsRenamed({"node": "type_a", "n": "na"}), "type_a").join(sizes.withColumnsRenamed({"node": "type_b", "n": "nb"}), "type_b").select("type_a", "type_b", (F.col("na") * F.col("nb")).alias("pairs"))
