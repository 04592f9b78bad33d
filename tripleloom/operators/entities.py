"""Entity canonicalisation inside partitions that the type forest allows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_label, plain_label
from ..plans.checkpoint import cut
from . import tree
from .adjudicate import adjudicate
from .similarity import components, embed, hashed_embedding, linkage_clusters, similar_pairs

#: Names of a partition that one task merges by itself.
POOL = 4096


def partitions(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities (name, type_id) with the tag and key of their sibling partition."""
    keys = tree.parent_key(nodes, edges).withColumnRenamed("node", "type_id")
    return entities.join(keys, "type_id", "left").withColumns({"tag": F.coalesce("tag", F.lit("self")), "key": F.coalesce("key", "type_id")})


def recursive_partitions(entities: DataFrame, up: DataFrame, largest: int, max_depth: int = 20) -> DataFrame:
    """(name, type_id, bucket): split by the path below the root until buckets are small or can't be split.

    A bucket is a node of the forest; entities of types below it lie in it.
    """
    depth = up.groupBy("node").agg(F.max("depth").alias("height"))
    path = up.join(depth, "node").select(F.col("node").alias("type_id"), F.col("ancestor"), (F.col("height") - F.col("depth")).alias("level"))
    state = entities.join(path.filter("level = 0").select("type_id", F.col("ancestor").alias("bucket")), "type_id", "left").withColumn("bucket", F.coalesce("bucket", "type_id"))
    state = cut(state.select("name", "type_id", "bucket").withColumn("open", F.lit(True)))
    for level in range(1, max_depth + 1):
        size = state.groupBy("bucket").agg(F.count("*").alias("n"))
        down = path.filter(F.col("level") == level).select("type_id", F.col("ancestor").alias("next"))
        tried = state.join(size, "bucket").join(down, "type_id", "left").withColumn("next", F.when(F.col("open") & (F.col("n") > largest), F.coalesce("next", "bucket")).otherwise(F.col("bucket")))
        after = cut(tried.select("name", "type_id", F.col("next").alias("bucket"), (F.col("next") != F.col("bucket")).alias("open")))
        if after.filter("open").isEmpty():
            return after.drop("open")
        state = after
    return state.drop("open")


def merge_names(names: list[str], adjudicator, threshold: float, cap: int, rounds: int) -> dict[str, str]:
    """The canonical label of each name after merging in rounds."""
    at = {n: n for n in names}
    for _ in range(rounds):
        pool = sorted(set(at.values()))
        if len(pool) < 2:
            break
        labels = linkage_clusters(hashed_embedding(pool), threshold)
        moved = {}
        for c in sorted(set(labels)):
            own = [n for n, label in zip(pool, labels) if label == c]
            for k in range(0, len(own), cap):
                for label, group in adjudicate(adjudicator, "entity", own[k : k + cap]):
                    moved |= dict.fromkeys(group, label)
        at = {n: moved[c] for n, c in at.items()}
        if len(set(at.values())) == len(pool):
            break
    return at


def merge_within(entities: DataFrame, keys: list[str], adjudicator, threshold: float = 0.85, cap: int = 40, rounds: int = 5, pool: int = POOL) -> DataFrame:
    """(keys, name, canonical): names merged in rounds inside each partition.

    ``keys`` are the hard gate: names of different partitions never meet.
    Partitions of up to ``pool`` names are merged by a task each, larger ones
    across tasks in the same way.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                at = merge_names(list(row.names), adjudicator, threshold, cap, rounds)
                out += [(*row[: len(keys)], n, c) for n, c in at.items()]
            yield pd.DataFrame(out, columns=[*keys, "name", "canonical"])

    kinds = dict(entities.dtypes)
    part = F.to_json(F.struct(*keys))
    names = cut(entities.filter("name is not null").select(part.alias("part"), *keys, "name").distinct())
    large = cut(names.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > pool).select("part"))
    none = large.isEmpty()
    small = names if none else names.join(large, "part", "left_anti")
    lists = small.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("names"))
    done = lists.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", name string, canonical string")
    return done if none else done.unionByName(_merge_large(names.join(large, "part", "left_semi"), keys, adjudicator, threshold, cap, rounds))


def _merge_large(names: DataFrame, keys: list[str], adjudicator, threshold: float, cap: int, rounds: int) -> DataFrame:
    """``merge_names`` for partitions (part, keys, name) of any size: a partition's pairs and calls are spread over tasks."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(part, m, label) for part, ms in frame[["part", "members"]].itertuples(index=False) for label, group in adjudicate(adjudicator, "entity", list(ms)) for m in group]
            yield pd.DataFrame(out, columns=["part", "canonical", "next"])

    state = cut(names.withColumn("canonical", F.col("name")).withColumn("open", F.lit(True)))
    for _ in range(rounds):
        node = F.concat("part", F.lit("\u001f"), "canonical")
        pool = cut(state.filter("open").select("part", "canonical", node.alias("node")).distinct())
        if pool.isEmpty():
            break
        vectors = embed(pool.select(F.col("canonical").alias("text")), hashed_embedding)
        placed = cut(pool.join(vectors, pool.canonical == vectors.text).select("part", F.col("node").alias("id"), "vec"))
        member = components(similar_pairs(placed, threshold, part="part").select("a", "b"), pool.select("node")).join(pool, "node")
        chunk = F.floor((F.row_number().over(Window.partitionBy("component").orderBy("canonical")) - 1) / cap)
        lists = member.withColumn("chunk", chunk).groupBy("part", "component", "chunk").agg(F.array_sort(F.collect_list("canonical")).alias("members"))
        moved = cut(lists.mapInPandas(ask, "part string, canonical string, next string"))
        left = moved.groupBy("part").agg((F.count_distinct("next") < F.count_distinct("canonical")).alias("shrunk"))
        after = state.join(moved, ["part", "canonical"], "left").join(left, "part", "left")
        state = cut(after.select("part", *keys, "name", F.coalesce("next", "canonical").alias("canonical"), (F.col("open") & F.coalesce("shrunk", F.lit(False))).alias("open")))
    return state.select(*keys, "name", "canonical")


def cross_type_names(entities: DataFrame, up: DataFrame) -> DataFrame:
    """(root, norm_name, types): equal bare names under one root, which are candidates whatever their type."""
    rooted = entities.join(tree.root_of(up).withColumnRenamed("node", "type_id"), "type_id")
    named = rooted.withColumn("norm_name", normalize_label(F.col("name")))
    return named.groupBy("root", "norm_name").agg(F.array_sort(F.collect_set("type_id")).alias("types")).filter("size(types) > 1")


def assign_classes(members: DataFrame, up: DataFrame) -> DataFrame:
    """(entity_id, type_ids, primary_type_id): types of all surface forms and their common ancestor.

    Entities of the same types share it, so it is looked for once for each set of types.
    """
    types = cut(members.groupBy("entity_id").agg(F.array_sort(F.collect_set("type_id")).alias("type_ids")))
    sets = types.select("type_ids").distinct().select("type_ids", F.explode("type_ids").alias("node"))
    shared = cut(tree.lca(sets, up, ["type_ids"]).withColumnRenamed("lca", "primary_type_id"))
    return types.join(shared, "type_ids").select("entity_id", "type_ids", "primary_type_id")


def told_apart(classes: list[tuple[str, str, str]]) -> dict[str, tuple[str, str, str]]:
    """Classes (node, label, type) by a text of their own: the label, with the type where labels are equal."""
    often = Counter(label for _, label, _ in classes)
    out: dict[str, tuple[str, str, str]] = {}
    for node, label, kind in classes:
        text = label if often[label] == 1 else f"{label} [{kind}]"
        k, own = 0, text
        while own in out:
            k += 1
            own = f"{text}#{k}"
        out[own] = (node, label, kind)
    return out


def reconcile(classes: DataFrame, keys: list[str], adjudicator, threshold: float, cap: int, rounds: int = 5) -> DataFrame:
    """(keys, node, into, label, type_id): classes (keys, node, label, type_id) merged inside each partition.

    Equal normal names are candidates whatever their embedding; what is left
    is then merged by embedding, in rounds. ``into`` is the smallest node of
    the merged class, ``type_id`` its smallest type.
    """

    def merge(rows) -> list[tuple[str, str, str, str]]:
        parts = {r["node"]: [r["node"]] for r in rows}

        def joined(group: list[tuple[str, str, str]], label: str, shown: dict) -> tuple[str, str, str]:
            node = min(n for n, _, _ in group)
            parts[node] = [m for n, _, _ in group for m in parts[n]]
            return node, shown[label][1] if label in shown else label, min(kind for _, _, kind in group)

        named: dict[str, list[tuple[str, str, str]]] = {}
        for r in rows:
            named.setdefault(plain_label(r["label"]), []).append((r["node"], r["label"], r["type_id"]))
        left = []
        for same in named.values():
            if len(same) == 1:
                left += same
                continue
            shown = told_apart(same)
            texts = list(shown)
            for k in range(0, len(texts), cap):
                left += [joined([shown[x] for x in own], label, shown) for label, own in adjudicate(adjudicator, "entity", texts[k : k + cap])]
        shown = told_apart(sorted(left))
        groups: dict[str, list[tuple[str, str, str]]] = {}
        for text, label in merge_names(list(shown), adjudicator, threshold, cap, rounds).items():
            groups.setdefault(label, []).append(shown[text])
        final = [joined(group, label, shown) for label, group in groups.items()]
        return [(m, node, label, kind) for node, label, kind in final for m in parts[node]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*row[: len(keys)], *x) for row in frame.itertuples(index=False) for x in merge(row.classes)]
            yield pd.DataFrame(out, columns=[*keys, "node", "into", "label", "type_id"])

    kinds = dict(classes.dtypes)
    lists = classes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "label", "type_id"))).alias("classes"))
    return lists.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", node string, into string, label string, type_id {kinds['type_id']}")


def deduplicate(entities: DataFrame, nodes: DataFrame, edges: DataFrame, adjudicator, threshold: float = 0.85, cap: int = 40) -> DataFrame:
    """(name, type_id, canonical, entity): merged within types, then siblings, then across the types under a root.

    Across types, classes meet within buckets that follow the forest and hold
    ``cap`` where it can split them; the buckets' survivors then meet once more
    under their root. ``entity`` names the final class by its smallest
    (type, canonical) pair, ``canonical`` is its label.
    """
    up = tree.closure(edges, nodes.select("node"))
    first = cut(merge_within(entities, ["type_id"], adjudicator, threshold, cap))
    survivors = first.select("type_id", F.col("canonical").alias("name")).distinct()
    siblings = cut(merge_within(partitions(survivors, nodes, edges), ["tag", "key"], adjudicator, threshold, cap))
    placed = partitions(survivors, nodes, edges).join(siblings, ["tag", "key", "name"]).select("type_id", F.col("name").alias("canonical"), "tag", "key", F.col("canonical").alias("merged"))
    state = cut(first.join(placed, ["type_id", "canonical"]).withColumn("node", F.concat_ws("\u001f", "tag", "key", "merged")))
    classes = state.groupBy("node").agg(F.min("merged").alias("label"), F.min("type_id").alias("type_id"))
    classes = classes.join(tree.root_of(up).withColumnRenamed("node", "type_id"), "type_id", "left").withColumn("root", F.coalesce("root", "type_id"))
    buckets = recursive_partitions(classes.select(F.col("node").alias("name"), "type_id"), up, cap)
    bucketed = classes.join(buckets.select(F.col("name").alias("node"), "bucket"), "node")
    inner = cut(reconcile(bucketed, ["root", "bucket"], adjudicator, threshold, cap))
    met = inner.select("root", F.col("into").alias("node"), "label", "type_id").distinct()
    outer = cut(reconcile(met, ["root"], adjudicator, threshold, cap))
    final = inner.select("node", "into").join(outer.select(F.col("node").alias("into"), F.col("into").alias("entity"), F.col("label").alias("final")), "into")
    return state.join(final, "node").select("name", "type_id", F.col("final").alias("canonical"), "entity")
