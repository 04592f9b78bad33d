"""What-if sessions: replaying edits of the forest, carrying deletions on, merging again where edits reach, saving."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import cut
from ..sources.runs import Runs
from . import tree
from .entities import merge_within, partitions
from .similarity import embed, hashed_embedding, similar_pairs


@dataclass(frozen=True)
class Edit:
    """A step of a session: ``node`` moved below ``parent`` (none: made a root), or deleted with all below it."""

    op: str
    node: str
    parent: str | None = None


def replay(nodes: DataFrame, edges: DataFrame, log: list[Edit], upto: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, deleted) after the first ``upto`` edits of the log, all of them if not given.

    Undo replays one edit less, reset none. A refused move changes nothing. The
    log is what a person has typed, so the edits are applied one by one.
    """
    nodes, edges = nodes.select("node"), edges.select("child", "parent")
    deleted = nodes.filter(F.lit(False))
    for edit in log[:upto]:
        up = tree.closure(edges, nodes)
        if edit.op == "move":
            edges, _ = tree.sandbox_reparent(edges, up, edit.node, edit.parent)
        elif edit.op == "delete":
            nodes, edges, gone = tree.delete_subtree(nodes, edges, up, edit.node)
            deleted = cut(deleted.unionAll(gone.select("node")))
        else:
            raise ValueError(f"unknown edit {edit.op!r}")
        nodes, edges = cut(nodes), cut(edges.select("child", "parent"))
    return nodes, edges, deleted


def carry_deletions(entity_types: DataFrame, deleted: DataFrame, up: DataFrame) -> DataFrame:
    """(entity_id, type_id) without deleted types.

    An entity that has lost all its types takes the nearest ancestor that
    stays, or a null type without one; no entity is dropped. ``up`` is the
    closure before the deletion.
    """
    kept = entity_types.select("entity_id", "type_id").join(deleted.select(F.col("node").alias("type_id")), "type_id", "left_anti").select("entity_id", "type_id")
    moved = tree.delete_impact(entity_types, deleted, up).filter("effect = 'reassigned'").select("entity_id", F.col("new_type").alias("type_id"))
    return kept.unionAll(moved).distinct()


def stale_constraints(constraints: DataFrame, deleted: DataFrame) -> DataFrame:
    """The constraints with a deleted type for domain or range."""
    gone = deleted.select("node").distinct()
    by_domain = constraints.join(gone.withColumnRenamed("node", "domain"), "domain", "left_semi")
    by_range = constraints.join(gone.withColumnRenamed("node", "range"), "range", "left_semi").join(gone.withColumnRenamed("node", "domain"), "domain", "left_anti")
    return by_domain.unionByName(by_range)


def merge_candidates(entities: DataFrame, old_keys: DataFrame, new_keys: DataFrame, affected: DataFrame, floor: float = 0.75, embedder: Callable = hashed_embedding) -> DataFrame:
    """(type_a, name_a, type_b, name_b, cosine): entities (name, type_id) whose types share a partition only since the edit.

    Names are compared once each; pairs below the floor are never joined to
    entities.
    """
    fresh = tree.newly_together(old_keys, new_keys, affected)
    touched = fresh.select(F.explode(F.array("type_a", "type_b")).alias("type_id")).distinct()
    some = cut(entities.select("name", "type_id").distinct().join(touched, "type_id", "left_semi").select("name", "type_id"))
    names = some.select("name").distinct()
    near = similar_pairs(embed(names.select(F.col("name").alias("text")), embedder).select(F.col("text").alias("id"), "vec"), floor)
    alike = near.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "cosine").unionAll(near.select("b", "a", "cosine"))
    alike = alike.unionAll(names.select("name", F.col("name").alias("again"), F.lit(1.0)))
    left = fresh.join(some.withColumnsRenamed({"type_id": "type_a", "name": "name_a"}), "type_a").join(alike, "name_a")
    found = left.join(some.withColumnsRenamed({"type_id": "type_b", "name": "name_b"}), ["type_b", "name_b"])
    return found.select("type_a", "name_a", "type_b", "name_b", "cosine")


def remerge(entities: DataFrame, nodes: DataFrame, edges: DataFrame, affected: DataFrame, adjudicator, threshold: float = 0.85, cap: int = 40, rounds: int = 5) -> DataFrame:
    """(tag, key, name, canonical): the entities of affected types merged again in their new partitions, no others."""
    touched = entities.join(affected.select(F.col("node").alias("type_id")).distinct(), "type_id", "left_semi")
    return merge_within(partitions(touched, nodes, edges).select("tag", "key", "name"), ["tag", "key"], adjudicator, threshold, cap, rounds)


def save_as_run(runs: Runs, run: int, steps: list[str], edges: DataFrame, deleted: DataFrame, up: DataFrame, merged: DataFrame | None = None) -> int:
    """A new run from an edited one: the new forest, entities carried on, constraints that aren't stale.

    ``steps`` are those to copy; of them ``hierarchy``, ``entities`` (entity_id,
    type_id) and ``constraints`` take the edits. A finished merge is saved as
    step ``merged``.
    """
    changed = {"hierarchy": edges}
    if "entities" in steps:
        changed["entities"] = carry_deletions(runs.load(run, "entities"), deleted, up)
    if "constraints" in steps:
        k = runs.load(run, "constraints")
        changed["constraints"] = k.join(stale_constraints(k, deleted).select("relation_id", "domain", "range"), ["relation_id", "domain", "range"], "left_anti").select(*k.columns)
    new = runs.copy_with(run, changed, steps)
    if merged is not None:
        runs.save(new, "merged", merged)
    return new
