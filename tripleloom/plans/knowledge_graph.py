"""From triplets to a canonical graph: the steps of a run, each kept in the run's folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..operators import constraints, entities, profiles, rounds, tree, vocab
from ..operators.induce import Placement, Settings
from ..operators.resolve import complete, resolve_relation, resolve_types
from ..sources.formats import PipelineConfig, seed_roots
from ..sources.runs import Runs


def canonical_vocabulary(surfaces: DataFrame, kind: str, prefix: str, width: int, adjudicator, threshold: float, config: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    """Items and surface_to_id after merging in rounds."""
    counted = vocab.normalize_and_count(surfaces)
    labels = counted.select(F.col("normalized").alias("label")).distinct()
    merged = rounds.round_loop(labels, adjudicator, kind, threshold, config.max_rounds, config.max_cluster_size)
    return vocab.assemble(counted, rounds.as_groups(merged), kind, prefix, width)


def run(triplets: DataFrame, runs: Runs, adjudicator, config: PipelineConfig | None = None, resume: bool = False) -> int:
    """Relations, types, forest, entities and constraints; returns the run's number. Finished steps are not redone."""
    config = config or PipelineConfig()
    spark, number = triplets.sparkSession, runs.start(resume)
    took: dict[str, float] = {}

    def step(name: str, make) -> DataFrame:
        began = time.time()
        out = runs.step(number, name, make)
        took[name] = round(time.time() - began, 3)
        return out

    def pair(name: str, surfaces: DataFrame, kind: str, prefix: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
        made: list = []

        def both(k: int):
            def make() -> DataFrame:
                if not made:
                    made.append(canonical_vocabulary(surfaces, kind, prefix, width, adjudicator, threshold, config))
                return made[0][k]

            return make

        return step(f"{name}_items", both(0)), step(f"{name}_surfaces", both(1))

    _, relation_ids = pair("relations", vocab.relation_surfaces(triplets), "relation", "rel", 5, config.relation_threshold)
    type_items, type_ids = pair("types", vocab.type_surfaces(triplets), "entity_type", "type", 4, config.type_threshold)
    bridge = step("relation_types", lambda: vocab.bridge_relation_types(vocab.relation_role_types(triplets), relation_ids, type_ids))

    def forest() -> DataFrame:
        if config.skip_hierarchy:
            return spark.createDataFrame([], "child string, parent string, score double, is_seed boolean")
        roles = bridge.select(F.col("relation_id").alias("relation"), "role", F.explode("type_ids").alias("type"))
        weights = profiles.weigh(profiles.relation_counts(roles), config.hierarchy.weighting)
        votes = profiles.in_degree(profiles.weeds_precision(weights), config.hierarchy.vote_threshold)
        scored = type_items.select(F.col("item_id").alias("type"), "canonical_label", "count_per_normalized").join(votes, "type", "left").fillna(0, ["votes"])
        scored = scored.filter(F.col("count_per_normalized") >= config.hierarchy.min_type_support)
        # Placement is sequential; it takes one row for each type of the vocabulary.
        order = [(r["type"], r["canonical_label"]) for r in scored.orderBy(F.desc("votes"), "type").toLocalIterator()]
        h = config.hierarchy
        settings = Settings(h.batch, h.regroup_input, h.regroup_rounds, h.collision, h.child_share, h.max_depth or 1 << 30)
        placed = Placement(adjudicator, settings).run(order, seed_roots(h.seed_roots))
        return spark.createDataFrame(placed.edges(), "child string, parent string, score double, is_seed boolean")

    edges = step("forest", forest).select("child", "parent")
    nodes = type_items.select(F.col("item_id").alias("node")).union(edges.select("parent")).distinct()
    typed = resolve_relation(resolve_types(complete(triplets), type_ids), relation_ids)
    typed = typed.filter("subject_type_id is not null and object_type_id is not null and relation_id is not null")

    def merged_entities() -> DataFrame:
        names = typed.select(normalize_label(F.col("subject")).alias("name"), F.col("subject_type_id").alias("type_id")).union(typed.select(normalize_label(F.col("object")), "object_type_id")).distinct()
        return entities.deduplicate(names, nodes, edges, adjudicator, config.entity_threshold, config.max_cluster_size)

    named = step("entities", merged_entities)
    up = tree.closure(edges, nodes)
    step("entity_classes", lambda: entities.assign_classes(named.select(F.col("entity").alias("entity_id"), "type_id"), up))

    def mined() -> DataFrame:
        surfaces = typed.select("relation_id", normalize_label(F.col("relation")).alias("surface")).distinct()
        said = [(r["relation_id"], r["surface"], adjudicator.classify_directions(r["relation_id"], [r["surface"]])[r["surface"]]) for r in surfaces.toLocalIterator()]
        table = spark.createDataFrame(said, "relation_id string, surface string, direction string")
        rows = typed.select("relation_id", normalize_label(F.col("relation")).alias("surface"), "subject_type_id", "object_type_id")
        return constraints.induce(rows, up, constraints.classify_directions(surfaces, table))

    found = step("constraints", mined)
    tiers = {r["strength"]: r["n"] for r in found.groupBy("strength").agg(F.count("*").alias("n")).collect()}
    runs.save_metadata(number, {"seconds": took, "constraints": tiers, "types": type_items.count(), "config": config})
    return number
