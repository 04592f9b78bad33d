"""Merging a vocabulary in rounds: embed, cluster, adjudicate, fold, until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoint import cut
from .adjudicate import verify_clusters
from .similarity import components, embed, hashed_embedding, similar_pairs
from .vocab import numbered


def candidate_clusters(labels: DataFrame, threshold: float, embedder: Callable = hashed_embedding, vectors: DataFrame | None = None) -> DataFrame:
    """(cluster, member): components of the labels (label) whose cosine reaches the threshold."""
    vectors = vectors if vectors is not None else embed(labels.select(F.col("label").alias("text")), embedder)
    pairs = similar_pairs(vectors.select(F.col("text").alias("id"), "vec"), threshold)
    member = components(pairs.select("a", "b"), labels.select(F.col("label").alias("node")))
    return member.select(F.col("component").alias("cluster"), F.col("node").alias("member"))


def single_pass(labels: DataFrame, adjudicator, kind: str, threshold: float, cap: int = 40, post: Callable | None = None, **embedding) -> DataFrame:
    """(canonical_label, member). Without an adjudicator a cluster's first member is canonical.

    ``post`` may coarsen the clusters (cluster, member), never split them.
    """
    found = candidate_clusters(labels, threshold, **embedding)
    if post is not None:
        found = found.transform(post)
    if adjudicator is None:
        return found.select(F.min("member").over(Window.partitionBy("cluster")).alias("canonical_label"), "member")
    return verify_clusters(found, adjudicator, kind, cap).select("canonical_label", "member")


def round_loop(labels: DataFrame, adjudicator, kind: str, threshold: float = 0.75, max_rounds: int = 5, cap: int = 40, post: Callable | None = None, **embedding) -> DataFrame:
    """(canonical_label, member) after up to ``max_rounds`` rounds over the canonical labels.

    Groups that come out with the same canonical label are one from then on. A
    round that does not shrink the pool is the last.
    """
    state = cut(labels.select(F.col("label").alias("canonical_label"), F.col("label").alias("member")))
    size = state.select("canonical_label").distinct().count()
    for _ in range(max_rounds):
        if size < 2:
            break
        pool = state.select(F.col("canonical_label").alias("label")).distinct()
        merged = single_pass(pool, adjudicator, kind, threshold, cap, post, **embedding)
        moved = merged.select(F.col("member").alias("canonical_label"), F.col("canonical_label").alias("next"))
        state = cut(state.join(moved, "canonical_label").select(F.col("next").alias("canonical_label"), "member"))
        now = state.select("canonical_label").distinct().count()
        if now >= size:
            break
        size = now
    return state


def as_groups(merged: DataFrame) -> DataFrame:
    """(group, member, canonical_label) numbered by canonical label, as ``vocab.assemble`` takes them."""
    labels = numbered(merged.select("canonical_label").distinct(), "canonical_label")
    return merged.join(labels, "canonical_label").select("group", "member", "canonical_label")
