"""Relation profiles of types: sparse weights as (type, relation_id, weight) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def relation_counts(role_types: DataFrame) -> DataFrame:
    """(type, relation, weight): in how many of the relation's two roles the type occurs."""
    return role_types.groupBy("type", "relation").agg(F.count("*").cast("double").alias("weight"))


def weigh(counts: DataFrame, scheme: str = "ppmi") -> DataFrame:
    """PPMI, TF-IDF or raw weights; cells that come to 0 or less are dropped."""
    if scheme == "raw":
        return counts
    if scheme == "ppmi":
        rows = counts.groupBy("type").agg(F.sum("weight").alias("_row"))
        cols = counts.groupBy("relation").agg(F.sum("weight").alias("_col"))
        grand = counts.agg(F.sum("weight").alias("_all"))
        found = counts.join(rows, "type").join(cols, "relation").join(F.broadcast(grand))
        value = F.log(F.col("weight") * F.col("_all") / (F.col("_row") * F.col("_col")))
    elif scheme == "tfidf":
        df = counts.groupBy("relation").agg(F.count_distinct("type").alias("_df"))
        grand = counts.agg(F.count_distinct("type").alias("_all"))
        found = counts.join(df, "relation").join(F.broadcast(grand))
        value = F.col("weight") * F.log(F.col("_all") / (1 + F.col("_df")))
    else:
        raise ValueError(f"unknown weighting {scheme!r}")
    return found.select("type", "relation", value.alias("weight")).filter("weight > 0")


#: Types of one relation in a block; pairs of blocks are joined by their own tasks.
BLOCK = 2048


def _pairs(profiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Type pairs that share a relation, with both weights (a < b).

    A relation of more than ``block`` types is dealt out as pairs of blocks, so
    no task pairs more than two blocks, however many types it has.
    """
    size = profiles.groupBy("relation").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = profiles.select("type", "relation", "weight").join(size, "relation").withColumn("own", F.pmod(F.xxhash64("type"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    keys = ["relation", "lo", "hi"]
    left = dealt.select(*keys, F.col("own").alias("oa"), F.col("type").alias("a"), F.col("weight").alias("wa"))
    right = dealt.select(*keys, F.col("own").alias("ob"), F.col("type").alias("b"), F.col("weight").alias("wb"))
    # Two types of one block meet in that block's pair with itself, and nowhere else.
    return left.join(right, keys).filter("a < b and (lo = hi or oa <> ob)").select("a", "b", "relation", "wa", "wb")


def candidate_pairs(profiles: DataFrame) -> DataFrame:
    """Distinct ordered type pairs that share a relation."""
    return _pairs(profiles).select("a", "b").distinct()


def sparse_cosine(profiles: DataFrame) -> DataFrame:
    """(a, b, cosine) of all pairs that share a relation; all other pairs have 0."""
    norm = profiles.groupBy("type").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    dots = _pairs(profiles).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    found = dots.join(norm.withColumnsRenamed({"type": "a", "norm": "na"}), "a").join(norm.withColumnsRenamed({"type": "b", "norm": "nb"}), "b")
    return found.select("a", "b", F.when(F.col("na") * F.col("nb") > 0, F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


def weeds_precision(profiles: DataFrame) -> DataFrame:
    """(child, parent, precision): how much of the child's weight lies where the parent has some."""
    whole = profiles.groupBy("type").agg(F.sum("weight").alias("whole"))
    pairs = _pairs(profiles)
    both = pairs.select(F.col("a").alias("child"), F.col("b").alias("parent"), F.col("wa").alias("w"))
    both = both.unionAll(pairs.select(F.col("b"), F.col("a"), F.col("wb")))
    shared = both.groupBy("child", "parent").agg(F.sum("w").alias("shared"))
    return shared.join(whole.withColumnRenamed("type", "child"), "child").select("child", "parent", F.when(F.col("whole") > 0, F.col("shared") / F.col("whole")).otherwise(0.0).alias("precision"))


def roll_up(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Sum label profiles over ``members`` (type_id, label); a type without weights has one row with nulls."""
    labels = profiles.withColumnRenamed("type", "label")
    found = members.distinct().join(labels, "label", "left").groupBy("type_id", "relation").agg(F.sum("weight").alias("weight"))
    has = Window.partitionBy("type_id")
    return found.withColumn("_n", F.count("relation").over(has)).filter("relation is not null or _n = 0").drop("_n")


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    out = profiles[0]
    for more in profiles[1:]:
        out = out.unionByName(more)
    return out.groupBy("type", "relation").agg(F.sum("weight").alias("weight"))


def in_degree(weeds: DataFrame, threshold: float) -> DataFrame:
    """(type, votes): pairs whose larger precision reaches the threshold vote for the containing side, ties for both."""
    ab = weeds.filter("child < parent").select(F.col("child").alias("a"), F.col("parent").alias("b"), F.col("precision").alias("ab"))
    ba = weeds.filter("child > parent").select(F.col("parent").alias("a"), F.col("child").alias("b"), F.col("precision").alias("ba"))
    pairs = ab.join(ba, ["a", "b"]).filter(F.greatest("ab", "ba") >= threshold)
    vote = F.when(F.col("ab") > F.col("ba"), F.array("b")).when(F.col("ba") > F.col("ab"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(F.explode(vote).alias("type")).groupBy("type").agg(F.count("*").alias("votes"))


def priority_bands(scored: DataFrame, tolerance: float) -> DataFrame:
    """(type, votes, band): by votes downward, a band reaching ``tolerance`` below its own first score.

    Bands fold over distinct scores, which are few whatever the number of types.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = sorted({s for f in frames for s in f["votes"]}, reverse=True)
        band, first, rows = -1, None, []
        for score in scores:
            if first is None or first - score > tolerance:
                band, first = band + 1, score
            rows.append((score, band))
        yield pd.DataFrame(rows, columns=["votes", "band"])

    bands = scored.select("votes").distinct().coalesce(1).mapInPandas(fold, "votes long, band int")
    return scored.join(bands, "votes").select("type", "votes", "band")


def top_relations(profiles: DataFrame, k: int) -> DataFrame:
    """(type, relation, weight, rank): the k heaviest relations, ties by name."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("weight"), "relation"))
    return profiles.withColumn("rank", rank).filter(F.col("rank") <= k)


def relation_context(profiles: DataFrame, k: int) -> DataFrame:
    """(type, context): the heaviest relations as text; types without any are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "relation")))
    return top_relations(profiles, k).groupBy("type").agg(
        F.concat(F.lit("often appears with: "), F.array_join(F.transform(ordered, lambda x: x["relation"]), ", ")).alias("context")
    )
