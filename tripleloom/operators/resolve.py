"""Resolving mentions against vocabularies, and the small joins around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean, compound, normalize_compound, normalize_label
from ..plans.checkpoint import cut


def named(labels: DataFrame, to_id: DataFrame, out: str, raw_first: bool, normalizer=normalize_label) -> DataFrame:
    """(label, ``out``) of the labels that resolve: by their raw and their normal form, one before the other.

    Each distinct label is normalised and looked up once, however often it is mentioned.
    """
    raw_hit = to_id.select(F.col("surface").alias("label"), F.col("item_id").alias("_id1"))
    norm_hit = to_id.select(F.col("surface").alias("_n"), F.col("item_id").alias("_id2"))
    asked = labels.select("label").filter("label is not null").distinct().withColumn("_n", normalizer(F.col("label")))
    found = asked.join(raw_hit, "label", "left").join(norm_hit, "_n", "left")
    first, second = ("_id1", "_id2") if raw_first else ("_id2", "_id1")
    return found.select("label", F.coalesce(first, second).alias(out)).filter(F.col(out).isNotNull())


def resolve_relation(df: DataFrame, to_id: DataFrame) -> DataFrame:
    found = named(df.select(F.col("relation").alias("label")), to_id, "relation_id", raw_first=True)
    return df.join(found.withColumnRenamed("label", "relation"), "relation", "left").select(*df.columns, "relation_id")


def resolve_types(df: DataFrame, to_id: DataFrame) -> DataFrame:
    found = named(df.select(F.explode(F.array("subject_type", "object_type")).alias("label")), to_id, "_id", raw_first=False)
    out = df
    for side in ("subject_type", "object_type"):
        out = out.join(found.withColumnsRenamed({"label": side, "_id": f"{side}_id"}), side, "left")
    return out.select(*df.columns, "subject_type_id", "object_type_id")


def resolve_entities(df: DataFrame, types: DataFrame, to_id: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Adds subject_id and object_id; needs the sides' type ids. ``types`` has item_id, canonical_label.

    ``pairs`` (name, type_id), if they are known, hold all of ``df``'s and each once.
    """
    if pairs is None:
        ends = F.array(*[F.struct(F.col(side).alias("name"), F.col(f"{side}_type_id").alias("type_id")) for side in ("subject", "object")])
        pairs = df.select(F.explode(ends).alias("e")).select("e.name", "e.type_id").filter("type_id is not null").distinct()
    labels = types.select(F.col("item_id").alias("type_id"), F.col("canonical_label").alias("_label"))
    # The pairs, and what they resolve to, are far fewer than the triplets and read twice each.
    pairs = cut(pairs.join(labels, "type_id").select("name", "type_id", compound(F.col("name"), F.col("_label")).alias("label")))
    found = named(pairs, to_id, "_id", raw_first=True, normalizer=normalize_compound)
    found = cut(pairs.join(found, "label").select("name", "type_id", "_id"))
    out = df
    for side in ("subject", "object"):
        out = out.join(found.withColumnsRenamed({"name": side, "type_id": f"{side}_type_id", "_id": f"{side}_id"}), [side, f"{side}_type_id"], "left")
    return out.select(*df.columns, "subject_id", "object_id")


FIELDS = ("subject", "subject_type", "relation", "object", "object_type")


def cleaned(triplets: DataFrame) -> DataFrame:
    return triplets.withColumns({f: clean(F.col(f)) for f in FIELDS})


def complete(triplets: DataFrame) -> DataFrame:
    """Triplets with all five fields."""
    filled = cleaned(triplets)
    return filled.filter(" and ".join(f"{f} <> ''" for f in FIELDS))


def reject_reason() -> Column:
    """The first slot that does not resolve, in the order types, relation, entities."""
    order = ["subject_type", "object_type", "relation", "subject_entity", "object_entity"]
    ids = ["subject_type_id", "object_type_id", "relation_id", "subject_id", "object_id"]
    reason = None
    for name, id_ in zip(order, ids):
        reason = F.when(F.col(id_).isNull(), name) if reason is None else reason.when(F.col(id_).isNull(), name)
    return reason


def resolve_all(
    triplets: DataFrame, types_to_id: DataFrame, relations_to_id: DataFrame, types: DataFrame, entities_to_id: DataFrame, labels: DataFrame | None = None, mentions: DataFrame | None = None
) -> DataFrame:
    """All ids of complete triplets and the reason of a reject (null if resolved).

    Combinations of relation and types are few, and so are names beside their
    mentions; they are resolved once each and joined to the triplets.
    ``labels`` (relation, subject_type, object_type) and ``mentions`` (name,
    type_label), cleaned and distinct, save a reading of the triplets each.
    """
    raw = ["relation", "subject_type", "object_type"]
    filled = complete(triplets)
    asked = cut((filled if labels is None else labels).select(*raw).distinct())
    known = cut(resolve_relation(resolve_types(asked, types_to_id), relations_to_id))
    df = filled.join(known, raw).select(*filled.columns, "subject_type_id", "object_type_id", "relation_id")
    pairs = None
    if mentions is not None:
        kinds = known.select(F.explode(F.array(*[F.struct(F.col(t).alias("type_label"), F.col(f"{t}_id").alias("type_id")) for t in ("subject_type", "object_type")])).alias("k")).select("k.*")
        pairs = mentions.join(cut(kinds.filter("type_id is not null").distinct()), "type_label").select("name", "type_id").distinct()
    return resolve_entities(df, types, entities_to_id, pairs).withColumn("reason", reject_reason())


def positional_zip(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pair the elements of arrays ``a`` and ``b`` by place; where lengths differ, a null goes with each of ``a``."""
    both = left.join(right, key, "left")
    same = F.size(a) == F.size(F.coalesce(F.col(b), F.array()))
    return both.select(key, F.posexplode(F.col(a)).alias("pos", "left"), F.when(same, F.col(b)).alias("_b")).select(key, "pos", "left", F.get("_b", F.col("pos")).alias("right"))


def first_wins(df: DataFrame, keys: list[str], ordinal: list[str], values: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the smallest ordinal."""
    best = F.min(F.struct(*dict.fromkeys([*ordinal, *values])))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{v}").alias(v) for v in values])


def containment_join(typed: DataFrame, constraints: DataFrame, closure: DataFrame, keys: list[str]) -> DataFrame:
    """For each typed relation mention (keys, relation_id, subject_type_id, object_type_id) the first constraint
    (pos, domain, range) that contains both types; else the relation's first, with containment_ok false; else null."""
    up = closure.select("node", "ancestor")
    pairs = typed.join(constraints, "relation_id", "left")
    pairs = pairs.join(up.withColumnsRenamed({"node": "subject_type_id", "ancestor": "domain"}).withColumn("d_ok", F.lit(True)), ["subject_type_id", "domain"], "left")
    pairs = pairs.join(up.withColumnsRenamed({"node": "object_type_id", "ancestor": "range"}).withColumn("r_ok", F.lit(True)), ["object_type_id", "range"], "left")
    ok = F.coalesce(F.col("d_ok"), F.lit(False)) & F.coalesce(F.col("r_ok"), F.lit(False))
    ranked = pairs.withColumn("ok", ok).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ok"), F.col("pos"))))
    has = F.col("pos").isNotNull()
    return ranked.filter("rn = 1").select(*keys, "relation_id", F.col("pos").alias("constraint_pos"), F.when(has, F.col("ok")).alias("containment_ok"))


def forced_name_groups(entities: DataFrame) -> DataFrame:
    """Entities (entity_id, name) whose bare normal names are equal, as groups of two and more."""
    named = entities.withColumn("norm_name", normalize_label(F.col("name")))
    return named.groupBy("norm_name").agg(F.array_sort(F.collect_list("entity_id")).alias("members")).filter("size(members) > 1")
