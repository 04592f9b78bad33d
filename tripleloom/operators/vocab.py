"""Vocabularies: surface forms collected, normalised, counted and assembled into items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean, compound, item_id, normalize_compound, normalize_label
from ..plans.checkpoint import cut


def _qualifiers(triplets: DataFrame) -> DataFrame:
    """One row for each qualifier, with the triplet's columns."""
    return triplets.withColumn("q", F.explode("qualifiers")).filter("q is not null")


def patterns(triplets: DataFrame) -> DataFrame:
    """Triplets without names, each combination of labels once: relation, both types, qualifiers (relation and
    object type), ``whole`` (subject and object are there) and n, how many triplets have it.

    What follows from labels alone (types, relations, roles) needs no other reading of the triplets.
    """
    labels = F.transform("qualifiers", lambda q: F.when(q.isNotNull(), F.struct(q["relation"].alias("relation"), q["object_type"].alias("object_type"))))
    whole = (clean(F.col("subject")) != "") & (clean(F.col("object")) != "")
    return triplets.groupBy("relation", "subject_type", "object_type", labels.alias("qualifiers"), whole.alias("whole")).agg(F.count("*").alias("n"))


def _times(rows: DataFrame) -> list[str]:
    """The column n, if the rows stand for several each."""
    return ["n"] if "n" in rows.columns else []


def type_surfaces(triplets: DataFrame) -> DataFrame:
    """Every type mention (column surface), duplicates kept, empties dropped; of ``patterns`` with their n."""
    n = _times(triplets)
    main = triplets.select(F.explode(F.array("subject_type", "object_type")).alias("surface"), *n)
    return main.unionAll(_qualifiers(triplets).select("q.object_type", *n)).select(clean(F.col("surface")).alias("surface"), *n).filter("surface <> ''")


def relation_surfaces(triplets: DataFrame) -> DataFrame:
    """Every relation mention, qualifiers' included; of ``patterns`` with their n."""
    n = _times(triplets)
    return triplets.select("relation", *n).unionAll(_qualifiers(triplets).select("q.relation", *n)).select(clean(F.col("relation")).alias("surface"), *n).filter("surface <> ''")


def _named(triplets: DataFrame) -> DataFrame:
    """(name, type_label) of every end and qualifier as they stand, from one reading of the triplets."""
    slots = F.array(*[F.struct(F.col(end).alias("name"), F.col(f"{end}_type").alias("type_label")) for end in ("subject", "object")])
    extra = F.arrays_zip(F.coalesce("qualifiers.object", F.array().cast("array<string>")), F.coalesce("qualifiers.object_type", F.array().cast("array<string>")))
    pair = "array<struct<name:string,type_label:string>>"
    return triplets.select(F.explode(F.concat(slots.cast(pair), extra.cast(pair))).alias("m")).select("m.*")


def entity_mentions(triplets: DataFrame) -> DataFrame:
    """(name, type_label) of every entity mention with both fields."""
    every = _named(triplets)
    return every.select(clean(F.col("name")).alias("name"), clean(F.col("type_label")).alias("type_label")).filter("name <> '' and type_label <> ''")


def distinct_mentions(triplets: DataFrame) -> DataFrame:
    """``entity_mentions``, each once with its number n, written. They are counted as they stand and then cleaned."""
    raw = _named(triplets).groupBy("name", "type_label").agg(F.count("*").alias("n"))
    found = raw.select(clean(F.col("name")).alias("name"), clean(F.col("type_label")).alias("type_label"), "n").filter("length(name) * n > 0 and length(type_label) * n > 0")
    return cut(found.groupBy("name", "type_label").agg(F.sum("n").alias("n")))


def entity_surfaces(triplets: DataFrame, types: DataFrame, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(surface, normalized, type_id) of mentions whose type is in ``types`` (surface, item_id, canonical_label),
    and a one-row table with the number of those skipped. With ``distinct_mentions`` surfaces have their n."""
    mentions = entity_mentions(triplets) if mentions is None else mentions
    n = _times(mentions)
    # The type labels are few; each is normalised and looked up once.
    known = mentions.select("type_label").distinct().withColumn("t", normalize_label(F.col("type_label"))).join(
        types.select(F.col("surface").alias("t"), "item_id", "canonical_label"), "t"
    )
    found = mentions.join(cut(known.drop("t")), "type_label", "left")
    unknown = F.col("item_id").isNull()
    skipped = found.agg((F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)) if n else F.count_if(unknown)).alias("skipped"))
    label = compound(F.col("name"), F.col("canonical_label"))
    kept = found.filter("item_id is not null").select(label.alias("surface"), F.col("item_id").alias("type_id"), *n)
    return kept.withColumn("normalized", normalize_compound(F.col("surface"))), skipped


def relation_role_types(triplets: DataFrame) -> DataFrame:
    """(relation, role, type), distinct; qualifiers give object types only. Empty types are left out."""
    main = triplets.select("relation", F.explode(F.array(F.struct(F.lit("subject").alias("role"), F.col("subject_type").alias("type")), F.struct(F.lit("object").alias("role"), F.col("object_type").alias("type")))).alias("x")).select("relation", "x.role", "x.type")
    extra = _qualifiers(triplets).select("q.relation", F.lit("object").alias("role"), F.col("q.object_type").alias("type"))
    every = main.unionAll(extra).select(clean(F.col("relation")).alias("relation"), "role", clean(F.col("type")).alias("type"))
    return every.filter("relation <> '' and type <> ''").distinct()


def _normalized(surfaces: DataFrame, normalizer) -> DataFrame:
    counted = surfaces.groupBy("surface").agg((F.sum("n") if _times(surfaces) else F.count("*")).alias("n"))
    return counted.select(normalizer(F.col("surface")).alias("normalized"), "surface", "n")


def normalize_and_count(surfaces: DataFrame, normalizer=normalize_label) -> DataFrame:
    """normalized, surface, n: raw forms under their normal form, counted with map-side combining (surfaces may have an n)."""
    # Empty normal forms are dropped by a test that needs n, so that Spark can't move the normaliser below the count.
    return _normalized(surfaces, normalizer).filter("length(normalized) * n > 0")


def normalized_counts(counted: DataFrame) -> DataFrame:
    """normalized, n_mentions, raws (sorted) from ``normalize_and_count``."""
    return counted.groupBy("normalized").agg(F.sum("n").alias("n_mentions"), F.array_sort(F.collect_set("surface")).alias("raws"))


def own_groups(counted: DataFrame) -> DataFrame:
    """Groups of one: each normal form is its own canonical label, in sorted order (group, member, canonical_label)."""
    labels = counted.select("normalized").distinct()
    return numbered(labels, "normalized").select("group", F.col("normalized").alias("member"), F.col("normalized").alias("canonical_label"))


def numbered(labels: DataFrame, column: str) -> DataFrame:
    """Add ``group``: the place of each distinct label in sorted order, from 0.

    Labels are dealt out by range and numbered within their range, so no task
    sorts more than its part of the vocabulary.
    """
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(labels.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ranged.withColumn("_within", within).join(sizes, "_part").withColumn("group", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def assemble(counted: DataFrame, groups: DataFrame, kind: str, prefix: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Items and surface_to_id from groups (group, member, canonical_label) of normal forms.

    Surface forms are the raws and the members; an item counts its members'
    mentions. A surface claimed by several groups goes to the last one.
    """
    members = groups.join(counted, groups.member == counted.normalized, "left")
    # A member is a form of its own; the join is read once for both.
    both = F.array(F.struct("surface", "n"), F.struct(F.col("member").alias("surface"), F.lit(0).cast("long").alias("n")))
    form = members.select("group", "canonical_label", F.explode(both).alias("x")).select("group", "canonical_label", "x.*").filter("surface is not null")
    form = form.groupBy("group", "canonical_label", "surface").agg(F.sum("n").alias("n"))
    items = form.groupBy("group", "canonical_label").agg(
        F.sum("n").alias("count_per_normalized"), F.array_sort(F.collect_list("surface")).alias("surface_forms"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "n")))).alias("surface_form_counts"),
    )
    items = items.withColumn("item_id", item_id(prefix, width, F.col("group").cast("long")))
    surfaces = form.select("group", "surface").unionAll(groups.select("group", F.col("canonical_label").alias("surface")).distinct())
    to_id = surfaces.groupBy("surface").agg(F.max("group").alias("group")).select("surface", item_id(prefix, width, F.col("group").cast("long")).alias("item_id"))
    out = items.select(F.lit(kind).alias("kind"), "item_id", "canonical_label", "count_per_normalized", "surface_forms", "surface_form_counts")
    return out, to_id.select(F.lit(kind).alias("kind"), "surface", "item_id")


def vocabulary(surfaces: DataFrame, kind: str, prefix: str, width: int, normalizer=normalize_label) -> tuple[DataFrame, DataFrame]:
    """Items and surface_to_id where nothing but equal normal forms is merged."""
    # Written before the empty ones are dropped, as the test would normalise each form once more.
    counted = cut(_normalized(surfaces, normalizer)).filter("normalized <> ''")
    return assemble(counted, own_groups(counted), kind, prefix, width)


def reduction(n_raw: Column, n_canonical: Column) -> Column:
    return (1 - n_canonical / F.greatest(n_raw, F.lit(1)).cast("double")) * 100


def never_merged_share(items: DataFrame) -> DataFrame:
    """Share of items with one surface form at most; null without items."""
    return items.agg(F.round(F.avg(F.when(F.size("surface_forms") <= 1, 1.0).otherwise(0.0)), 4).alias("never_merged_share"))


def bridge_relation_types(role_types: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """(relation_id, role, type_ids): type labels to ids, normalised form first. The input stays, so it can be redone."""
    at = types.select("surface", "item_id")
    found = (
        role_types.withColumn("_n", normalize_label(F.col("type"))).join(relations.select(F.col("surface").alias("relation"), F.col("item_id").alias("relation_id")), "relation")
        .join(at.withColumnsRenamed({"surface": "s1", "item_id": "id1"}), F.col("_n") == F.col("s1"), "left")
        .join(at.withColumnsRenamed({"surface": "s2", "item_id": "id2"}), F.col("type") == F.col("s2"), "left")
        .withColumn("type_id", F.coalesce("id1", "id2"))
    )
    return found.filter("type_id is not null").groupBy("relation_id", "role").agg(F.array_sort(F.collect_set("type_id")).alias("type_ids"))


def usage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before for each counter (counter, value)."""
    gone = before.select("counter", F.col("value").alias("was"))
    return after.join(gone, "counter", "left").select("counter", (F.col("value") - F.coalesce("was", F.lit(0))).alias("value"))
