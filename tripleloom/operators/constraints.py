"""Domain and range constraints mined from resolved triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import cut
from . import tree

#: Confidence from which a constraint is hard, soft or a hint, and the support a hard one needs.
HARD, SOFT, HINT, MIN_SUPPORT = 0.90, 0.50, 0.20, 3


def classify_directions(surfaces: DataFrame, decisions: DataFrame) -> DataFrame:
    """(relation_id, surface, direction) for relation surfaces; a lone surface is forward, so are omissions."""
    size = surfaces.groupBy("relation_id").agg(F.count("*").alias("n"))
    found = surfaces.join(size, "relation_id").join(decisions.select("relation_id", "surface", F.col("direction").alias("said")), ["relation_id", "surface"], "left")
    known = F.when((F.col("n") > 1) & (F.col("said") == "inverted"), "inverted").otherwise("forward")
    return found.select("relation_id", "surface", known.alias("direction"))


def apply_directions(typed: DataFrame, directions: DataFrame) -> DataFrame:
    """Swap subject and object type where the surface is inverted; forward where nothing is known."""
    found = typed.join(directions, ["relation_id", "surface"], "left")
    turned = F.coalesce(F.col("direction") == "inverted", F.lit(False))
    return found.withColumns({
        "subject_type_id": F.when(turned, F.col("object_type_id")).otherwise(F.col("subject_type_id")),
        "object_type_id": F.when(turned, F.col("subject_type_id")).otherwise(F.col("object_type_id")),
    }).drop("direction")


def signature_map(typed: DataFrame, up: DataFrame) -> DataFrame:
    """(relation_id, role, type_id, signature): observed types generalise to their common ancestor within each root."""
    slot = F.array(F.struct(F.lit("domain").alias("role"), F.col("subject_type_id").alias("type_id")), F.struct(F.lit("range").alias("role"), F.col("object_type_id").alias("type_id")))
    seen = typed.select("relation_id", F.explode(slot).alias("s")).select("relation_id", "s.role", F.col("s.type_id").alias("node")).distinct()
    rooted = seen.join(tree.root_of(up), "node", "left").withColumn("root", F.coalesce("root", "node"))
    common = tree.lca(rooted, up, ["relation_id", "role", "root"])
    return rooted.join(common, ["relation_id", "role", "root"]).select("relation_id", "role", F.col("node").alias("type_id"), F.coalesce("lca", "node").alias("signature"))


def joint_support(typed: DataFrame, signatures: DataFrame) -> DataFrame:
    """(relation_id, domain, range, support, total, pca_confidence), counted triplet by triplet.

    Triplets are counted by their types before signatures are joined; a column
    ``n`` says how many triplets a row already stands for.
    """
    n = F.sum("n") if "n" in typed.columns else F.count("*")
    counts = typed.groupBy("relation_id", "subject_type_id", "object_type_id").agg(n.alias("n"))
    for role, side in (("domain", "subject_type_id"), ("range", "object_type_id")):
        at = signatures.filter(F.col("role") == role).select("relation_id", F.col("type_id").alias(side), F.col("signature").alias(role))
        counts = counts.join(at, ["relation_id", side])
    support = counts.groupBy("relation_id", "domain", "range").agg(F.sum("n").alias("support"))
    total = support.groupBy("relation_id").agg(F.sum("support").alias("total"))
    return support.join(total, "relation_id").withColumn("pca_confidence", F.col("support") / F.col("total"))


def with_strength(support: DataFrame, include_below: bool = False) -> DataFrame:
    p = F.col("pca_confidence")
    tier = F.when((p >= HARD) & (F.col("support") >= MIN_SUPPORT), "hard").when(p >= SOFT, "soft").when(p >= HINT, "hint").otherwise("below_hint")
    found = support.withColumn("strength", tier)
    return found if include_below else found.filter("strength <> 'below_hint'")


def induce(typed: DataFrame, up: DataFrame, directions: DataFrame | None = None, include_below: bool = False) -> DataFrame:
    """Constraints of ``typed`` (relation_id, surface, subject_type_id, object_type_id and n, if counted); empty in, empty out.

    What is mined from are the counts by relation, surface and types, which are
    few against the triplets and are written once.
    """
    n = F.sum("n") if "n" in typed.columns else F.count("*")
    keys = [k for k in ("relation_id", "surface", "subject_type_id", "object_type_id") if k in typed.columns]
    typed = cut(typed.groupBy(*keys).agg(n.alias("n")))
    if directions is not None:
        typed = apply_directions(typed, directions)
    return with_strength(joint_support(typed, signature_map(typed, up)), include_below)


def index(constraints: DataFrame) -> DataFrame:
    """(relation_id, constraints) with the most confident first."""
    entry = F.struct((-F.col("pca_confidence")).alias("order"), "domain", "range", "support", "strength")
    return constraints.groupBy("relation_id").agg(F.array_sort(F.collect_list(entry)).alias("constraints"))


def _tier_order() -> Column:
    """Hard before soft before hint before any other."""
    at = F.array_position(F.array(*[F.lit(t) for t in ("hard", "soft", "hint")]), F.col("strength"))
    return F.when(at > 0, at).otherwise(4)


def groups(constraints: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(relation_id, relation, n, max_confidence, top_strength, rows): a relation's rows by falling confidence.

    Relations with most rows come first, ties by label. ``labels`` has
    relation_id and relation; an id stands for itself without one.
    """
    entry = F.struct((-F.col("pca_confidence")).alias("order"), "domain", "range", "support", "total", F.round("pca_confidence", 3).alias("confidence"), "strength")
    best = F.min(F.struct(_tier_order().alias("tier"), "strength"))["strength"]
    found = constraints.groupBy("relation_id").agg(
        F.count("*").alias("n"), F.round(F.max("pca_confidence"), 3).alias("max_confidence"), best.alias("top_strength"), F.array_sort(F.collect_list(entry)).alias("rows")
    )
    if labels is not None:
        found = found.join(labels.select("relation_id", "relation"), "relation_id", "left")
    named = found.withColumn("relation", F.coalesce("relation", "relation_id") if labels is not None else F.col("relation_id"))
    slim = F.transform("rows", lambda x: x.dropFields("order"))
    return named.select("relation_id", "relation", "n", "max_confidence", "top_strength", slim.alias("rows")).orderBy(F.desc("n"), "relation", "relation_id")


def view(constraints: DataFrame, strengths: list[str], floor: float = 0.0, contains: str = "") -> DataFrame:
    """The constraints of some strengths and confidence whose relation holds a text (case aside), strongest and surest first."""
    wanted = F.col("strength").isin(strengths) & (F.col("pca_confidence") >= floor)
    if contains.strip():
        wanted &= F.contains(F.lower("relation_id"), F.lit(contains.strip().lower()))
    return constraints.filter(wanted).orderBy(_tier_order(), F.desc("pca_confidence"), "relation_id", "domain", "range")


def restricted(typed: DataFrame, constraints: DataFrame, affected: DataFrame) -> DataFrame:
    """Triplets of the relations that have a constraint on an affected type (node)."""
    sides = constraints.select("relation_id", F.explode(F.array("domain", "range")).alias("node"))
    return typed.join(sides.join(affected, "node").select("relation_id"), "relation_id", "left_semi")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Constraints that appear, vanish or change strength: (relation_id, domain, range, was, now)."""
    keys = ["relation_id", "domain", "range"]
    both = before.select(*keys, F.col("strength").alias("was")).join(after.select(*keys, F.col("strength").alias("now")), keys, "full_outer")
    return both.filter("not was <=> now")
