"""Knowledge graphs: building, exporting, walking and measuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, compound_name
from ..plans.checkpoint import cut
from .resolve import first_wins
from .similarity import components


def fold_qualifiers(label: Column, qualifiers: Column) -> Column:
    """"label (q: v; q: v)" over qualifiers with both fields; null where there is none."""
    usable = F.filter(F.coalesce(qualifiers, F.array()), lambda q: (clean(q["relation"]) != "") & (clean(q["object"]) != ""))
    parts = F.transform(usable, lambda q: F.concat(clean(q["relation"]), F.lit(": "), clean(q["object"])))
    return F.concat(label, F.lit(" ("), F.nullif(F.array_join(parts, "; "), F.lit("")), F.lit(")"))


def fold_qualifiers_with(triplets: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, folded): qualifier relations take their canonical label where ``relations`` (surface, label) knows them."""
    rows = triplets.select(*keys, "relation", F.posexplode("qualifiers").alias("pos", "q"))
    rows = rows.select(*keys, "relation", "pos", clean(F.col("q.relation")).alias("surface"), clean(F.col("q.object")).alias("value")).filter("surface <> '' and value <> ''")
    named = rows.join(relations.select("surface", "label"), "surface", "left").withColumn("text", F.concat(F.coalesce("label", "surface"), F.lit(": "), F.col("value")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return named.groupBy(*keys, "relation").agg(F.concat(F.col("relation"), F.lit(" ("), F.array_join(parts, "; "), F.lit(")")).alias("folded"))


def build(resolved: DataFrame, use_qualifiers: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edge labels, relations) of resolved rows (s, r, o and qualifiers), each distinct.

    With qualifiers an enriched edge stands beside the plain one.
    """
    plain = resolved.select("s", "r", "o")
    if use_qualifiers:
        both = F.array("r", fold_qualifiers(F.col("r"), F.col("qualifiers")))
        plain = resolved.select("s", F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r"), "o")
    relations = plain.distinct()
    entities = relations.select(F.explode(F.array("s", "o")).alias("entity")).distinct()
    return entities, relations.select("r").distinct(), relations


def bare_label(label: Column) -> Column:
    return compound_name(label)


def refined(resolved: DataFrame) -> DataFrame:
    """Nested export rows; what does not resolve stays, with nulls and resolved = false."""

    def end(side: str) -> Column:
        return F.struct(F.col(side).alias("name"), F.col(f"{side}_id").alias("entity_id"), F.col(f"{side}_type").alias("type"), F.col(f"{side}_type_id").alias("type_id"))

    done = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & F.col("relation_id").isNotNull()
    return resolved.select(
        end("subject").alias("subject"), F.struct(F.col("relation").alias("label"), F.col("relation_id").alias("relation_id")).alias("relation"),
        end("object").alias("object"), done.alias("resolved"), "qualifiers",
    )


def sample_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each (sample, s, r, o), the earliest."""
    return first_wins(resolved, ["sample_id", "s", "r", "o"], ["kind", "ord"], ["kind", "ord"])


def sample_entities(resolved: DataFrame) -> DataFrame:
    """(sample_id, entity, name, type): the last mention wins."""
    ends = F.array(*[F.struct(F.lit(i).alias("side"), F.col(e).alias("entity"), F.col(n).alias("name"), F.col(t).alias("type")) for i, (e, n, t) in enumerate((("s", "subject", "subject_type"), ("o", "object", "object_type")))])
    rows = resolved.select("sample_id", "kind", "ord", F.explode(ends).alias("e"))
    last = F.max(F.struct("kind", "ord", F.col("e.side").alias("side"), F.col("e.name").alias("name"), F.col("e.type").alias("type")))
    return rows.groupBy("sample_id", F.col("e.entity").alias("entity")).agg(last.alias("b")).select("sample_id", "entity", "b.name", "b.type")


def _both_ways(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, other) of every edge in both directions, from one reading."""
    ways = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("s", "o"), ("o", "s"))])
    return edges.select(*keys, F.explode(ways).alias("w")).select(*keys, "w.*")


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges (sample_id, s, r, o) within ``depth`` undirected steps of seeds (sample_id, node), with the first hop."""
    both = cut(_both_ways(edges, "sample_id").distinct())
    seen = cut(seeds.select("sample_id", "node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, depth):
        edge = seen.filter(F.col("hop") == hop - 1)
        new = both.join(edge.drop("hop"), ["sample_id", "node"]).select("sample_id", F.col("other").alias("node")).distinct()
        new = new.join(seen, ["sample_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        after = cut(seen.unionByName(new))
        if after.filter(F.col("hop") == hop).isEmpty():
            break
        seen = after
    near = seen.select("sample_id", "node", "hop")
    found = edges.join(near.withColumnsRenamed({"node": "s", "hop": "hs"}), ["sample_id", "s"], "left").join(near.withColumnsRenamed({"node": "o", "hop": "ho"}), ["sample_id", "o"], "left")
    return found.withColumn("hop", F.least("hs", "ho") + 1).filter("hop is not null").select("sample_id", "s", "r", "o", "hop")


def metrics(relations: DataFrame) -> DataFrame:
    """One row about a graph (s, r, o): triples, nodes, their ratio, components, the giant's size and share, leaves."""
    degree = cut(relations.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")))
    member = components(relations.select(F.col("s").alias("a"), F.col("o").alias("b")), degree)
    sizes = member.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("giant"))
    nodes = degree.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 1).alias("leaves"))
    triples = relations.agg(F.count("*").alias("triples"))
    # Each side is one row; they are put together by a constant key.
    key = F.lit(1).alias("_k")
    one = triples.select("*", key).join(nodes.select("*", key), "_k").join(sizes.select("*", key), "_k")
    n = F.greatest(F.col("nodes"), F.lit(1))
    return one.select(
        "triples", "nodes", F.round(F.col("nodes") / F.greatest(F.col("triples"), F.lit(1)), 4).alias("nodes_per_triple"), "components", "giant",
        F.round(F.col("giant") / n, 4).alias("giant_share"), F.round(F.col("leaves") / n, 4).alias("leaf_share"),
    )


def selection_subgraph(nodes: DataFrame, edges: DataFrame, selected: DataFrame, cap: int) -> DataFrame:
    """(node, core, truncated) of the selected types' nodes and their direct neighbours, at most ``cap``, core nodes first.

    ``truncated`` says whether the cap has left any out.
    """
    core = cut(nodes.join(selected, "type_id", "left_semi").select("node", F.lit(True).alias("core")).distinct())
    ends = _both_ways(edges)
    around = ends.join(core.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(core, "node", "left_anti")
    every = cut(core.unionAll(around.withColumn("core", F.lit(False))))
    return every.orderBy(F.desc("core"), "node").limit(cap).withColumn("truncated", F.lit(every.count() > cap))


def skip_counts(resolved: DataFrame) -> DataFrame:
    """(reason, n) of the rows that a graph leaves out."""
    return resolved.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
