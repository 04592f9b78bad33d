"""Behaviour of the engine's operators on small fixtures."""

import hashlib
import json
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import text as T
from tripleloom.operators import adjudicate, constraints, entities, graph, profiles, resolve, rounds, similarity, tree, vocab
from tripleloom.operators.adjudicate import DecisionTable, repair_groups
from tripleloom.operators.induce import Placement, Settings
from tripleloom.plans import queries
from tripleloom.sources import formats
from tripleloom.sources.runs import Runs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def forest(spark):
    return frame(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "child string, parent string")


@pytest.fixture(scope="module")
def nodes(spark):
    return frame(spark, [(x,) for x in "abcdex"], "node string")


@pytest.fixture(scope="module")
def up(forest, nodes):
    return tree.closure(forest, nodes)


# ------------------------------------------------------------ text


def test_labels_are_normalised(spark):
    rows = [("  Ｆｕｌｌ　Width ",), ("A\t b",), (None,), ("",)]
    found = frame(spark, rows, "s string").select(T.normalize_label(F.col("s"))).collect()
    assert [r[0] for r in found] == ["full width", "a b", "", ""]


def test_all_documents_are_normalised_as_python_does(spark, tmp_path):
    texts = ["Plain  ASCII\n text", "\u00c9t\u00e9 \uff26\uff35", "cafe\u0301\u00a0\u2028x", "stra\u00dfe \u0130 \u03a3\u0391\u03a3", "", None]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, hashlib.md5(" ".join(unicodedata.normalize("NFKC", t or "").lower().split()).encode()).hexdigest()) for i, t in enumerate(texts)}
    assert pairs(queries.QUERIES["f1_normalize_text"](spark, str(tmp_path))) == want


def test_blanks_of_any_kind_are_trimmed(spark):
    said = ["\t", "\u00a0 x\n", "\u3000a b\u2003", "\x1c", "", None, " plain "]
    got = [r[0] for r in frame(spark, [(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(T.clean(F.col("s"))).collect()]
    assert got == [(s or "").strip() for s in said]


def test_answers_lose_their_accents(spark):
    said = {"Café Müßig": "cafe mussig", "Łódź, 1,000.5": "lodz 10005", "Œuvre": "oeuvre", "plain.": "plain", None: ""}
    got = frame(spark, [(s,) for s in said], "s string").select("s", T.qa_normalize(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == said


def test_the_cycle_guard_refuses_moves_below_themselves(spark, up):
    from tripleloom.operators import tree

    some = up.filter("depth > 0").select("node", "ancestor").collect()
    moves = [(r["ancestor"], r["node"]) for r in some] + [(r["node"], r["ancestor"]) for r in some] + [(some[0]["node"], some[0]["node"])]
    refused = pairs(tree.refused_moves(frame(spark, moves, "child string, parent string"), up))
    assert refused == {(r["ancestor"], r["node"]) for r in some} | {(some[0]["node"], some[0]["node"])}
    assert all(tree.would_cycle(up, *m) for m in list(refused)[:2])


def test_compounds(spark):
    rows = [("name [type]",), ("x [c] [c]",), ("bare ",), ("a[b]",), ("[t]",)]
    found = frame(spark, rows, "s string").select(T.compound_name(F.col("s")), T.compound_type(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [("name", "type"), ("x", "c] [c"), ("bare", ""), ("a", "b"), ("[t]", "")]


@pytest.mark.parametrize("said, value", [('{"a": 1}', {"a": 1}), ("so:\n```json\n[1]\n```", [1]), ("it is {\"b\": 2} yes", {"b": 2}), ("none", "none"), ("{bad", "{bad"), (None, None)])
def test_loose_json(said, value):
    assert T.loose_json(said) == value


# ------------------------------------------------------------ adjudication


def test_repair_gives_partitions():
    members = ["a", "b", "c"]
    apart = [(m, [m]) for m in members]
    good = [{"canonical_label": "A", "members": ["a", "B"]}]
    assert repair_groups(good, members) == [("a", ["a", "b"]), ("c", ["c"])]
    assert repair_groups(json.dumps({"groups": good}), members) == [("a", ["a", "b"]), ("c", ["c"])]
    twice = [{"canonical_label": "x", "members": ["a", "b"]}, {"canonical_label": "y", "members": ["b", "c"]}]
    assert repair_groups(twice, members) == [("x", ["a", "b"]), ("y", ["c"])]
    for bad in (None, [], "nonsense", [{"members": ["a"]}], [1], [{"canonical_label": "x", "members": "a"}], [{"canonical_label": m, "members": [m]} for m in "abcd"]):
        assert repair_groups(bad, members) == apart
    assert repair_groups([{"canonical_label": "x", "members": ["unknown"]}], members) == apart
    odd = [{"canonical_label": "X ", "members": ["a", "New", "new", "b"]}]
    assert repair_groups(odd, members) == [("x", ["a", "New", "b"]), ("c", ["c"])]
    assert repair_groups([*odd, {"canonical_label": "", "members": ["c"]}], members) == apart
    assert repair_groups([*odd, {"canonical_label": "y", "members": []}], members) == apart
    assert repair_groups([*odd, {"canonical_label": "y", "members": ["A"]}], members) == [("x", ["a", "New", "b"]), ("c", ["c"])]

    class Says:
        def verify_cluster(self, *a):
            return odd

    assert adjudicate.adjudicate(Says(), "entity", members) == [("x", ["a", "b"]), ("c", ["c"])]


def test_failures_keep_labels_apart():
    class Broken:
        def verify_cluster(self, *a):
            raise RuntimeError

    assert adjudicate.adjudicate(Broken(), "entity", ["a", "b"]) == [("a", ["a"]), ("b", ["b"])]
    with pytest.raises(ValueError):
        DecisionTable().verify_cluster("colour", ["a"])


def test_large_clusters_are_chunked_and_stitched(spark):
    rows = [("c", f"m{i:02d}") for i in range(7)] + [("d", "alone")]
    found = adjudicate.verify_clusters(frame(spark, rows, "cluster string, member string"), DecisionTable(merge_all=True), "entity", 3)
    assert pairs(found.select("cluster", "canonical_label", "member")) == {("c", "m00", f"m{i:02d}") for i in range(7)} | {("d", "alone", "alone")}


def test_rounds_converge(spark):
    words = ["red ring", "red rings", "blue box", "blue boxes", "green"]
    vectors = frame(spark, [(w, [float(w[0] == k) for k in "rbg"]) for w in words], "text string, vec array<float>")
    labels = frame(spark, [(w,) for w in words], "label string")
    found = rounds.round_loop(labels, DecisionTable(merge_all=True), "entity", 0.9, vectors=vectors)
    assert pairs(found) == {("red ring", "red ring"), ("red ring", "red rings"), ("blue box", "blue box"), ("blue box", "blue boxes"), ("green", "green")}
    kept = rounds.round_loop(labels, DecisionTable(), "entity", 0.9, vectors=vectors)
    assert all(r["canonical_label"] == r["member"] for r in kept.collect())


# ------------------------------------------------------------ vocabularies


def test_assembly_and_last_wins(spark):
    counted = vocab.normalize_and_count(frame(spark, [("Film",), ("film",), ("Movie",), ("Ocean ",)], "surface string"))
    groups = frame(spark, [(0, "film", "film"), (0, "movie", "film"), (1, "ocean", "movie")], "group int, member string, canonical_label string")
    items, to_id = vocab.assemble(counted, groups, "type", "type", 4)
    rows = {r["item_id"]: r for r in items.collect()}
    assert rows["type_0000"]["count_per_normalized"] == 3 and rows["type_0000"]["surface_forms"] == ["Film", "Movie", "film", "movie"]
    assert rows["type_0000"]["surface_form_counts"]["movie"] == 0
    assert {r["surface"]: r["item_id"] for r in to_id.collect()}["movie"] == "type_0001"


# ------------------------------------------------------------ profiles


def test_labels_equal_under_nfkc_are_one_item_and_resolve(spark):
    forms = ["Full width", "\uff26\uff35\uff2c\uff2c width", "fine", "\ufb01ne", "x2", "x\u00b2", "a b", "a\u00a0b", "caf\u00e9", "cafe\u0301", "a\u2028b", "a\x1fb"]
    items, to_id = vocab.vocabulary(frame(spark, [(s,) for s in forms], "surface string"), "type", "type", 4)
    assert {r["canonical_label"]: r["count_per_normalized"] for r in items.collect()} == {"full width": 2, "fine": 2, "x2": 2, "a b": 4, "caf\u00e9": 2}
    ids = {r["canonical_label"]: r["item_id"] for r in items.collect()}
    unseen = frame(spark, [("F\uff35LL\u3000WIDTH", "\uff46ine", "\uff38\u00b2")], "subject_type string, object_type string, relation string")
    found = resolve.resolve_relation(resolve.resolve_types(unseen, to_id), to_id).first()
    assert (found["subject_type_id"], found["object_type_id"], found["relation_id"]) == (ids["full width"], ids["fine"], ids["x2"])
    types = items.select("item_id", "canonical_label")
    _, entity_ids = vocab.vocabulary(frame(spark, [("\u00c9t\u00e9 [fine]",)], "surface string"), "entity", "ent", 5, T.normalize_compound)
    row = frame(spark, [("E\u0301te\u0301", ids["fine"], "\uff25\u0301t\u00e9", ids["fine"])], "subject string, subject_type_id string, object string, object_type_id string")
    assert resolve.resolve_entities(row, types, entity_ids).select("subject_id", "object_id").first() == ("ent_00000", "ent_00000")
    known = frame(spark, [(t, "object", "\ufb01ne") for t in ("x2", "fine")], "relation string, role string, type string")
    assert pairs(vocab.bridge_relation_types(known, to_id, to_id.filter("surface not like '%\ufb01%'")).select("relation_id", F.array_join("type_ids", "|"))) == {(ids["x2"], ids["fine"]), (ids["fine"], ids["fine"])}


def test_weights_and_precision(spark):
    counts = frame(spark, [("t", "r", 2.0), ("t", "q", 1.0), ("u", "r", 1.0)], "type string, relation string, weight double")
    ppmi = {(r["type"], r["relation"]): r["weight"] for r in profiles.weigh(counts).collect()}
    assert ppmi == {("u", "r"): pytest.approx(math.log(4 / 3)), ("t", "q"): pytest.approx(math.log(4 / 3))}
    raw = {(r["child"], r["parent"]): r["precision"] for r in profiles.weeds_precision(counts).collect()}
    assert raw == {("t", "u"): pytest.approx(2 / 3), ("u", "t"): 1.0}
    assert pairs(profiles.in_degree(profiles.weeds_precision(counts), 0.75)) == {("t", 1)}
    with pytest.raises(ValueError):
        profiles.weigh(counts, "other")


def test_bands_start_at_their_first_score(spark):
    scored = frame(spark, [("a", 20), ("b", 12), ("c", 9), ("d", 1), ("e", 0)], "type string, votes long")
    found = {r["type"]: r["band"] for r in profiles.priority_bands(scored, 10).collect()}
    assert found == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 1}


# ------------------------------------------------------------ trees


def test_closure_and_common_ancestors(spark, up):
    assert pairs(up.filter("node = 'd'").select("ancestor", "depth")) == {("d", 0), ("b", 1), ("a", 2)}
    members = frame(spark, [(1, "d"), (1, "e"), (2, "d"), (2, "c"), (3, "d"), (3, "x"), (4, "d")], "k int, node string")
    assert pairs(tree.lca(members, up, ["k"])) == {(1, "b"), (2, "a"), (3, None), (4, "d")}


def test_long_chains_and_cycles_end(spark):
    chain = frame(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "child string, parent string")
    deep = tree.closure(chain, chain.select(F.col("child").alias("node")))
    assert deep.filter("node = 'n000'").agg(F.max("depth")).first()[0] == 150
    ring = frame(spark, [("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert tree.closure(ring, ring.select(F.col("child").alias("node"))).count() == 9


def test_edits(spark, forest, nodes, up):
    same, why = tree.sandbox_reparent(forest, up, "b", "d")
    assert "cycle" in why and pairs(same) == pairs(forest)
    assert tree.sandbox_reparent(forest, up, "b", "a")[1] == "no change"
    moved, why = tree.sandbox_reparent(forest, up, "d", "c")
    assert not why and ("d", "c") in pairs(moved) and ("d", "b") in pairs(forest)
    left, kept, gone = tree.delete_subtree(nodes, forest, up, "b")
    assert pairs(left) == {("a",), ("c",), ("x",)} and pairs(kept) == {("c", "a")} and pairs(gone) == {("b",), ("d",), ("e",)}
    with pytest.raises(ValueError):
        tree.delete_subtree(nodes, forest, up, "zz")
    typed = frame(spark, [(1, "d"), (2, "d"), (2, "c"), (3, "x")], "entity_id int, type_id string")
    assert pairs(tree.delete_impact(typed, gone, up)) == {(1, "reassigned", "a"), (2, "narrowed", None)}


def test_parent_keys_do_not_meet(nodes, forest):
    found = {r["node"]: (r["tag"], r["key"]) for r in tree.parent_key(nodes, forest).collect()}
    assert found["a"] == ("self", "a") and found["b"] == found["c"] == ("parent", "a")


# ------------------------------------------------------------ constraints


def test_tiers_and_directions(spark, up):
    rows = [("r", "r", "d", "x")] * 9 + [("r", "inv", "x", "e")] + [("one", "one", "d", "d")]
    typed = frame(spark, rows, "relation_id string, surface string, subject_type_id string, object_type_id string")
    said = frame(spark, [("r", "inv", "inverted")], "relation_id string, surface string, direction string")
    directions = constraints.classify_directions(typed.select("relation_id", "surface").distinct(), said)
    found = {r["relation_id"]: r for r in constraints.induce(typed, up, directions).collect()}
    assert (found["r"]["domain"], found["r"]["range"], found["r"]["support"], found["r"]["strength"]) == ("b", "x", 10, "hard")
    assert found["one"]["strength"] == "soft"
    assert constraints.induce(typed.limit(0), up).count() == 0


def test_boundaries(spark):
    rows = [(90, 100), (89, 100), (50, 100), (20, 100), (19, 100), (2, 2)]
    support = frame(spark, [(str(i), "d", "r", s, t, s / t) for i, (s, t) in enumerate(rows)], "relation_id string, domain string, range string, support long, total long, pca_confidence double")
    found = {r["relation_id"]: r["strength"] for r in constraints.with_strength(support, True).collect()}
    assert [found[str(i)] for i in range(6)] == ["hard", "soft", "soft", "hint", "below_hint", "soft"]


# ------------------------------------------------------------ graphs and similarity


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    owner = {}

    def find(x):
        while owner.setdefault(x, x) != x:
            x = owner[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        owner[max(p, q)] = min(p, q)
    found = {r["node"]: r["component"] for r in similarity.components(frame(spark, edges, "a int, b int")).collect()}
    assert all(found[x] == find(x) for x in found) and set(found) == {x for a, b in edges if a != b for x in (a, b)}


def test_blocked_pairs_match_plain(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(70, 8)).astype(np.float32)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if float(unit[i] @ unit[j]) >= 0.5}
    vectors = frame(spark, [(i, r.tolist()) for i, r in enumerate(rows)], "id int, vec array<float>")
    assert pairs(similarity.similar_pairs(vectors, 0.5, block=16).select("a", "b")) == want
    assert similarity.threshold_counts(vectors, [0.5], block=16).first()["pairs"] == len(want)
    assert set(similarity.linkage_clusters(unit, 0.5)) == {min(c) for c in _plain_components(want, 70)}


def _plain_components(links, n):
    groups = {i: {i} for i in range(n)}
    for a, b in links:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    return list({id(g): g for g in groups.values()}.values())


def test_hops_take_each_edge_once(spark):
    edges = frame(spark, [(1, "a", "r", "b"), (1, "b", "r", "c"), (1, "c", "r", "d"), (1, "y", "r", "z"), (1, "a", "loop", "a")], "sample_id int, s string, r string, o string")
    seeds = frame(spark, [(1, "a")], "sample_id int, node string")
    assert pairs(graph.hops(edges, seeds, 2).select("s", "o", "hop")) == {("a", "b", 1), ("a", "a", 1), ("b", "c", 2)}


def test_graph_metrics(spark):
    found = graph.metrics(frame(spark, [("a", "r", "b"), ("c", "r", "c")], "s string, r string, o string")).first()
    assert (found["triples"], found["nodes"], found["components"], found["giant"], found["leaf_share"]) == (2, 3, 2, 2, 0.6667)


def test_whole_graph_queries_take_all_kinds(spark):
    """Against brute force over all triplets of sf0.001."""
    sf = "/root/testdata/sf0.001"
    e = {tuple(r) for r in queries.edges(spark, sf).select("sample_id", "s", "r", "o").collect()}
    near: dict = defaultdict(lambda: defaultdict(set))
    for sample, s, _, o in e:
        near[sample][s].add(o)
        near[sample][o].add(s)
    hop = {}
    for sample in near:
        front = {min(s for k, s, _, _ in e if k == sample)}
        for depth in range(5):
            hop |= {(sample, n): depth for n in front if (sample, n) not in hop}
            front = {m for n in front for m in near[sample][n] if (sample, m) not in hop}
    want = {(*x, min(hop.get((x[0], n), 9) for n in (x[1], x[3])) + 1) for x in e if (x[0], x[1]) in hop or (x[0], x[3]) in hop}
    assert pairs(queries.QUERIES["g7_supporting_edges"](spark, sf)) == want
    at = {}

    def root(n):
        while at.setdefault(n, n) != n:
            at[n] = n = at[at[n]]
        return n

    for _, s, _, o in e:
        at[root(s)] = root(o)
    sizes = Counter(root(n) for n in list(at))
    every = queries.edges(spark, sf).count()
    assert queries.QUERIES["l3_essay_graphs"](spark, sf).count() == every > len(e)
    qualified = queries.triplets(spark, sf).filter("size(qualifiers) > 0").count()
    assert queries.QUERIES["f17_light_folding"](spark, sf).agg(F.sum("n")).first()[0] == qualified
    found = queries.QUERIES["m1_graph_metrics"](spark, sf).first()
    assert (found["triples"], found["nodes"]) == (len({x[1:] for x in e}), len(at))
    assert (found["components"], found["giant"]) == (len(sizes), max(sizes.values()))


def test_positional_zip_guards_length(spark):
    left = frame(spark, [(1, ["a", "b"]), (2, ["c"])], "k int, a array<string>")
    right = frame(spark, [(1, [True, False]), (2, [True, True])], "k int, b array<boolean>")
    assert pairs(resolve.positional_zip(left, right, "k", "a", "b")) == {(1, 0, "a", True), (1, 1, "b", False), (2, 0, "c", None)}


# ------------------------------------------------------------ entities and placement


def test_entities_merge_only_where_the_forest_allows(spark, forest, nodes):
    rows = [("big ship", "d"), ("big ships", "e"), ("big ship", "x"), ("other", "d")]
    said = DecisionTable(merge_all=True)
    found = {(r["name"], r["type_id"]): r["entity"] for r in entities.deduplicate(frame(spark, rows, "name string, type_id string"), nodes, forest, said, 0.6).collect()}
    assert found["big ship", "d"] == found["big ships", "e"]
    assert found["big ship", "x"] != found["big ship", "d"] != found["other", "d"]
    kept = entities.deduplicate(frame(spark, rows, "name string, type_id string"), nodes, forest, DecisionTable(), 0.6)
    assert kept.select("entity").distinct().count() == 4


@pytest.mark.parametrize("cap", [40, 2])
def test_unequal_names_of_different_sibling_groups_meet_under_their_root(spark, forest, nodes, cap):
    """c and d have different parents under a; with cap 2 they lie in different buckets and meet in the last pass."""
    rows = [("united states", "c"), ("united state", "d"), ("united states", "x"), ("zebra", "c"), ("quick fox", "d"), ("zebra", "e")]
    table = frame(spark, rows, "name string, type_id string")
    found = {(r["name"], r["type_id"]): r for r in entities.deduplicate(table, nodes, forest, DecisionTable(merge_all=True), 0.6, cap).collect()}
    assert len(found) == len(rows)
    one = [{k for k, r in found.items() if r["entity"] == e} for e in {r["entity"] for r in found.values()}]
    want = [{("united states", "c"), ("united state", "d")}, {("united states", "x")}, {("zebra", "c"), ("zebra", "e")}, {("quick fox", "d")}]
    assert sorted(map(sorted, one)) == sorted(map(sorted, want))
    assert all(len({r["canonical"] for r in found.values() if r["entity"] == e}) == 1 for e in {r["entity"] for r in found.values()})
    apart = entities.deduplicate(table, nodes, forest, DecisionTable(), 0.6, cap)
    assert apart.select("entity").distinct().count() == len(rows)


def test_placement():
    said = DecisionTable(parents={("documentary film", "*"): {"parent": "film"}, ("movie", "*"): {"parent": "film", "same_concept": True}}, children={("work", "*"): ["film"]})
    placed = Placement(said).run([("t0", "film"), ("t1", "documentary film"), ("t2", "ocean"), ("t3", "movie"), ("t4", "work")])
    assert placed.parent == {"t1": "t0", "t0": "t4"} and set(placed.roots) == {"t2", "t4"} and placed.alias == {"t3": "t0"}


def test_bulk_claims_are_refused_and_depth_defers():
    names = [(f"t{i}", f"n{i}") for i in range(6)]
    greedy = DecisionTable(children={("n5", "*"): [n for _, n in names[:5]]})
    assert not Placement(greedy).run(names).parent
    deep = DecisionTable(parents={("n1", "*"): {"parent": "n0"}, ("n2", "*"): {"parent": "n0"}})
    placed = Placement(deep, Settings(max_depth=1)).run(names[:3])
    assert placed.unresolved == {"t0": ["t1", "t2"]}


def test_seeds_and_regrouping():
    said = DecisionTable(regroups={"*": [{"label": "group", "members": ["n0", "n1", "n2"]}]})
    placed = Placement(said, Settings(batch=3)).run([(f"t{i}", f"n{i}") for i in range(5)], [{"label": "seed", "description": "d", "children": ["n4", "n4"]}])
    assert placed.parent["t4"] == "type_seed0000" and placed.definitions["type_seed0000"] == "d"
    assert placed.parent["t0"] == "type_h0000" and all(len([p for c, p, *_ in placed.edges() if c == n]) <= 1 for n in placed.labels)


# ------------------------------------------------------------ sources, runs, streams


def test_seed_shapes():
    assert formats.seed_roots(["a"]) == ["a"] and formats.seed_roots({"seed_roots": ["b"]}) == ["b"] and formats.seed_roots({"x": 1}) == []
    with pytest.raises(ValueError):
        formats.seed_roots("a")
    assert formats.flatten_seeds([{"label": "A B", "children": ["c", {"label": "D"}]}]) == [("a b", None, None, 0), ("c", None, "a b", 1), ("d", None, "a b", 1)]
    config, unknown = formats.config_from({"max_rounds": 2, "what": 1, "hierarchy": {"batch": 5, "no": 2}})
    assert config.max_rounds == 2 and config.hierarchy.batch == 5 and unknown == ["what", "hierarchy.no"]


def test_jsonl_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    items = frame(spark, [(1, "a"), (2, "b")], "id long, text string")
    assert formats.append_new(items.filter("id = 1"), path, "id", lambda d: d) == 1
    assert formats.append_new(items, path, "id", lambda d: d) == 1
    assert pairs(formats.read_jsonl(spark, path, "id long, text string")) == {(1, "a"), (2, "b")}
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception):
        formats.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_runs_number_and_resume(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    assert runs.start() == 1 and runs.start(resume=True) == 1
    made = []
    one = frame(spark, [(1,)], "x int")
    for _ in range(2):
        runs.step(1, "s", lambda: made.append(1) or one)
    assert len(made) == 1 and runs.start() == 2 and runs.start(resume=True) == 1
    runs.save_metadata(1, {"a": None})
    assert runs.metadata(1) == {"a": None}
    assert runs.copy_with(1, {}, ["s"]) == 2 and runs.load(2, "s").count() == 1


def test_streamed_triplets(spark, tmp_path):
    from tripleloom.streaming import ingest

    row = {"subject": "a", "subject_type": "t", "relation": " Likes ", "object": "b", "object_type": "t"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"object": "c"})))
    stream = ingest.read_triplet_stream(spark, f"{tmp_path}/in")
    counted = ingest.distinct_triplets(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    totals = ingest.relation_counts(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    for q in (counted, totals):
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 2 and pairs(spark.table("totals")) == {("likes", 3)}


def test_whole_run(spark, tmp_path):
    from tripleloom.plans.knowledge_graph import run

    t = [("Ann", "person", "likes", "Film A", "film", None), ("Bob", "person", "likes", "Film B", "film", None), ("Cid", "person", "likes", "Film C", "Film", None), (None, "x", "y", "z", "w", None)]
    triplets = frame(spark, t, "subject string, subject_type string, relation string, object string, object_type string, qualifiers array<struct<relation:string,object:string,object_type:string>>")
    runs = Runs(spark, f"file://{tmp_path}/runs")
    number = run(triplets, runs, DecisionTable())
    found = runs.load(number, "constraints").collect()
    assert len(found) == 1 and found[0]["support"] == 3 and found[0]["strength"] == "hard"
    assert run(triplets, runs, DecisionTable(), resume=True) == number


def test_compare_types_reports_missing_gold_and_failures(spark):
    from tripleloom.operators.adjudicate import compare_types

    class Judge:
        def compare_types(self, ours, gold):
            if ours == "bad":
                raise RuntimeError("no answer")
            return "exact" if ours == gold else None

    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", None), (3, "bad", "a"), (4, "a", "b"), (5, "a", "a"), (6, None, "")], "id int, ours string, gold string")
    got = {r["id"]: r["label"] for r in compare_types(pairs, Judge()).collect()}
    assert got == {1: "exact", 2: "no_gold_type", 3: "judge_call_failed", 4: None, 5: "exact", 6: "no_gold_type"}


def test_directions_default_to_forward(spark):
    from tripleloom.operators.adjudicate import classify_directions

    class Judge:
        def classify_directions(self, relation, surfaces):
            if relation == "broken":
                raise RuntimeError("no answer")
            return {"owned by": "inverted", "odd": "sideways"}

    rows = [("own", "owns"), ("own", "owned by"), ("own", "odd"), ("broken", "x"), ("broken", "y"), ("lone", "owned by")]
    got = {(r["relation"], r["surface"]): r["direction"] for r in classify_directions(spark.createDataFrame(rows, "relation string, surface string"), Judge(), cap=2).collect()}
    assert got.pop(("own", "owned by")) == "inverted"
    assert set(got.values()) == {"forward"} and len(got) == 5


def test_repair_answers_separates_what_cannot_be_trusted(spark):
    from tripleloom.operators.adjudicate import repair_answers

    said = '{"groups": [{"canonical_label": "A", "members": ["a", "a1"]}]}'
    rows = [(1, ["a", "a1", "b"], said), (2, ["a", "a1"], "no idea"), (3, ["a", "a1"], None)]
    got = {(r["cluster"], r["canonical_label"], r["member"]) for r in repair_answers(spark.createDataFrame(rows, "cluster int, members array<string>, answer string")).collect()}
    assert got == {(1, "a", "a"), (1, "a", "a1"), (1, "b", "b"), (2, "a", "a"), (2, "a1", "a1"), (3, "a", "a"), (3, "a1", "a1")}


def test_calls_are_repeated_until_an_answer_or_a_final_status():
    from tripleloom.operators.calls import ask_until

    class Refused(Exception):
        def __init__(self, status_code):
            super().__init__(f"status {status_code}")
            self.status_code = status_code

    def after(n, error):
        said = iter([error] * n)

        def ask(given):
            found = next(said, None)
            if found:
                raise found
            return given

        return ask

    waits = []
    assert ask_until(after(2, Refused(500)), "x", sleep=waits.append) == ("x", None, 3) and waits == [2.0, 4.0]
    assert ask_until(after(9, Refused(500)), "x", sleep=waits.append)[2] == 5
    for status in (401, 402, 403, 404):
        answer, error, attempts = ask_until(after(1, Refused(status)), "x", sleep=waits.append)
        assert answer is None and str(status) in error and attempts == 1
    assert ask_until(lambda _: None, "x", tries=2, sleep=waits.append) == (None, "no answer", 2)


def test_completions_carry_their_usage(spark):
    from tripleloom.operators.calls import binary_verdict, complete, usage

    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper(), len(prompt), 2

    prompts = spark.createDataFrame([(1, "yes 1, not 0"), (2, "bad"), (3, "none")], "id int, prompt string")
    answers = complete(prompts, client, tries=2, pause=lambda n: 0.0)
    assert {(r["id"], r["v"]) for r in answers.select("id", binary_verdict(answers.answer).alias("v")).collect()} == {(1, 1), (2, None), (3, 0)}
    assert usage(answers, 1e6, 2e6).first().asDict() == {"calls": 3, "failures": 1, "prompt_tokens": 16, "completion_tokens": 4, "cost": 24.0}
    assert usage(answers.limit(0)).first().asDict() == {"calls": 0, "failures": 0, "prompt_tokens": 0, "completion_tokens": 0, "cost": 0.0}


def test_failed_items_are_tried_in_passes(spark):
    from pyspark.sql import functions as F

    from tripleloom.operators.calls import retry_passes

    seen = []

    def process(todo, n):
        seen.append(todo.count())
        return todo.withColumn("ok", F.when(F.col("k") < 100, F.col("k") <= n))

    items = spark.createDataFrame([(0,), (1,), (2,), (3,), (100,)], "k int")
    found = {r["k"]: (r["ok"], r["attempts"]) for r in retry_passes(items, process, "k").collect()}
    assert found == {0: (True, 1), 1: (True, 2), 2: (True, 3), 3: (False, 3), 100: (None, 3)} and seen == [5, 4, 3]
    assert retry_passes(items.limit(0), process, "k").count() == 0


def test_summary_of_nothing_and_unknown_labels(spark):
    from tripleloom.operators.evaluate import full_summary, label_distribution, plausibility_sides, tier_counts

    gold = spark.createDataFrame(
        [("a", True, False, "same", "hard", False, "exact", False), ("a", True, False, "inverse", None, None, "odd", False), ("b", True, False, "same", "soft", None, None, True), ("b", False, True, None, None, None, None, False)],
        "domain string, matched boolean, failed boolean, direction string, strength string, containment_ok boolean, label string, lost boolean",
    )
    sentences = spark.createDataFrame([("a", 4, 2, 0), ("c", 0, 0, 1)], "domain string, generated int, extras int, call_failures int")
    rows = {r["domain"]: r for r in full_summary(gold, sentences, "domain").collect()}
    assert (rows[None]["gold"], rows[None]["recall"], rows[None]["extra_rate"], rows[None]["containment_violations"]) == (4, 1.0, 0.5, 1)
    assert rows["c"]["gold"] == 0 and rows["c"]["recall"] is None and rows["c"]["extra_rate"] is None and rows["c"]["call_failures"] == 1
    assert rows["a"]["without_constraint"] == 1 and rows["b"]["failed"] == 1
    assert full_summary(gold.limit(0), sentences.limit(0)).first()["recall"] is None
    found = {r["label"]: r["n"] for r in label_distribution(gold, "label", "lost").collect()}
    assert found == {"exact": 1, "more_general": 0, "more_narrow": 0, "not_related": 0, "no_gold_type": 1, "judge_call_failed": 1}
    assert {(r["strength"], r["n"]) for r in tier_counts(gold).collect()} == {("hard", 1), ("soft", 1)}
    sides = spark.createDataFrame([(1, "inverted", "inverse", "s", "o", "d", "r"), (2, "forward", "same", "s", "o", "d", "r")], "k int, surface_direction string, direction string, subject_type_id string, object_type_id string, gold_domain string, gold_range string")
    turned = {r["k"]: (r["subject_type_id"], r["object_type_id"], r["gold_domain"], r["gold_range"]) for r in plausibility_sides(sides).collect()}
    assert turned == {1: ("o", "s", "r", "d"), 2: ("s", "o", "d", "r")}


def test_graph_sink_is_sorted_with_stats_beside(spark, tmp_path):
    import json

    from tripleloom.operators import graph
    from tripleloom.sources.formats import write_graph

    resolved = spark.createDataFrame([("b", "r1", "a"), ("c", "r0", "a"), ("b", "r1", "a")], "s string, r string, o string")
    stats = spark.createDataFrame([(3, 2)], "num_input_triplets int, num_relation_triples int")
    write_graph(graph.build(resolved), f"file://{tmp_path}/kg", stats)

    def lines(name):
        return [json.loads(x) for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]

    assert [x["entity"] for x in lines("kg/entities")] == ["a", "b", "c"]
    assert [tuple(x.values()) for x in lines("kg/relations")] == [("b", "r1", "a"), ("c", "r0", "a")]
    assert lines("kg_stats") == [{"num_input_triplets": 3, "num_relation_triples": 2}]
    reasons = spark.createDataFrame([(None,), ("relation",), ("relation",)], "reason string")
    assert [(r["reason"], r["n"]) for r in graph.skip_counts(reasons).collect()] == [("relation", 2)]


def test_groups_are_numbered_by_canonical_label(spark):
    rows = [("b", "b1"), ("a", "a1"), ("b", "b2"), ("c", "c1")]
    merged = spark.createDataFrame(rows, "canonical_label string, member string")
    found = {(r["group"], r["member"], r["canonical_label"]) for r in rounds.as_groups(merged).collect()}
    assert found == {(0, "a1", "a"), (1, "b1", "b"), (1, "b2", "b"), (2, "c1", "c")}
    assert rounds.as_groups(merged.limit(0)).count() == 0
