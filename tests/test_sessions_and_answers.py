"""What-if sessions, question answering and views on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.operators import constraints, evaluate, graph, linking, sandbox, survey, tree
from tripleloom.operators.adjudicate import DecisionTable
from tripleloom.operators.sandbox import Edit
from tripleloom.operators.similarity import hashed_embedding
from tripleloom.sources.runs import Runs

EDGES = [("tram", "vehicle"), ("bus", "vehicle"), ("night bus", "bus"), ("fern", "plant")]
NODES = ["tram", "vehicle", "bus", "night bus", "fern", "plant", "stone"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def forest(spark):
    return frame(spark, EDGES, "child string, parent string")


@pytest.fixture(scope="module")
def nodes(spark):
    return frame(spark, [(n,) for n in NODES], "node string")


def test_replay_undoes_and_resets(forest, nodes):
    log = [Edit("move", "stone", "plant"), Edit("move", "vehicle", "night bus"), Edit("delete", "bus")]
    n, e, gone = sandbox.replay(nodes, forest, log)
    assert rows(e) == {("tram", "vehicle"), ("fern", "plant"), ("stone", "plant")}
    assert rows(gone) == {("bus",), ("night bus",)} and rows(n) == {(x,) for x in NODES} - rows(gone)
    _, undone, gone = sandbox.replay(nodes, forest, log, len(log) - 1)
    assert rows(undone) == set(EDGES) | {("stone", "plant")} and not rows(gone)
    assert rows(sandbox.replay(nodes, forest, log, 0)[1]) == set(EDGES)
    with pytest.raises(ValueError):
        sandbox.replay(nodes, forest, [Edit("paint", "bus")])


def test_a_session_is_saved_without_losing_entities(spark, forest, nodes, tmp_path):
    runs = Runs(spark, str(tmp_path))
    runs.save(1, "hierarchy", forest)
    runs.save(1, "entities", frame(spark, [(1, "bus"), (2, "bus"), (2, "fern"), (3, "night bus"), (4, "fern"), (5, "vehicle")], "entity_id int, type_id string"))
    runs.save(1, "constraints", frame(spark, [("stops at", "bus", "stone"), ("grows on", "fern", "stone"), ("holds", "stone", "bus"), ("pair", "bus", "bus")], "relation_id string, domain string, range string"))
    up = tree.closure(forest, nodes)
    _, edges, gone = sandbox.replay(nodes, forest, [Edit("delete", "bus")])
    new = sandbox.save_as_run(runs, 1, ["hierarchy", "entities", "constraints"], edges, gone, up)
    assert new == 2
    assert rows(runs.load(2, "entities")) == {(1, "vehicle"), (2, "fern"), (3, "vehicle"), (4, "fern"), (5, "vehicle")}
    assert rows(runs.load(2, "constraints").select("relation_id")) == {("grows on",)}
    assert sandbox.stale_constraints(runs.load(1, "constraints"), gone).count() == 3
    assert rows(runs.load(2, "hierarchy")) == {("tram", "vehicle"), ("fern", "plant")}
    counts = rows(runs.overview(["entities", "merged"]))
    assert counts == {(1, "entities", 6), (1, "merged", None), (2, "entities", 5), (2, "merged", None)}


def test_an_entity_without_a_surviving_ancestor_stays_untyped(spark, forest, nodes):
    e = frame(spark, [(1, "stone")], "entity_id int, type_id string")
    gone = frame(spark, [("stone",)], "node string")
    assert rows(sandbox.carry_deletions(e, gone, tree.closure(forest, nodes))) == {(1, None)}


def test_merge_candidates_are_new_alike_and_touched(spark, forest, nodes):
    new, reason = tree.sandbox_reparent(forest, tree.closure(forest, nodes), "fern", "vehicle")
    assert not reason
    people = [("line one", "tram"), ("line two", "bus"), ("Line One", "fern"), ("line one", "fern"), ("moss", "fern"), ("line one", "stone")]
    e = frame(spark, people, "name string, type_id string")
    touched = tree.affected_types(tree.closure(forest, nodes), forest, "fern", "vehicle")
    found = sandbox.merge_candidates(e, tree.parent_key(nodes, forest), tree.parent_key(nodes, new), touched, 0.75)
    assert {(r["type_a"], r["name_a"], r["type_b"], r["name_b"]) for r in found.collect()} == {("fern", "line one", "tram", "line one"), ("fern", "Line One", "tram", "line one")} | {
        ("bus", "line two", "fern", n) for n in ("line one", "Line One") if float(hashed_embedding(["line two"])[0] @ hashed_embedding([n])[0]) >= 0.75
    }
    merged = rows(sandbox.remerge(e, nodes, new, touched, DecisionTable(merge_all=True)).select("name"))
    assert ("moss",) in merged and "stone" not in {r["key"] for r in sandbox.remerge(e, nodes, new, touched, DecisionTable()).collect()}


QUESTIONS = [(1, "Who planted the oak?", ["Ada", "Ada of Wye"]), (2, "Where is it?", ["nowhere"]), (3, "What of the elm?", ["a bench"])]


@pytest.fixture(scope="module")
def graphs(spark):
    edges = frame(spark, [(1, "oak", "planted by", "Ada"), (1, "Ada", "lives in", "Wye"), (1, "Wye", "lies on", "river"), (3, "elm tree", "shades", "bench")], "sample_id int, s string, r string, o string")
    names = edges.select("sample_id", F.explode(F.array("s", "o")).alias("entity")).distinct()
    return edges, names.select("sample_id", "entity", F.col("entity").alias("name"), F.lit("thing").alias("type"))


def test_questions_are_answered_from_their_own_sample(spark, graphs):
    edges, index = graphs
    asked = frame(spark, QUESTIONS, "sample_id int, question string, answers array<string>")

    class Reader(DecisionTable):
        def answer(self, question, facts):
            if "elm" in question:
                raise RuntimeError("no line")
            return next(o for s, r, o in facts if r == "planted by") + "!"

    said = Reader(mentioned={QUESTIONS[0][1]: ["OAK"], QUESTIONS[2][1]: ["elm", " "]}, relevant={QUESTIONS[2][1]: ["elm tree", "moon"]})
    found = {r["sample_id"]: r for r in linking.answer_samples(asked, edges, index, said, depth=2).collect()}
    one, two, three = found[1], found[2], found[3]
    assert (one["predicted"], one["num_edges"], one["num_linked"], one["num_supporting"], one["em"], one["f1"], one["error"]) == ("Ada!", 3, 1, 2, True, 1.0, None)
    assert (two["error"], two["em"], two["f1"], two["num_edges"]) == ("no_resolved_triplets_for_sample", False, 0.0, 0)
    assert (three["predicted"], three["num_linked"], three["num_supporting"], three["em"], three["f1"]) == ("", 1, 1, False, 0.0)


def test_exact_mentions_come_first_and_candidates_stay_in_their_sample(spark, graphs):
    _, index = graphs
    asked = frame(spark, QUESTIONS, "sample_id int, question string, answers array<string>")
    mentions = frame(spark, [(1, 0, "riverside"), (1, 1, "wye"), (1, 2, "Oak"), (3, 0, "oak")], "sample_id int, ord int, mention string")
    said = DecisionTable(relevant={QUESTIONS[0][1]: ["river", "Wye", "Wye"], QUESTIONS[2][1]: ["oak", "bench"]})
    found = linking.link_mentions(asked, index, mentions, said)
    assert rows(found) == {(1, 1, "Wye"), (1, 2, "oak"), (1, 3, "river"), (3, 1, "bench")}
    assert rows(linking.link_mentions(asked, index, mentions, said, k=1)) == {(1, 1, "Wye"), (1, 2, "oak"), (1, 3, "river")} | ({(3, 1, "bench")} if nearest_name("oak", ["elm tree", "bench"]) == "bench" else set())


def nearest_name(text, names):
    scores = hashed_embedding(names) @ hashed_embedding([text])[0]
    return sorted(zip(-np.round(scores, 6), names))[0][1]


def test_retrieval_walks_two_hops_from_the_nearest(spark, graphs):
    edges, _ = graphs
    mentions = frame(spark, [(1, "oak"), (3, "elms")], "sample_id int, mention string")
    assert rows(linking.retrieve(edges, mentions)) == {(1, "oak", "planted by", "Ada", 1), (1, "Ada", "lives in", "Wye", 2), (3, "elm tree", "shades", "bench", 1)}


def test_essay_graphs_where_labels_are_known(spark):
    """Known labels ask nobody; an unknown one drops its triplet; both give rows of their own."""
    said = [(1, 1, "Oak", "Tree", "shades", "bench", "seat"), (1, 2, "OAK", "tree", "Shades", "Bench", "seat"), (1, 3, "oak", "seat", "shades", "elm", "tree"), (2, 1, "OAK", "tree", "shades", "oak", "tree"), (2, 2, "OAK", "tree", "shades", "oak", "tree")]
    fields = "essay long, ord long, subject string, subject_type string, relation string, object string, object_type string"
    known = frame(spark, [("tree",), ("seat",)], "canonical string"), frame(spark, [("shades",)], "canonical string")
    want = [(1, 1, "Oak", "shades", "bench"), (1, 2, "Oak", "shades", "bench"), (1, 3, "oak", "shades", "elm"), (2, 1, "OAK", "shades", "OAK"), (2, 2, "OAK", "shades", "OAK")]
    graph_rows, dropped = linking.link_and_deduplicate(frame(spark, said, fields), *known, DecisionTable())
    assert sorted(tuple(r) for r in graph_rows.collect()) == want and rows(dropped) == {(0, 0)}
    more = [(3, 1, "Oak", "cloud", "shades", "bench", "seat"), (3, 2, "Oak", "tree", "eats", "bench", "seat")]
    graph_rows, dropped = linking.link_and_deduplicate(frame(spark, said + more, fields), *known, DecisionTable())
    assert sorted(tuple(r) for r in graph_rows.collect()) == want and rows(dropped) == {(1, 1)}
    nothing = frame(spark, [], "canonical string")
    graph_rows, dropped = linking.link_and_deduplicate(frame(spark, said, fields), known[0], nothing, DecisionTable())
    assert graph_rows.count() == 0 and rows(dropped) == {(0, 5)}


def test_closest_names_are_those_of_a_plain_scan():
    names = [f"Customer#{i * 37 % 500:06}" for i in range(300)] + ["oak tree", "Oak tree", "oak trees", ""]
    vectors = None
    for n, vec in enumerate(hashed_embedding(names)):
        scored = sorted((-float(v @ vec), m) for m, v in zip(names[:n], vectors[:n] if n else []))
        for floor, most in ((0.7, 5), (0.2, 1), (0.95, 400)):
            assert n == 0 or linking._closest(vec, names[:n], vectors, floor, most) == [m for s, m in scored if -s >= floor][:most]
        vectors = linking._with(vectors, n, vec)


def test_seed_tree_stops_at_its_target(spark):
    children = {"root": ["a", "b", "c"], "a": ["d", "e", "f"], "b": ["e", "g"], "d": ["h", "i"], "g": ["k"]}
    edges = frame(spark, [(c, p) for p, cs in children.items() for c in cs], "child string, parent string")

    def plain(target, top):
        seen, front = {"root": (None, 0)}, ["root"]
        while front and len(seen) < target:
            at = front.pop(0)
            if seen[at][1] >= 3:
                continue
            for child in sorted(children.get(at, []), key=lambda x: (-len(children.get(x, [])), x))[:top]:
                if child not in seen and len(seen) < target:
                    seen[child] = (at, seen[at][1] + 1)
                    front.append(child)
        return {(n, p, d) for n, (p, d) in seen.items()}

    start = frame(spark, [("root",)], "node string")
    for target in (1, 3, 5, 7, 20):
        for top in (1, 2, 3):
            assert rows(survey.seed_tree(edges, start, 3, top, target)) == plain(target, top)


def test_selection_says_what_it_left_out(spark):
    n = frame(spark, [("p", "person"), ("d", "film"), ("o", "sea")], "node string, type_id string")
    e = frame(spark, [("p", "r", "d")], "s string, r string, o string")
    picked = frame(spark, [("film",)], "type_id string")
    assert rows(graph.selection_subgraph(n, e, picked, 9)) == {("d", True, False), ("p", False, False)}
    assert rows(graph.selection_subgraph(n, e, picked, 1)) == {("d", True, True)}


def test_constraint_groups_and_views_are_ordered(spark):
    k = frame(spark, [("eats", "a", "b", 5, 10, 0.5, "soft"), ("eats", "a", "c", 3, 10, 0.3, "hint"), ("owns", "a", "b", 9, 9, 1.0, "hard"), ("bare", "a", "b", 1, 4, 0.25, "hint")],
              "relation_id string, domain string, range string, support long, total long, pca_confidence double, strength string")
    found = constraints.groups(k).collect()
    assert [r["relation_id"] for r in found] == ["eats", "bare", "owns"]
    assert (found[0]["n"], found[0]["top_strength"], [x["range"] for x in found[0]["rows"]]) == (2, "soft", ["b", "c"])
    assert [(r["relation_id"], r["range"]) for r in constraints.view(k, ["hard", "hint"]).collect()] == [("owns", "b"), ("eats", "c"), ("bare", "b")]
    assert [r["relation_id"] for r in constraints.view(k, ["hard", "soft", "hint"], 0.3, " EAT ").collect()] == ["eats", "eats"]


def test_reports_and_sections(spark):
    long = frame(spark, [("x", "em", 0.2), ("y", "em", 0.7), ("y", "f1", 0.8), ("z", "f1", 0.9)], "report string, metric string, value double")
    assert [tuple(r) for r in evaluate.report_table(long, ["em", "f1"], "em").collect()] == [("y", 0.7, 0.8), ("x", 0.2, None), ("z", None, 0.9)]
    one = frame(spark, [(3, 0.5)], "n int, share double")
    assert rows(evaluate.metric_rows({"graph": one, "types": None})) == {("graph", "n", 3.0), ("graph", "share", 0.5)}
    assert evaluate.metric_rows({"types": None}) is None


def test_tree_rows_and_metrics(spark, forest, nodes):
    up = tree.closure(forest, nodes)
    sums = tree.aggregates(nodes.withColumn("n", F.lit(2)), forest, up)
    names = frame(spark, [("bus", "Bus", ["Bus", "Autobus"] + [f"b{i}" for i in range(9)], True, False)], "node string, label string, surfaces array<string>, is_seed boolean, is_synth boolean")
    found = {r["node"]: r for r in tree.view_rows(sums, nodes, forest, names).collect()}
    assert (found["bus"]["label"], found["bus"]["surfaces"][0], len(found["bus"]["surfaces"]), found["bus"]["is_seed"], found["bus"]["total"]) == ("Bus", "Autobus", 8, True, 4)
    assert (found["vehicle"]["place"], found["vehicle"]["leaves"], found["vehicle"]["label"], found["fern"]["score"]) == (1, 2, "vehicle", None)
    m = tree.metrics(nodes, forest, up, frame(spark, [("plant",)], "node string"), frame(spark, [("", "x"), ("", "y")], "anchor string, node string")).first()
    assert (m["nodes"], m["edges"], m["orphans"], m["synthesized"], m["unresolved"]) == (7, 4, 1, 1, 2)
    placed = frame(spark, [("q", "p", 2), ("r", "p", 1), ("s", "p", 3)], "child string, parent string, pos int")
    assert rows(tree.subclass_labels(placed, frame(spark, [("r", "Ar")], "node string, label string"), 2).select("node", F.array_join("subclasses", ","))) == {("p", "Ar,q")}
