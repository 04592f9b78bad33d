"""Density clusters, and joins dealt out in blocks, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tripleloom.operators import entities, profiles, similarity
from tripleloom.operators.adjudicate import DecisionTable
from tripleloom.operators.density import density_clusters, density_groups, spanning_tree


def around(rng, axis, n, spread):
    return np.eye(6)[axis] + rng.normal(0, spread, (n, 6))


def test_dense_groups_are_found_and_the_rest_stands_alone():
    rng = np.random.default_rng(4)
    x = np.vstack([around(rng, 0, 6, 0.02), around(rng, 1, 5, 0.02), around(rng, 2, 1, 0.0)])
    assert density_clusters(x, 0.8).tolist() == [0] * 6 + [6] * 5 + [11]
    assert density_clusters(x[:6], 0.8).tolist() == [0] * 6  # one group is one cluster
    assert density_clusters(x[:2], 0.8).tolist() == [0, 0] and density_clusters(np.eye(2), 0.8).tolist() == [0, 1]
    assert density_clusters(x[:1], 0.8).tolist() == [0] and density_clusters(x[:0], 0.8).tolist() == []
    assert density_clusters(np.repeat(np.eye(2), 3, axis=0), 0.8).tolist() == [0, 0, 0, 3, 3, 3]


def test_spanning_tree_is_minimal_and_no_close_pair_is_split():
    rng = np.random.default_rng(9)
    for _ in range(60):
        x = rng.normal(size=(int(rng.integers(2, 30)), 4))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        away = 1 - unit @ unit.T
        root = list(range(len(x)))
        total = 0.0
        for d, a, b in sorted((away[i, j], i, j) for i in range(len(x)) for j in range(i)):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[a] = b
                total += d
        assert np.isclose(sum(e[0] for e in spanning_tree(x)), total)
        threshold = float(rng.choice([0.7, 0.8, 0.95]))
        found, linked = density_clusters(x, threshold), similarity.linkage_clusters(x, threshold)
        assert all(len(set(found[linked == c])) == 1 for c in set(linked))


def test_pools_do_not_meet(spark):
    rows = [(p, i, [1.0, 0.01 * i]) for p in ("a", "b") for i in range(3)] + [("a", 9, [0.0, 1.0])]
    found = density_groups(spark.createDataFrame(rows, "pool string, id long, vec array<double>"), ["pool"], 0.9)
    assert {tuple(r) for r in found.collect()} == {("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 9, 9), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0)}


def test_pairs_of_a_hot_relation_are_met_once_each(spark):
    rows = [(f"t{i:02}", "hot", float(i + 1)) for i in range(23)] + [("t01", "rare", 2.0), ("t07", "rare", 3.0), ("lone", "own", 1.0)]
    df = spark.createDataFrame(rows, "type string, relation string, weight double")
    want = sorted((a, b, r, x, y) for a, r, x in rows for b, q, y in rows if r == q and a < b)
    for block in (1, 4, 100):
        assert sorted(tuple(r) for r in profiles._pairs(df, block).collect()) == want


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[41] = x[17]  # a tie
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 60, 20):
        order = sorted(range(60), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:7]
        want |= {(q, i, n + 1) for n, i in enumerate(order)}
    asked = pool.filter("id % 20 = 0")
    for sizes in ((2048, 8192), (1, 7), (2, 100)):
        found = similarity.nearest(asked, pool, 7, *sizes).select("query_id", "id", "rank")
        assert {tuple(r) for r in found.collect()} == want
    assert similarity.nearest(asked.filter("id < 0"), pool, 7).count() == 0 == similarity.nearest(asked, pool.filter(F.lit(False)), 7).count()


def test_neighbours_of_strings_without_a_side(spark):
    rows = spark.createDataFrame([("oak", [1.0, 0.0]), ("elm", [0.9, 0.1])], "id string, vec array<double>")
    none = rows.filter("id = 'ash'")
    for asked, pool in ((none, rows), (rows, none), (none, none)):
        assert similarity.nearest(asked, pool, 3).collect() == []
    few = similarity.nearest(rows, rows, 1, 1, 1)  # some pairs of blocks may lack a side
    assert {(r["query_id"], r["id"]) for r in few.collect()} == {("oak", "oak"), ("elm", "elm")}


def test_large_partitions_merge_as_small_ones_do(spark):
    words = ["copper pan", "copper pans", "copper  pan lid", "iron pot", "iron pots", "iron pot stand", "tea cup", "tea cups", "Tea cup", "spoon"]
    rows = [(k, w) for k in ("kitchen", "shop", None) for w in words if k != "shop" or "pot" in w] + [("shop", None)]
    e = spark.createDataFrame(rows, "key string, name string")
    for said, cap in ((DecisionTable(merge_all=True), 2), (DecisionTable(), 40)):
        whole = {tuple(r) for r in entities.merge_within(e, ["key"], said, 0.7, cap).collect()}
        dealt = {tuple(r) for r in entities.merge_within(e, ["key"], said, 0.7, cap, pool=3).collect()}
        assert dealt == whole and len(whole) == 23
