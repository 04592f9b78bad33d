"""Steps that larger tables made too slow or too large: each is held to what it may read, hold or deal out."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tripleloom.functions import text as T
from tripleloom.operators import resolve, vocab
from tripleloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_a_vocabulary_normalises_each_form_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.pandas_udf(StringType())
    def lower(labels: pd.Series) -> pd.Series:
        met.add(len(labels))
        return labels.str.lower()

    surfaces = spark.createDataFrame([(s,) for s in ["Aa", "aa", "B", "B", "c"]], "surface string")
    _, ids = vocab.vocabulary(surfaces, "entity", "ent", 5, lower)
    assert {(r.surface, r.item_id) for r in ids.collect()} == {("Aa", "ent_00000"), ("aa", "ent_00000"), ("B", "ent_00001"), ("b", "ent_00001"), ("c", "ent_00002")}
    assert met.value == 4


def test_known_labels_and_mentions_resolve_as_the_triplets_do(spark):
    t = queries.base(spark, SF)
    type_items, type_ids, relation_ids, entity_ids, labels, mentions = queries.vocabularies(spark, SF, t)
    some = entity_ids.filter("surface not like '%7 [%'"), relation_ids.filter("surface <> 'based in'"), type_ids.filter("surface <> 'region'")
    asked = resolve.resolve_all(t, some[2], some[1], type_items, some[0], labels, mentions)
    plain = resolve.resolve_all(t, some[2], some[1], type_items, some[0])
    assert asked.exceptAll(plain).isEmpty() and plain.exceptAll(asked).isEmpty() and not plain.filter("reason is not null").isEmpty()


def test_trimming_and_compounds_follow_the_patterns(spark):
    blank = r"[\p{Z}\x09-\x0D\x1C-\x1F\x85]+"
    texts = ["", " a ", " b c\x1f", "~", "!", "\x7f", "\x80x", "a [b]", "a  [ B c ] ", "[a] [b]\n", "a[]", "a[[]", " [x]", "é [É] ", "x [y] [z]", "x\t[y]"]
    rows = spark.createDataFrame([(s,) for s in texts], "t string")
    trimmed = F.regexp_replace("t", f"^{blank}|{blank}$", "")
    name, kind = T.normalize_label(T.compound_name(F.col("t"))), T.normalize_label(T.compound_type(F.col("t")))
    plain = F.when(kind == "", name).otherwise(T.compound(name, kind))
    for r in rows.select("t", trimmed.alias("a"), T.clean(F.col("t")).alias("b"), plain.alias("c"), T.normalize_compound(F.col("t")).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


@pytest.mark.parametrize("name", ["j2_resolve_types", "j5_resolve_for_constraints", "r4_bridge_relation_types", "p7_profile_roll_up", "m3_metric_sections"])
def test_what_follows_from_labels_reads_the_triplets_once(spark, monkeypatch, name):
    read, real = [], queries.cut
    written = []

    def once(df):
        out = real(df)
        written.append(out.count() if "qualifiers" in df.columns else 0)
        return out

    monkeypatch.setattr(queries, "triplets", lambda s, sf, f=queries.triplets: read.append(sf) or f(s, sf))
    monkeypatch.setattr(queries, "cut", once)
    queries.QUERIES[name](spark, SF)
    assert len(read) == 1 and max(written) < 1000


class _LinksSome:
    """Takes the first candidate for names that end in 3; remembers what it was asked."""

    def __init__(self):
        self.asked = []

    def link(self, name, candidates):
        self.asked.append((name, tuple(candidates)))
        return candidates[0] if name.endswith("3") else None


def test_a_registry_compares_many_names_at_once_as_one_by_one(monkeypatch):
    from tripleloom.operators import linking
    from tripleloom.operators.similarity import hashed_embedding

    names = [f"{'Ab' if i % 3 else 'ab'} {i * 7 % 113}" for i in range(400)]
    plain, want, known = _LinksSome(), [], {}
    for name in names:
        if name.lower() not in known:
            vec = hashed_embedding([name])[0]
            scored = sorted((-float(v @ vec), n) for n, v in known.values())
            close = [n for s, n in scored if -s >= 0.7][:5]
            same = plain.link(name, close) if close else None
            if same is not None:
                want.append(same)
                continue
            known[name.lower()] = (name, vec)
        want.append(known[name.lower()][0])
    for ahead in (1, 7, 256):
        monkeypatch.setattr(linking, "AHEAD", ahead)
        blocks = _LinksSome()
        registry = linking._Registry(blocks, 0.7, 5, hashed_embedding)
        assert [e for at in range(0, 400, 90) for e in registry.entities(names[at : at + 90])] == want
        assert blocks.asked == plain.asked


def test_partitions_of_an_essay_are_streams_of_their_own(spark):
    from tripleloom.operators.adjudicate import DecisionTable
    from tripleloom.operators.linking import essay_registry

    rows = spark.range(4000).selectExpr("1 as essay", "id as ord", "concat('n', id % 50) as name", "concat('k', id % 8) as key")
    found = essay_registry(rows, DecisionTable()).withColumn("task", F.spark_partition_id())
    assert found.count() == 4000 and found.select("task").distinct().count() > 1


def test_names_stream_past_their_mentions_without_a_table_of_vectors(spark, monkeypatch):
    from tripleloom.operators import linking
    from tripleloom.operators.similarity import hashed_embedding

    index = spark.createDataFrame([(s, f"name {i % 40}", f"name {i % 40}", "t") for s in (1, 2) for i in range(40)], "sample_id long, entity string, name string, type string")
    asked = spark.createDataFrame([(1, "a", " NAME 7 "), (1, "b", "nam 12"), (2, "a", "other"), (3, "a", "name")], "sample_id long, ord string, mention string")
    written, real = [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df: written.append(df.columns) or real(df))
    got = {(r.sample_id, r.ord, r["rank"]): (r.entity, r.exact) for r in linking._ranked(index, asked, 3, hashed_embedding).collect()}
    assert not any("vec" in columns for columns in written)
    names = [f"name {i}" for i in range(40)]
    vectors = hashed_embedding(names).astype("float32").astype("float64")
    for sample, ord_, mention in ((1, "a", "NAME 7"), (1, "b", "nam 12"), (2, "a", "other")):
        vec = hashed_embedding([mention]).astype("float32").astype("float64")[0]
        want = sorted((n != mention.lower(), -round(float(v @ vec), 6), n) for n, v in zip(names, vectors))[:3]
        assert [got[sample, ord_, k] for k in (1, 2, 3)] == [(n, not other) for other, _, n in want]
    assert len(got) == 9


def test_a_vector_goes_to_few_blocks_and_tiles_lose_no_pair(spark, monkeypatch):
    import numpy as np

    from tripleloom.operators import similarity

    assert [similarity._blocks(n, similarity.BLOCK) for n in (1, 255, 2000, 100_000, 16_384 * 40)] == [1, 1, 7, 24, 40]
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(90, 8))
    rows[60:] = rows[:30]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vec array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if unit[a] @ unit[b] >= 0.5}
    monkeypatch.setattr(similarity, "STEP", 7)
    for block in (1000, 40):
        assert [tuple(r) for r in similarity.similar_pairs(vectors, 0.5, block).select("a", "b").orderBy("a", "b").collect()] == sorted(want)
        assert similarity.threshold_counts(vectors, [0.5], block).first()["pairs"] == len(want)
