"""SimHash, decontamination, mixing and sharding against plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tripleloom.llm import decontamination, mixing, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    owner = list(range(len(prints)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            owner[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_triples_cover_all_sets_of_four_positions():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_fingerprints_and_components(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(r[1]) for r in rows]
    names = plain_components(prints)
    least = {}
    for r, name in zip(rows, names):
        if r[0] is not None:
            least[name] = min(least.get(name, r[0]), r[0])
    expected = Counter((r[0], p, least.get(n)) for r, p, n in zip(rows, prints, names))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found) == expected


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_dense_lists(spark, block):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(60):
        x = rng.choice(list(prints))
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    links = simhash.fingerprint_links(frame, block)
    member = {r["node"] % 2**64: r["root"] for r in simhash.components(links).collect()}
    names = plain_components(prints)
    groups, ours = defaultdict(set), defaultdict(set)
    for p, n in zip(prints, names):
        groups[n].add(p)
        ours[member.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_one_document_of_each_group_stays(spark, docs, rows):
    kept = simhash.stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    names = plain_components([plain_fingerprint(r[1]) for r in rows])
    assert kept.count() == len(set(names))
    ids = {r["doc_id"] for r in kept.collect()}
    assert 100 in ids and not ids & set(range(101, 112))


def test_empty_tables(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.stage_near_duplicates(spark, no_docs, "").count() == 0
    assert sharding.shard_documents(no_docs).count() == 0
    assert mixing.mix_sources(no_docs)[0].count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.benchmark_hits(no_docs, bench).count() == 0


BENCH = [(1, "alpha beta gamma delta rot blau GRÜN maison café Über niño agua"), (2, "short item"), (3, ""), (4, None), (None, "no id at all"), (5, "Short, item!")]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, window=10):
    words = TERM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, said in items:
        own = TERM.findall((said or "").translate(LOWER))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(5)
    words = TERM.findall(BENCH[0][1].translate(LOWER))
    rows = []
    for i in range(50):
        k = rng.randint(0, 3)
        text = " ".join(rng.choices(words, k=20)) + ". " + " - ".join(words[k : k + rng.choice([9, 10, 12])]).upper().replace("GRÜN", "GRüN").replace("CAFÉ", "CAFé").replace("ÜBER", "über").replace("NIÑO", "NIñO")
        rows.append((i, text + rng.choice(["", " SHORT item.", " no id at all"])))
    rows += [(90, None), (91, ""), (90, "short item short item"), (None, "short item")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("windows", [100, 2])
def test_decontamination_is_exact(spark, leaky, windows):
    rows, frame = leaky
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontamination.benchmark_hits(frame, bench, windows=windows).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(s["e"] - s["s"] for s in r["spans"]), tuple(r["items"])) for r in found)
    assert got == Counter((d, n, h, tuple(i)) for d, (n, h, i) in ((d, plain_hits(t, BENCH)) for d, t in rows))


def test_proximity_matches(spark):
    frame = spark.createDataFrame([(1, "red green blue"), (2, "blue x x red x green"), (3, "red x x x x x x x green blue"), (4, "red green")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    found = decontamination.benchmark_hits(frame, bench, span=6).filter("size(spans) > 0").collect()
    assert {r["doc_id"] for r in found} == {1, 2}


def test_decontamination_stage(spark, docs, tmp_path):
    spark.createDataFrame([(1, "something else with the id")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontamination.stage_decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Share, cap, share the excess again, until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > repeats * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(docs, rows):
    mixed, schedule = mixing.mix_sources(docs)
    found = mixed.collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 8
    again, _ = mixing.mix_sources(docs)
    assert Counter((r["doc_id"], r["taken"]) for r in again.collect()) == Counter((r["doc_id"], r["taken"]) for r in found)
    # The schedule is even: any stretch has each source close to its share.
    order = [r["src"] for r in schedule.orderBy("slot").collect()]
    part = Counter(order[: len(order) // 3])
    for src, n in Counter(order).items():
        assert abs(part[src] - n / 3) < 12


def test_mixing_with_large_blocks_follows_blocks(docs):
    mixed, _ = mixing.mix_sources(docs, slots=500)
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.first("source_size").alias("s")).collect()
    block = -(-sum(r["s"] for r in sums) // 500)
    assert all(abs(r["t"] - r["want"]) <= 10 * block for r in sums)


def test_small_sources_meet_their_targets_below_the_block(spark):
    """Sources of 20 and 700 words beside 80,000, with blocks of 306 words."""
    rows = [(i, "w " * 500, "big") for i in range(160)] + [(200, "a b " * 10, "tiny"), (201, "c " * 700, "mid"), (202, None, "void")]
    mixed, schedule = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=264)
    found = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.first("src").alias("src")).collect()}
    assert found["tiny"]["t"] == 60 and found["mid"]["t"] == 2100 and found["void"]["t"] == 0
    assert all(r["t"] == int(r["want"] + 0.5) for r in found.values())
    words = {r["src"]: r["w"] for r in schedule.groupBy("src").agg(F.sum("words").alias("w")).collect()}
    assert words == {r["src"]: r["t"] for r in found.values() if r["t"]}
    assert schedule.count() == schedule.select("slot").distinct().count() and schedule.filter("words <= 0 or pass >= 3").isEmpty()


def test_mixing_stage_repeats_documents(spark, docs):
    out = mixing.stage_mix(spark, docs, "")
    mixed, _ = mixing.mix_sources(docs)
    want = sum(1 if r["size"] == 0 else int(r["taken"] / r["size"] + 0.5) for r in mixed.collect())
    assert out.columns == docs.columns and out.count() == want


def test_sharding(docs, rows):
    found = sharding.shard_documents(docs).collect()
    sizes = Counter()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(50, 400)) for i in range(3000)] + [(5000 + i, f"copy {i % 40} " + "x" * 300) for i in range(400)]
    rows += [(9000 + i, "hot " * 60) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_documents(frame).collect()
    sizes = Counter()
    homes = defaultdict(set)
    for r in found:
        sizes[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values()) + 800
    assert sum(len(v) > 1 for v in homes.values()) <= 7


def test_sharding_stage(spark, docs):
    out = sharding.stage_shard(spark, docs, "")
    assert out.count() == docs.count()
    assert set(out.columns) == set(docs.columns) | {"shard", "slot"}
    places = [(r["shard"], r["slot"]) for r in out.collect()]
    assert len(set(places)) == len(places)




# ------------------------------------------------------------ stages on awkward tables


@pytest.fixture(scope="module")
def stage_tables(spark, rows, tmp_path_factory):
    """Labels and benchmark beside documents that are awkward in every way."""
    at = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(r[0], 0) for r in rows[:50]] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def stages():
    from tripleloom.llm import toxicity

    return [toxicity.stage_toxicity, simhash.stage_near_duplicates, decontamination.stage_decontaminate, mixing.stage_mix, sharding.stage_shard]


def test_stages_bear_any_other_columns(spark, docs, stage_tables):
    """Columns named as the operators' own, of types that can't be hashed or compared, change nothing."""
    odd = {
        "_id": F.lit(3), "_row_key": F.lit("k"), "row_id": F.lit("r"), "doc": F.lit(1.5), "copies": F.lit(7), "_copies": F.lit(2), "root": F.lit(0), "fp": F.lit(1), "score": F.lit("s"), "n": F.lit(0),
        "a.b": F.lit(4), "with `ticks`": F.lit(5), "tags": F.create_map(F.lit("a"), F.lit(1)), "leaf": F.lit(9), "src": F.lit("q"), "bucket": F.lit(1),
    }
    wide = docs.withColumns(odd)
    for stage in stages():
        plain, full = stage(spark, docs, stage_tables), stage(spark, wide, stage_tables)
        assert Counter(r["doc_id"] for r in plain.collect()) == Counter(r["doc_id"] for r in full.collect()), stage.__name__
        if stage is not sharding.stage_shard:
            assert full.columns == wide.columns and full.dtypes == wide.dtypes
        assert {r["tags"]["a"] for r in full.select("tags").collect()} == {1}


def test_stages_on_one_doc_id_and_on_nothing(spark, docs, no_docs, stage_tables):
    same = docs.withColumn("doc_id", F.lit(5).cast("long"))
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for stage in stages():
        assert stage(spark, no_docs, stage_tables).count() == 0
        for frame in (same, none):
            left = stage(spark, frame, stage_tables).count()
            if stage is not mixing.stage_mix:  # mixing repeats and leaves out by weight
                assert left <= frame.count()
    assert sharding.stage_shard(spark, same, stage_tables).count() == docs.count()
    assert decontamination.stage_decontaminate(spark, none, stage_tables).count() == decontamination.stage_decontaminate(spark, docs, stage_tables).count()


def test_blocks_of_queries_find_the_same(spark, docs, rows):
    bench = spark.createDataFrame([(i, rows[i][1]) for i in range(5)], "item_id long, text string")
    whole, blocks = ({(r["row_id"], r["n_words"], str(r["spans"]), tuple(r["items"])) for r in decontamination.benchmark_hits(docs, bench, windows=w).collect()} for w in (100_000, 7))
    assert whole == blocks and any(x[3] for x in whole)


def test_packed_numbers_come_back():
    import numpy as np

    for kind in (np.uint32, np.uint64, np.int64):
        for numbers in ([], [5], [3, 1, 4, 1, 5, 2**31], list(range(0, 100_000, 7))):
            x = np.array(numbers, dtype=kind)
            assert np.array_equal(decontamination._unpacked(decontamination._packed(x), kind), x)


def test_hot_keys_join_like_others(spark):
    from tripleloom.llm.common import join_hot

    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(6_000)], "k long, v long")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(join_hot(left, sizes, "k").select("k", "v").collect()) == sorted(left.collect())


def plain_median(units):
    """The first cut of the tree, by sorting all units."""
    total, sums = sum(u[1] for u in units), 0
    for place, w, _ in sorted(units):
        if sums + w >= total / 2:
            return place
        sums += w


def test_the_first_cut_is_the_weighted_median(spark):
    rng = random.Random(9)
    units = [(rng.random() * 100, rng.randint(1, 50), rng.random()) for _ in range(500)]
    frame = spark.createDataFrame([(p, float(w), t) for p, w, t in units], "d double, bytes double, tie double")
    cut, leaves = sharding.kd_leaves(frame, ["d"], sum(u[1] for u in units) / 2)
    assert leaves == 2
    low = max(r["d"] for r in cut.filter("leaf = 0").collect())
    high = min(r["d"] for r in cut.filter("leaf = 1").collect())
    median = plain_median(units)
    assert low <= high and low <= median <= high
