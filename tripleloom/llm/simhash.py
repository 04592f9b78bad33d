"""SimHash near-duplicates through an inverted index over byte positions.

Two 64-bit fingerprints with at most 4 differing bits differ in at most 4 of
their 8 bytes, so they share at least 4 positional bytes. Postings are kept
for 20 triples of positions, chosen so that any 4 positions contain one of
them: every pair that can link meets in some posting list. Within a list the
positional bytes that a pair shares are tallied, pairs with fewer than the
guaranteed 4 are dropped, and the rest are verified bit by bit. Lists only
give back the links of a spanning forest, never all their pairs, and a list
longer than ``BLOCK`` is dealt out as pairs of blocks.

Nulls: a null or empty text has no words and fingerprint zero, which links
like any other. A null doc_id is never a component's name unless there is no
other. Repeated rows share their fingerprint, and rows that share a doc_id are
told apart by their row number; of documents that tie for a group's place the
one with the smallest number stays. Very long texts are hashed whole, shingle by
shingle. An empty table gives no rows. Other columns are ignored, whatever
their names and types; the stage returns them.

Four bits of 64 are a narrow bound: an edit of a few words in a long text stays
within it, one in a short text often does not. That bounds what the operator
can call a near copy, whatever the index finds; the index loses no link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, numbered, texts_of

SEED = 42
SHINGLE = 4
BITS = 4
#: Positions of which at least this many hold the same byte in a linked pair.
MATCHES = 8 - BITS
#: Fingerprints of one list that one task compares at a time.
BLOCK = 1024
#: Text bytes hashed at a time in a worker.
CHUNK = 2_000_000


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any 4 positions contain one.

    Positions form three rings of 3, 3 and 2; triples lie in one ring, or have
    two positions in a ring and one in the next. Four positions always fill
    one of these shapes.
    """
    rings = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [r for r in rings if len(r) == 3]
    for i, ring in enumerate(rings):
        for two in itertools.combinations(ring, 2):
            found += [two + (x,) for x in rings[(i + 1) % 3]]
    return found


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text's word shingles; 0 without words."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        ends = list(itertools.accumulate([len(w) + 1 for w in words]))
        n = max(1, len(words) - shingle + 1)
        begins = [0, *ends[: n - 1]]
        hashes += [digest(line[a : b - 1], SEED) for a, b in zip(begins, ends[min(shingle, len(words)) - 1 :])]
        counts[i] = n
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate([[0], np.cumsum(counts[full])])
    flat = np.array(hashes, dtype=np.uint64)
    sums = np.empty((len(full), 64), dtype=np.int64)
    for k in range(0, len(full), 256):
        some = at[k : k + 257]
        part = flat[some[0] : some[-1]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(len(some) - 1):
            sums[k + j] = bits[some[j] - some[0] : some[j + 1] - some[0]].sum(axis=0, dtype=np.int64)
    majority = (sums * 2 > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(majority, axis=1).view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        out, part, size = [], [], 0
        for text in texts:
            text = text.as_py()
            part.append(text)
            size += len(text or b"")
            if size > CHUNK:
                out.append(fingerprints(part))
                part, size = [], 0
        out.append(fingerprints(part))
        found = np.concatenate(out).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=["row_id", "doc_id", "fp"])


def fingerprint_documents(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """row_id, doc_id, fp (the 64 bits as a long)."""
    number = F.monotonically_increasing_id() if row_id is None else row_id
    rows = docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "row_id long, doc_id long, fp long")


def _link_groups(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within runs of equal ``key``.

    The s-th round compares each fingerprint with the one s places on in its
    list, so rounds go on only as long as the longest list.
    """
    n = len(fp)
    at_byte = fp.view(np.uint8).reshape(-1, 8)
    label = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    alive = np.flatnonzero(key[:-1] == key[1:]) if n > 1 else np.empty(0, np.int64)
    shift = 1
    while len(alive):
        other = alive + shift
        differ = label[alive] != label[other]
        a, b = alive[differ], other[differ]
        tally = (at_byte[a] == at_byte[b]).sum(axis=1)
        a, b = a[tally >= MATCHES], b[tally >= MATCHES]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= BITS
        a, b = a[close], b[close]
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = root(x), root(y)
            if p != q:
                label[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
        if len(a):
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        shift += 1
        alive = alive[alive + shift < n]
        alive = alive[key[alive] == key[alive + shift]]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _link_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from posting lists that arrive sorted; a list may go on in the next batch."""
    kept: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows.groupby(["key", "lo", "hi"], sort=False).ngroup().to_numpy()
        fp = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = _link_groups(key, fp)
        fp = fp.view(np.int64)
        return pd.DataFrame({"a": np.minimum(fp[a], fp[b]), "b": np.maximum(fp[a], fp[b])})

    for frame in frames:
        rows = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        last = rows.iloc[-1]
        open_ = ((rows["key"] == last["key"]) & (rows["lo"] == last["lo"]) & (rows["hi"] == last["hi"])).to_numpy()
        kept = rows[open_].reset_index(drop=True)
        if not open_.all():
            yield links(rows[~open_].reset_index(drop=True))
    if kept is not None and len(kept):
        yield links(kept)


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span every component."""
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [
        F.lit(i << 24) + byte[p] * F.lit(1 << 16) + byte[q] * F.lit(1 << 8) + byte[r]
        for i, (p, q, r) in enumerate(position_triples())
    ]
    postings = distinct.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    postings = join_hot(postings, materialize(lists, "lists"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    # With one block a list is compared whole; else each pair of blocks is, by its own task.
    partner = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    )
    dealt = postings.withColumn("own", own).withColumn("other", F.explode(partner)).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return dealt.mapInPandas(_link_lists, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links``; root is the same throughout a component.

    Each round takes the smallest root among neighbours and then follows roots
    one step, so chains shrink by half; every round is written to the shared
    folder.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")), "links")
    roots = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(roots, both.b == roots.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        lower = materialize(lower, "roots")
        onward = lower.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        after = materialize(lower.join(onward, "next").select("node", "root", F.least("next", "jump").alias("jump")), "roots")
        changed = after.filter("jump <> root").limit(1).count()
        roots = after.select("node", F.col("jump").alias("root"))
        if not changed:
            return roots


def near_duplicates(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """row_id, doc_id, fp, root (a fingerprint that names the component), component_id
    (smallest doc_id reachable) for every row."""
    rows = materialize(fingerprint_documents(docs, row_id), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    links = materialize(fingerprint_links(distinct.select("fp")), "near")
    member = components(links).withColumnRenamed("node", "fp")
    named = member.join(distinct, "fp")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(names, "root").select("fp", "root", "component_id")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return join_hot(rows, materialize(classes, "classes"), "fp").drop("n")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component, the one with the smallest doc_id."""
    rows = numbered(docs, "dedup-rows")
    found = near_duplicates(texts_of(rows, "doc_id", "text"), row_id=F.col("row_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_id"))
    keep = found.groupBy("root").agg(F.min_by("row_id", order).alias("row_id")).select("row_id")
    return rows.join(keep, "row_id").select("doc.*")
