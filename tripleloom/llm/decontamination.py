"""Benchmark decontamination over a positional inverted index.

The index is partitioned by documents, as search engines do it: a segment
holds some thousand documents and, for every term they use, the sorted
positions at which the segment has it. Segments are written to the shared
folder. A query of consecutive terms is answered segment by segment: terms are
taken from the rarest on (by their count in the whole corpus), each list is
shifted by the term's offset and intersected with what is left. Proximity
queries take the same lists and ask for all terms within a span.

The benchmark is the stated query set. It is read item by item and asked in
blocks of ``WINDOWS`` windows and ``BLOCK_BYTES`` bytes at most, so neither the
driver nor a broadcast holds more than a block, however large it is. Hot terms
and passages that a third of the documents share lengthen lists within segments
only; no shuffle carries postings.

Nulls: a null text has no words; an item without words has no window; a null
item_id is left out of the item list but its windows do hit. Repeated rows, and
rows that share a doc_id, are separate documents. Ties: windows that overlap or
touch are one span; items are listed in the order of their ids as text. A text
longer than a segment is a segment of its own, indexed whole. An empty table
gives no rows, an empty benchmark no hits. Other columns are ignored, whatever
their names and types; the stage returns them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, texts_of

WINDOW = 10
#: Text bytes in one segment, about.
SEGMENT = 4_000_000
#: Windows, and bytes of them, in one block of the query set; what is more is asked in more blocks.
WINDOWS = 100_000
BLOCK_BYTES = 16_000_000

#: ASCII letters in lower case; all other ASCII but digits parts words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and all non-ASCII characters."""
    if isinstance(text, str):
        text = text.encode()
    return (text or b"").translate(_TABLE).split()


Windows = dict[tuple[bytes, ...], list[str]]


def query_blocks(items: Iterable[tuple[object, str | None]], window: int = WINDOW, most: int = WINDOWS) -> Iterator[Windows]:
    """Each window of the items with the ids of its items, in blocks of ``most`` windows."""
    found: Windows = {}
    size = 0
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            terms = tuple(words[i : i + window])
            size += 0 if terms in found else sum(map(len, terms))
            ids = found.setdefault(terms, [])
            if item is not None and str(item) not in ids:
                ids.append(str(item))
            if len(found) >= most or size >= BLOCK_BYTES:
                yield found
                found, size = {}, 0
    if found:
        yield found


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte of all, so that the zeros compress."""
    steps = np.diff(numbers, prepend=numbers[:0].sum(dtype=numbers.dtype))
    return steps.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T)
    return np.cumsum(steps.view(kind).ravel(), dtype=kind)


_INDEX = "row_ids binary, doc_ids binary, known binary, starts binary, terms binary, ends binary, positions binary, wide boolean"


def _build(gap: int):
    """Worker function: texts to index segments."""

    def segment(rows: list[int], ids: list[int | None], texts: list[bytes | None]) -> dict[str, object]:
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        place: dict[bytes, int] = {}
        terms, where = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        at = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            terms.append(np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int32, count=len(words)))
            where.append(np.arange(at, at + len(words)))
            at += len(words) + gap
            starts[i + 1] = at
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        wide = at >= 1 << 32
        return {
            "row_ids": np.array(rows, dtype=np.int64).tobytes(),
            "doc_ids": np.array([0 if x is None else x for x in ids], dtype=np.int64).tobytes(),
            "known": np.array([x is not None for x in ids], dtype=np.uint8).tobytes(),
            "starts": starts.tobytes(),
            "terms": b" ".join(place),  # words hold no spaces
            "ends": _packed(np.cumsum(np.bincount(term, minlength=len(place))).astype(np.int64)),
            "positions": _packed(np.concatenate(where)[order].astype(np.uint64 if wide else np.uint32)),
            "wide": wide,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = (batch.column(k).to_pylist() for k in range(2))
            texts = batch.column(2).cast(pa.large_binary())
            begin, size = 0, 0
            for i in range(len(texts)):
                size += len(texts[i].as_py() or b"")
                if size >= SEGMENT or i == len(texts) - 1:
                    part = slice(begin, i + 1)
                    row = segment(rows[part], ids[part], texts.slice(begin, i + 1 - begin).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.bool_() if k == "wide" else pa.binary()) for k, v in row.items()], names=list(row))
                    begin, size = i + 1, 0

    return run


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """Write the segments of ``docs`` (row_id, doc_id, text) with the postings of all their terms."""
    return materialize(docs.mapInArrow(_build(gap), _INDEX), "postings")


class Segment:
    """One row of the index, ready for queries: terms are numbered as in ``asked``, the list of those that queries use."""

    def __init__(self, row: dict, asked: list[bytes]):
        self.starts = np.frombuffer(row["starts"], dtype=np.int64)
        ends = _unpacked(row["ends"], np.int64)
        self.positions = _unpacked(row["positions"], np.uint64 if row["wide"] else np.uint32)
        place = {w: i for i, w in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        at = np.fromiter((place.get(w, -1) for w in asked), dtype=np.int64, count=len(asked))
        self.here = at >= 0
        edges = np.concatenate([[0], ends])
        self.begin, self.end = edges[np.maximum(at, 0)], edges[at + 1]

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.end[term]] if self.here[term] else self.positions[:0]

    def phrase(self, query: list[tuple[int, int]]) -> np.ndarray:
        """Positions at which all (term, offset) of ``query`` hold; rarest terms come first."""
        first, offset = query[0]
        found = self.list_of(first).astype(np.int64) - offset
        for term, offset in query[1:]:
            if not len(found):
                break
            other = self.list_of(term)
            at = np.searchsorted(other, found + offset)
            at[at == len(other)] = 0
            found = found[other[at] == found + offset] if len(other) else found[:0]
        return found

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Positions of the first term that have all other terms fewer than ``span`` words away."""
        found = self.list_of(terms[0]).astype(np.int64)
        for term in terms[1:]:
            other = self.list_of(term).astype(np.int64)
            if not len(other) or not len(found):
                return found[:0]
            at = np.searchsorted(other, found)
            behind, ahead = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
            found = found[np.minimum(np.abs(found - behind), np.abs(ahead - found)) < span]
        return found


_HITS = "row_id long, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


class Queries:
    """A block of windows: their terms, and for each window its terms with their offsets, the rarest first."""

    def __init__(self, block: Windows, window: int, terms: list[bytes], counts: np.ndarray):
        number = {t: i for i, t in enumerate(terms)}
        # A window that has a term which the corpus lacks can't occur.
        block = {w: ids for w, ids in block.items() if all(counts[number[t]] for t in w)}
        self.terms = terms
        self.items = list(block.values())
        self.length = np.array([len(w) for w in block], dtype=np.int64)
        self.term = np.zeros((len(block), window), dtype=np.int32)
        self.offset = np.zeros((len(block), window), dtype=np.int32)
        for q, words in enumerate(block):
            own = np.array([number[t] for t in words], dtype=np.int32)
            order = np.argsort(counts[own], kind="stable")
            self.term[q], self.offset[q] = own[order[0]], order[0]  # short windows repeat their rarest term
            self.term[q, : len(own)], self.offset[q, : len(own)] = own[order], order


def _search(shared, gap: int, span: int | None, only_hits: bool):
    """Worker function: index segments to hits by document."""

    def hits(row: dict, asked: Queries) -> pa.RecordBatch:
        seg = Segment(row, asked.terms)
        n = len(seg.starts) - 1
        begins, lengths, owners = [], [], []
        for q in np.flatnonzero(seg.here[asked.term].all(axis=1)).tolist() if len(asked.items) else []:
            length = int(asked.length[q])
            terms = asked.term[q, :length].tolist()
            found = seg.phrase(list(zip(terms, asked.offset[q, :length].tolist()))) if span is None else seg.near(terms, span)
            if len(found):
                begins.append(found)
                lengths.append(np.full(len(found), length if span is None else 1))
                owners.append(np.full(len(found), q))
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        if begins:
            begin, length, owner = map(np.concatenate, (begins, lengths, owners))
            doc = np.searchsorted(seg.starts, begin, side="right") - 1
            for d, q in set(zip(doc.tolist(), owner.tolist())):
                items[d].update(asked.items[q])
            order = np.argsort(begin, kind="stable")
            for d, s, e in zip(doc[order].tolist(), (begin - seg.starts[doc])[order].tolist(), (begin - seg.starts[doc] + length)[order].tolist()):
                own = spans[d]
                if own and s <= own[-1]["e"]:
                    own[-1]["e"] = max(own[-1]["e"], e)
                else:
                    own.append({"s": s, "e": e})
        known = np.frombuffer(row["known"], dtype=np.uint8)
        span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.frombuffer(row["row_ids"], dtype=np.int64)),
                pa.array(np.frombuffer(row["doc_ids"], dtype=np.int64), pa.int64(), mask=known == 0),
                pa.array(np.diff(seg.starts) - gap, pa.int64()),
                pa.array(spans, span_type),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            names=["row_id", "doc_id", "n_words", "spans", "items"],
        )
        return out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield hits({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}, asked)

    return run


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None, windows: int = WINDOWS, row_id: Column | None = None
) -> DataFrame:
    """row_id, doc_id, n_words, spans (of hit words, merged), items (sorted) for every document.

    The benchmark is asked in blocks of ``windows``. With ``span`` the windows
    are proximity queries: all terms of a window within fewer than ``span``
    words of its rarest. ``row_id`` tells rows apart; rows are numbered without it.
    """
    spark = docs.sparkSession
    gap = window + (span or 0)
    rows = docs.select(
        (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    index = build_index(rows, gap)

    def search(block: Windows, only_hits: bool) -> DataFrame:
        terms = sorted({t for w in block for t in w})
        asked = Queries(block, window, terms, _corpus_counts(index, terms))
        return index.mapInArrow(_search(spark.sparkContext.broadcast(asked), gap, span, only_hits), _HITS)

    blocks = query_blocks(((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator()), window, windows)
    found = search(next(blocks, {}), False)
    more = next(blocks, None)
    if more is None:
        return found
    for block in itertools.chain([more], blocks):
        found = found.unionByName(materialize(search(block, True), "hits"))
    merged = found.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<s:long,e:long>>")
    join_up = F.aggregate(
        "spans", empty,
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["e"] >= x["s"]), F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(F.element_at(out, -1)["s"].alias("s"), F.greatest(F.element_at(out, -1)["e"], x["e"]).alias("e"))),
        )).otherwise(F.concat(out, F.array(x))),
    )
    return merged.withColumn("spans", join_up)


def _corpus_counts(index: DataFrame, asked: list[bytes]) -> np.ndarray:
    """How often each of the terms occurs in the corpus."""
    number = {t: i for i, t in enumerate(asked)}
    shared = index.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        get = shared.value.get
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                words = terms.as_py().split(b" ") if terms.as_py() else []
                at = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
                counts = np.diff(_unpacked(ends.as_py(), np.int64), prepend=0)
                total[at[at >= 0]] += counts[at >= 0]  # a segment has each term once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    counts = np.zeros(len(asked), dtype=np.int64)
    for r in index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    shared.unpersist()
    return counts


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of the benchmark, and the items found."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = benchmark_hits(docs, bench)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, ws[i : i + {WINDOW - 1}] AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) AS i FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM docs),
found AS (SELECT DISTINCT rid, p, n, item FROM (SELECT rid, p, n, ws[p : p + n - 1] AS g FROM places, lens WHERE p + n - 1 <= len(ws)) JOIN wins ON g = win),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    rows = numbered(docs, "leak-rows")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = benchmark_hits(texts_of(rows, "doc_id", "text"), bench, row_id=F.col("row_id"))
    bad = materialize(hits.filter("size(spans) > 0").select("row_id"), "leaks")
    return rows.join(bad, "row_id", "left_anti").select("doc.*")
