"""Language-model scoring by context-tree weighting over bytes.

The model reads a text as its lower-cased words, one space between them, and
one end byte. A byte is decomposed into 8 binary decisions (nodes of a byte
tree). For every decision and every context of 0 to ``DEPTH`` preceding bytes
there is a Krichevsky-Trofimov estimator; a context's weighted probability is
half its own block probability and half the product of its one byte longer
contexts'. All of this follows from counts of (DEPTH + 1)-grams, which are
gathered in one distributed pass; the weights then mix the estimates of all
depths for each decision. A context that training has not seen has no estimate
of its own: the mixture ends with the longest one seen.

Contexts are dealt out by their last three bytes and taken some at a time, so
that a task holds a few of them however frequent their endings are. Contexts of
two bytes are joined to them as a table; only those of one byte, 65,280 nodes
at most, and of none are known everywhere.

Scoring needs one number for each gram that occurs anywhere, and the count of
each token. The most frequent ones go to the workers in tables of bounded
bytes (``TABLE`` grams, ``TOKENS`` tokens of ``TOKEN_BYTES``); what is left of a
document is looked up by a shuffle join, so nothing unbounded is broadcast.
Tokens are counted and looked up as they are, not by a hash.

Nulls: a null text is an empty text, which has one token, the end. A null
doc_id counts as training (its remainder is not 2). Repeated rows, and rows
that share a doc_id, count as often as they occur and are scored one by one.
Ties: grams and tokens of equal count may be in a table or not; the scores are
the same. Very long texts and words are read whole, in pieces of ``CHUNK``
bytes. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unit_hash

DEPTH = 5
END = 10
#: Grams in the workers' table, 12 bytes each.
TABLE = 4_000_000
#: Tokens in the workers' table; a longer one is never in it.
TOKENS = 400_000
TOKEN_BYTES = 64
#: Text bytes handled at a time in a worker.
CHUNK = 1_000_000
#: Distinct grams, and bytes of distinct tokens, that a worker gathers before it hands on its counts.
FOLD = 1_500_000
FOLD_BYTES = 16_000_000
#: Grams whose contexts are weighted together, and rows of a batch that is handed on.
GROUP = 150_000
BATCH = 100_000


def normal_form(text: bytes | None) -> bytes:
    """Lower-cased words with one space between them."""
    return b" ".join((text or b"").lower().split())


def pieces(texts: list[bytes], depth: int, most: int = CHUNK) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of (text, bytes before, bytes): normal forms with their end, cut where they are long, about ``most`` bytes a list."""
    part: list[tuple[int, bytes, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        whole = bytes([END]) * depth + text + bytes([END])
        for at in range(depth, len(whole), most):
            body = whole[at : at + most]
            part.append((i, whole[at - depth : at], body))
            size += len(body)
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def gram_codes(parts: list[tuple[int, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram code of each byte, bytes of each part). A gram's code holds its bytes, oldest first."""
    data = np.frombuffer(b"".join([x for _, before, body in parts for x in (before, body)]), dtype=np.uint8)
    sizes = np.array([len(body) for _, _, body in parts], dtype=np.int64)
    code = data.astype(np.uint64)
    for d in range(1, depth + 1):
        code[d:] |= data[:-d].astype(np.uint64) << np.uint64(8 * d)
    own = np.ones(len(data), dtype=bool)
    begins = np.cumsum(sizes + depth) - sizes - depth
    for d in range(depth):
        own[begins + d] = False
    return code[own], sizes


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_COUNTS = "kind int, key long, token binary, n long"


def _count(depth: int) -> Callable:
    """Worker function: (train, text) to counts: grams of all texts (kind 0), tokens (1) and documents (2) of training."""

    def rows(kind: int, keys, tokens, counts) -> Iterator[pa.RecordBatch]:
        n = len(counts)
        for k in range(0, n, BATCH):
            some = slice(k, min(k + BATCH, n))
            size = some.stop - k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, kind, np.int32)), pa.array(np.zeros(size, np.int64) if keys is None else keys[some].view(np.int64)),
                    pa.nulls(size, pa.binary()) if tokens is None else pa.array(tokens[some], pa.binary()), pa.array(counts[some], pa.int64()),
                ],
                names=["kind", "key", "token", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: Counter[bytes] = Counter()
        size, token_bytes, docs = 0, 0, 0
        for batch in batches:
            train = np.array(batch.column(0).to_pylist(), dtype=bool)
            docs += int(train.sum())
            forms = []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                forms.append(normal_form(text.as_py()))
                if train[i]:
                    before = len(tokens)
                    tokens.update(forms[-1].split())
                    token_bytes += (len(tokens) - before) * 100 + (len(forms[-1]) if len(tokens) > before else 0) // 8
                if token_bytes > FOLD_BYTES * 4:
                    yield from rows(1, None, list(tokens), list(tokens.values()))
                    tokens, token_bytes = Counter(), 0
            for parts in pieces(forms, depth):
                code, sizes = gram_codes(parts, depth)
                use = np.repeat(train[[i for i, _, _ in parts]], sizes)
                some, counts = np.unique(code[use], return_counts=True)
                other = np.unique(code[~use])
                grams += [(some, counts.astype(np.int64)), (other, np.zeros(len(other), dtype=np.int64))]
                size += len(some) + len(other)
                if size > FOLD:
                    grams = [_fold(grams)]
                    size = len(grams[0][0])
                    if size > FOLD // 2:
                        yield from rows(0, grams[0][0], None, grams[0][1])
                        grams, size = [], 0
        if grams:
            keys, counts = _fold(grams)
            yield from rows(0, keys, None, counts)
        yield from rows(1, None, list(tokens), list(tokens.values()))
        yield from rows(2, None, None, [docs])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after shifting up)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class _Level:
    """Estimates of one context length at its nodes; ``at`` leads from a decision to its node."""

    def __init__(self, nodes: np.ndarray, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None):
        self.nodes, self.at, self.zeros, self.ones = nodes, at, zeros, ones
        own = block_probability(zeros, ones)
        if deeper is None:
            self.weighted, self.weight = own, np.ones_like(own)
        else:
            self.weighted = np.logaddexp(own, deeper) - math.log(2)
            self.weight = np.exp(own - math.log(2) - self.weighted)

    def blend(self, bit: np.ndarray, p: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Mix this length's estimate of each decision with the longer contexts' one."""
        zeros, ones = self.zeros[self.at], self.ones[self.at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if p is not None:
            w = self.weight[self.at]
            own = np.where(seen, w * own + (1 - w) * p, own)
        return own, zeros + ones > 0


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node of the byte tree, bit) for the 8 decisions of each gram, gram by gram."""
    x = (code & np.uint64(255)).astype(np.int64)[:, None]
    j = np.arange(8)
    return ((1 << j) | (x >> (8 - j))).ravel(), ((x >> (7 - j)) & 1).ravel().astype(bool)


def subtree(code: np.ndarray, n: np.ndarray, depth: int, shallow: int) -> tuple[list[_Level], np.ndarray]:
    """Levels ``depth`` down to ``shallow`` over grams that hold whole contexts of that length."""
    node, bit = _decisions(code)
    weight = np.repeat(n.astype(np.float64), 8)
    context = np.repeat(code >> np.uint64(8), 8)
    levels: list[_Level] = []
    for d in range(depth, shallow - 1, -1):
        mask = np.uint64((1 << (8 * d)) - 1)
        nodes, at = np.unique((context & mask) << np.uint64(8) | node.astype(np.uint64), return_inverse=True)
        ones = np.bincount(at, weights=weight * bit, minlength=len(nodes))
        zeros = np.bincount(at, weights=weight * ~bit, minlength=len(nodes))
        deeper = None
        if levels:
            up = np.empty(len(levels[-1].nodes), dtype=np.int64)
            up[levels[-1].at] = at
            deeper = np.bincount(up, weights=levels[-1].weighted, minlength=len(nodes))
        levels.append(_Level(nodes, at, zeros, ones, deeper))
    return levels, bit


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that arrive sorted by the first one, in groups that split none of its values."""
    held: list[pa.RecordBatch] = []
    size, least = 0, GROUP
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(batch.num_columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if not cut:
            least *= 2  # one value fills all of it; look again when there is twice as much
            continue
        yield [c[:cut] for c in columns]
        held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in columns], names=batch.schema.names)]
        size, least = size - cut, GROUP
    if held:
        yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]


def _three_byte_nodes(depth: int) -> Callable:
    """Worker function: (ending, code, n) to the nodes of three-byte contexts (node, zeros, ones, weighted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, n in _groups(batches):
            top = subtree(code.view(np.uint64), n, depth, 3)[0][-1]
            yield pa.RecordBatch.from_arrays([pa.array(top.nodes.view(np.int64)), *map(pa.array, (top.zeros, top.ones, top.weighted))], names=["node", "zeros", "ones", "weighted"])

    return run


def _two_byte_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, zeros, ones, sum of deeper weighted) to (node, zeros, ones, own weight, weighted)."""
    for batch in batches:
        node, zeros, ones, deeper = (batch.column(k).to_numpy() for k in range(4))
        level = _Level(node, node, zeros, ones, deeper)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level.weight), pa.array(level.weighted)], names=["node", "zeros", "ones", "weight", "weighted"])


def _two_byte_chains(top: tuple[np.ndarray, ...]) -> Callable:
    """Worker function: what contexts of two bytes and fewer make of a longer context's estimate p.

    (node, zeros, ones, weight) to (node, e0, e1, a0, a1, b): a decision of bit
    x is given a_x + b * p where training has seen the longer context, else e_x.
    """
    keys, zeros, ones, deeper = top
    one = _Level(keys, np.arange(len(keys)), zeros, ones, deeper)
    roots, up = np.unique(keys & np.uint64(255), return_inverse=True)
    zero = _Level(roots, up, np.bincount(up, weights=zeros), np.bincount(up, weights=ones), np.bincount(up, weights=one.weighted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().astype(np.uint64)
            z, o, w = (batch.column(k).to_numpy() for k in range(1, 4))
            at = np.searchsorted(keys, (node >> np.uint64(8) & np.uint64(255)) << np.uint64(8) | node & np.uint64(255))
            seen2, seen1 = z + o > 0, (zeros + ones)[at] > 0
            own = [np.full(len(node), 0.0)] * 2
            w0, w1 = zero.weight[up[at]], one.weight[at]
            # The share of the two-byte estimate in the end, and what shorter contexts add of their own.
            share = np.where(seen1, (1 - w0) * np.where(seen2, 1 - w1, 0.0), 0.0)
            out = {}
            for x in (0, 1):
                two = ((o if x else z) + 0.5) / (z + o + 1.0)
                first = ((ones if x else zeros)[at] + 0.5) / ((zeros + ones)[at] + 1.0)
                root = ((zero.ones if x else zero.zeros)[up[at]] + 0.5) / ((zero.zeros + zero.ones)[up[at]] + 1.0)
                own[x] = np.where(seen1, w0 * root + (1 - w0) * np.where(seen2, w1 * first, first), root)
                out[f"e{x}"], out[f"a{x}"] = own[x] + share * two, own[x] + share * w * two
            out["b"] = share * (1 - w)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k]) for k in ("e0", "e1", "a0", "a1", "b")]], names=["node", "e0", "e1", "a0", "a1", "b"])

    return run


def _gram_scores(depth: int) -> Callable:
    """Worker function: grams (kind 1) after the nodes of their three-byte contexts (kind 0) to (key, n, log10 probability of the byte after its context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, key, n, *chain in _groups(batches):
            node, gram = kind == 0, kind == 1
            order = np.argsort(key[node].view(np.uint64))
            nodes, (e0, e1, a0, a1, b) = key[node].view(np.uint64)[order], [c[node][order] for c in chain]
            code = key[gram].view(np.uint64)
            if not len(code):
                continue
            levels, bit = subtree(code, n[gram], depth, 3)
            p = seen = None
            for level in levels:
                p, seen = level.blend(bit, p, seen)
            at = np.searchsorted(nodes, levels[-1].nodes)[levels[-1].at]
            p = np.where(seen, np.where(bit, a1[at], a0[at]) + b[at] * p, np.where(bit, e1[at], e0[at]))
            score = np.log10(p).reshape(-1, 8).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key[gram]), pa.array(n[gram]), pa.array(score)], names=["key", "n", "score"])

    return run


def _shorter(node: str) -> Column:
    """The node of the same decision after a context without its oldest byte: node holds context and decision."""
    bytes_left = {"node3": 0xFFFF, "node2": 0xFF}[node]
    context = F.shiftrightunsigned(node, 8).bitwiseAND(F.lit(bytes_left))
    return F.shiftleft(context, 8).bitwiseOR(F.col(node).bitwiseAND(F.lit(255)))


def gram_table(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, score) for every gram (key, n) of training and other texts."""
    if depth < 3:
        raise ValueError("contexts have three bytes at least")
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ending = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("ending")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]
    dealt = grams.select(ending, "key", "n").repartition(parts, "ending").sortWithinPartitions("ending")
    three = materialize(dealt.mapInArrow(_three_byte_nodes(depth), "node3 long, zeros double, ones double, weighted double"), "nodes3")
    two = three.groupBy(_shorter("node3").alias("node2")).agg(*sums)
    two = materialize(two.mapInArrow(_two_byte_weights, "node2 long, zeros double, ones double, weight double, weighted double"), "nodes2")
    tops = two.groupBy(_shorter("node2").alias("node1")).agg(*sums).orderBy("node1").toArrow()
    top = (tops["node1"].to_numpy().astype(np.uint64), *[tops[c].to_numpy() for c in ("zeros", "ones", "weighted")])
    chain = ["e0", "e1", "a0", "a1", "b"]
    chains = two.select("node2", "zeros", "ones", "weight").mapInArrow(_two_byte_chains(top), "node2 long, " + ", ".join(f"{c} double" for c in chain))
    known = three.select("node3", _shorter("node3").alias("node2")).join(chains, "node2")
    nodes = known.select(F.shiftrightunsigned("node3", 8).alias("ending"), F.lit(0).alias("kind"), F.col("node3").alias("key"), F.lit(0).cast("long").alias("n"), *chain)
    both = nodes.unionAll(grams.select(ending, F.lit(1).alias("kind"), "key", "n", *[F.lit(0.0).alias(c) for c in chain]))
    both = both.repartition(parts, "ending").sortWithinPartitions("ending")
    return materialize(both.mapInArrow(_gram_scores(depth), "key long, n long, score double"), "gram-scores")


class Lookup:
    """A fixed map from gram codes to numbers, for many codes at once.

    A code is spread over its ``width`` bits by a bijection. Its first bits are
    the place to look at, so that only the others are kept, in 4 bytes if they fit.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, width: int):
        self.width = width
        self.bits = min(width, max(1, int(len(keys)).bit_length()))
        spread = self._spread(keys)
        order = np.argsort(spread)
        spread, self.values = spread[order], values[order]
        rest = width - self.bits
        cell = (spread >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(spread), np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=1 << self.bits))]).astype(np.int32)
        self.rest = np.uint64((1 << rest) - 1)
        self.keys = (spread & self.rest).astype(np.uint32 if rest <= 32 else np.uint64)

    def _spread(self, keys: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.width) - 1), np.uint64(self.width // 2 + 1)
        x = keys ^ (keys >> half)
        x = (x * np.uint64(0xBF58476D1CE4E5B9)) & mask
        return x ^ (x >> half)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); a key that is not there has the value 0."""
        values, found = np.zeros(len(keys), dtype=np.float64), np.zeros(len(keys), dtype=bool)
        if not len(self.keys):
            return values, found
        spread = self._spread(keys)
        cell = (spread >> np.uint64(self.width - self.bits)).astype(np.int64)
        spread = (spread & self.rest).astype(self.keys.dtype)
        at, end = self.start[cell], self.start[cell + 1]
        here = np.arange(len(keys))
        while len(here):
            more = at < end
            here, at, end, spread = here[more], at[more], end[more], spread[more]
            hit = self.keys[at] == spread
            values[here[hit]], found[here[hit]] = self.values[at[hit]], True
            here, at, end, spread = here[~hit], at[~hit] + 1, end[~hit], spread[~hit]
        return values, found


def _frequent(table: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent entries of a table (key, n), about ``most`` of them at most, by a hash where counts tie."""
    place = F.floor(F.log2(F.col("n") + 1.0) * 64).cast("int")
    counts = table.groupBy(place.alias("place")).agg(F.count("*").alias("keys")).orderBy(F.desc("place")).collect()
    above = 0
    for r in counts:
        if above + r["keys"] > most:
            room = 0.98 * (most - above) / r["keys"]
            return table.filter((place > r["place"]) | (place == r["place"]) & (unit_hash(F.col(key)) < room))
        above += r["keys"]
    return table


_SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, grams array<long>, tokens array<binary>"


def _score(depth: int, shared) -> Callable:
    """Worker function: texts to sums over known grams and tokens, and those that are not in the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = shared.value
        for batch in batches:
            forms = [normal_form(t.as_py()) for t in batch.column(3).cast(pa.large_binary())]
            score, rest = np.zeros(len(forms)), [[np.empty(0, np.uint64)] for _ in forms]
            for parts in pieces(forms, depth):
                code, sizes = gram_codes(parts, depth)
                value, got = table.get(code)
                at = np.concatenate([[0], np.cumsum(sizes)])
                np.add.at(score, [i for i, _, _ in parts], np.add.reduceat(value, at[:-1]))
                lost = np.flatnonzero(~got)
                edges = np.searchsorted(lost, at)
                for k, (i, _, _) in enumerate(parts):
                    if edges[k + 1] > edges[k]:
                        rest[i].append(code[lost[edges[k] : edges[k + 1]]])
            base, known, n_tokens, left = [], [], [], []
            for form in forms:
                words = form.split()
                found = [counts.get(w) for w in words]
                missing = [w for w, v in zip(words, found) if v is None] if None in found else []
                if missing:
                    found = [v for v in found if v is not None]
                base.append(sum(found))
                known.append(len(found))
                n_tokens.append(len(words) + 1)
                left.append(missing)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                    pa.array([np.concatenate(x).view(np.int64) for x in rest], pa.list_(pa.int64())), pa.array(left, pa.list_(pa.binary())),
                ],
                names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "grams", "tokens"],
            )

    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, table: int = TABLE, tokens: int = TOKENS) -> DataFrame:
    """row_id, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all documents."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    counted = rows.select((~F.col("held_out")).alias("train"), "text").mapInArrow(_count(depth), _COUNTS)
    counted = materialize(counted.groupBy("kind", "key", "token").agg(F.sum("n").alias("n")), "counts")
    known = counted.filter("kind = 1").select("token", "n")
    train_docs = counted.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, n_types = words + train_docs, distinct + (train_docs > 0)
    scores = gram_table(counted.filter("kind = 0").select("key", "n"), depth)

    often = _frequent(scores, "key", table).select("key", "score").toArrow()
    grams = Lookup(often["key"].to_numpy().view(np.uint64), often["score"].to_numpy(), 8 * (depth + 1))
    often = _frequent(known.filter(F.octet_length("token") <= TOKEN_BYTES), "token", tokens).toArrow()
    counts = dict(zip(often["token"].to_pylist(), np.log10(often["n"].to_numpy() + 1.0).tolist()))
    shared = spark.sparkContext.broadcast((grams, counts))
    del often, grams, counts
    found = materialize(rows.mapInArrow(_score(depth, shared), _SCORED), "scored")
    shared.destroy()

    def rest(column: str, key: str) -> DataFrame:
        return found.select("row_id", F.explode(column).alias(key)).groupBy("row_id", key).agg(F.count("*").alias("times"))

    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    more = rest("grams", "key").join(scores.select("key", "score"), "key").select("row_id", (F.col("times") * F.col("score")).alias("score"), zero.alias("base"), none.alias("known"))
    said = rest("tokens", "token").join(known, "token").select("row_id", zero.alias("score"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("base"), F.col("times").alias("known"))
    added = more.unionAll(said).groupBy("row_id").agg(F.sum("score").alias("add_score"), F.sum("base").alias("add_base"), F.sum("known").alias("add_known"))
    per_token = math.log10(n_train + n_types + 1)
    base = F.col("base") + F.coalesce("add_base", zero) + math.log10(train_docs + 1) - F.col("n_tokens") * per_token
    return found.drop("grams", "tokens").join(added, "row_id", "left").select(
        "row_id", "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("add_known", F.lit(0)) + int(train_docs > 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("add_score", zero)).alias("score"),
    )


def op3_context_tree(spark, sf_dir: str) -> DataFrame:
    """Base and model score of all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
