"""Cosine similarity joins, nearest neighbours and components over vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checkpoint import cut

#: Vectors of one block; pairs of blocks are compared by their own task, and each vector goes to as many tasks as there are blocks.
BLOCK = 16384
#: Vectors of a side that a task multiplies at once.
STEP = 2048
#: Blocks that few vectors are dealt into, so that tasks share the work, and the fewest vectors of those.
SPREAD, LEAST = 24, 256
#: Queries and pool vectors of one block in ``nearest``.
QUERIES, POOL = 2048, 8192


def _matrix(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype=np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _blocks(n: int, block: int) -> int:
    """How many blocks ``n`` vectors make: no larger than ``block``, and up to ``SPREAD`` of them though they would fit in fewer."""
    return max(1, -(-n // block), min(SPREAD, n // LEAST))


def _tiles(left: pd.Series, right: pd.Series, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, cosines) of all pairs of two sides, a tile at a time; of one block with itself those on and above the diagonal."""
    a, b = _matrix(left), _matrix(right)
    for i in range(0, len(a), STEP):
        for j in range(i if same else 0, len(b), STEP):
            yield i, j, a[i : i + STEP] @ b[j : j + STEP].T


def _blocked(vectors: DataFrame, block: int, part: str | None = None) -> DataFrame:
    """Each vector once for every pair of blocks that its block is in (lo, hi, side); with ``part`` blocks are a partition's own."""
    if part is None:
        sized = vectors.withColumn("blocks", F.lit(_blocks(vectors.count(), block)))
    else:
        n = F.count("*")
        blocks = F.greatest(F.lit(1), F.ceil(n / block), F.least(F.lit(SPREAD), F.floor(n / LEAST))).cast("int")
        sized = vectors.join(vectors.groupBy(part).agg(blocks.alias("blocks")), part)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*([part] if part else []), "id", "vec", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK, part: str | None = None) -> DataFrame:
    """(a, b, cosine) with a < b and cosine >= threshold; exact, by blocked matrix products.

    With ``part``, a column that is never null, only vectors of one partition meet.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["own"] == rows["lo"]], rows[rows["own"] == rows["hi"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        same, out = rows["lo"].iloc[0] == rows["hi"].iloc[0], []
        for at, to, sims in _tiles(left["vec"], right["vec"], same):
            i, j = np.nonzero(sims >= threshold)
            # Of a block with itself each pair is met once, above the diagonal.
            keep = i + at < j + to if same else slice(None)
            i, j = i[keep], j[keep]
            a, b = left["id"].to_numpy()[i + at], right["id"].to_numpy()[j + to]
            other = a != b
            out.append(pd.DataFrame({"a": np.minimum(a, b)[other], "b": np.maximum(a, b)[other], "cosine": sims[i, j][other]}))
        return pd.concat(out)

    kind = dict(vectors.dtypes)["id"]
    return _blocked(vectors, block, part).groupBy(*([part] if part else []), "lo", "hi").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")


def threshold_counts(vectors: DataFrame, thresholds: list[float], block: int = BLOCK) -> DataFrame:
    """(threshold, pairs): unordered pairs at or above each threshold, counted without listing them."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["own"] == rows["lo"]], rows[rows["own"] == rows["hi"]]
        pairs, same = [0] * len(thresholds), rows["lo"].iloc[0] == rows["hi"].iloc[0]
        if len(left) and len(right):
            for at, to, sims in _tiles(left["vec"], right["vec"], same):
                found = sims[np.triu_indices(len(sims), 1)] if same and at == to else sims
                pairs = [n + int((found >= t).sum()) for n, t in zip(pairs, thresholds)]
        return pd.DataFrame({"threshold": thresholds, "pairs": pairs})

    found = _blocked(vectors, block).groupBy("lo", "hi").applyInPandas(count, "threshold double, pairs long")
    return found.groupBy("threshold").agg(F.sum("pairs").alias("pairs"))


def nearest(queries: DataFrame, pool: DataFrame, k: int, query_block: int = QUERIES, pool_block: int = POOL) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest of ``pool`` for each query, ties by id.

    The queries are a stated set. Both sides are dealt out in blocks; a task
    holds one block of each and gives k rows for each of its queries.
    """
    kinds = dict(queries.dtypes)["id"], dict(pool.dtypes)["id"]
    qs, ps = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (pool, pool_block)))

    def dealt(df: DataFrame, side: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # Names of their own: the queries often come from the pool, and a cogroup mixes up columns that both sides share.
        placed = df.select(F.col("id").alias(f"{side}_id"), F.col("vec").alias(f"{side}_vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(F.col("qb").alias(f"{side}_qb"), F.col("pb").alias(f"{side}_pb"), f"{side}_id", f"{side}_vec")

    def rank(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(found):
            found = found.sort_values("p_id")
            unit, ids, top = _matrix(found["p_vec"]), found["p_id"].to_numpy(), min(k, len(found))
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                sims = _matrix(part["q_vec"]) @ unit.T
                for q, row in zip(part["q_id"].to_numpy(), sims):
                    order = np.argsort(-np.round(row, 12), kind="stable")[:top]
                    out.append(pd.DataFrame({"query_id": q, "id": ids[order], "cosine": row[order]}))
        # Empty columns stay objects: as numbers they would not convert to ids that are strings.
        return pd.concat(out) if out else pd.DataFrame([], columns=["query_id", "id", "cosine"])

    left, right = dealt(queries, "q", "qb", qs, "pb", ps), dealt(pool, "p", "pb", ps, "qb", qs)
    local = left.groupBy("q_qb", "q_pb").cogroup(right.groupBy("p_qb", "p_pb")).applyInPandas(rank, f"query_id {kinds[0]}, id {kinds[1]}, cosine double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "id"))
    return local.withColumn("rank", best).filter(F.col("rank") <= k)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach.

    Each round points every node at its smallest neighbour's smallest
    neighbour and goes on with the edges between those, each once, so rounds
    shrink; what they point at is put together from the last round back.
    Rounds are checkpointed.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ways = F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
        near = cut(left.select(F.explode(ways).alias("w")).groupBy("w.node").agg(F.min("w.to").alias("to")))
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        moved = cut(near.join(onward, "to").select("node", F.col("far").alias("to")))
        rounds.append(moved)
        for side in ("a", "b"):
            left = left.join(moved.withColumnsRenamed({"node": side, "to": f"_{side}"}), side)
        left = cut(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a < b").distinct())
    labels = None
    for moved in reversed(rounds):
        if labels is None:
            labels = moved.select("node", F.col("to").alias("component"))
        else:
            onward = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
            labels = cut(moved.join(onward, "to", "left").select("node", F.coalesce("end", "to").alias("component")))
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if nodes is None:
        return labels
    alone = nodes.select("node").join(labels, "node", "left")
    return alone.select("node", F.coalesce("component", "node").alias("component"))


def clusters(members: DataFrame) -> DataFrame:
    """(component, members sorted) of (node, component)."""
    return members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))


def hashed_embedding(texts: list[str], dims: int = 256) -> np.ndarray:
    """Offline embedding: hashed character n-grams (2 to 4, word ends marked), unit length. All texts are hashed at once."""
    out = np.zeros((len(texts), dims))
    framed = [f" {text.lower()} " for text in texts]
    sizes = np.array([len(f) for f in framed], dtype=np.int64)
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    step, mask = np.uint64(1_000_003), np.uint64(0xFFFFFFFF)
    gram = codes & mask
    for n in (2, 3, 4):
        if len(codes) < n:
            break
        gram = (gram[: len(codes) - n + 1] * step + codes[n - 1 :]) & mask
        whole = left[: len(gram)] >= n
        at = ((gram[whole] * np.uint64(2654435761)) & mask) % np.uint64(dims)
        np.add.at(out, (owner[: len(gram)][whole], at.astype(np.int64)), 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """(text, vec) of distinct texts; ``embedder`` may be any model that gives unit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = embedder(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["text", "vec"])

    return texts.select("text").distinct().mapInArrow(run, "text string, vec array<float>")


def linkage_clusters(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Single-linkage clusters of one partition's vectors, cut at cosine ``threshold``.

    The same clusters as ``components`` over ``similar_pairs``, for groups that
    fit a task. Labels follow the first member.
    """
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    labels = np.full(n, -1)
    for start in range(n):
        if labels[start] >= 0:
            continue
        labels[start] = start
        edge = [start]
        while edge:
            free = labels < 0
            close = free & (unit[edge] @ unit.T >= threshold).any(axis=0)
            edge = np.flatnonzero(close).tolist()
            labels[edge] = start
    return labels
