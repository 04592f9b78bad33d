"""Hierarchical density clustering of pools of vectors, by cosine distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances below this count as this, so that equal vectors have a finite density.
CLOSEST = 1e-12


def spanning_tree(vectors: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (distance, a, b) of a minimum spanning tree, nearest first.

    Every point counts as dense by itself, so distances are the cosine ones.
    One row of distances is held at a time.
    """
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), CLOSEST)
    n = len(unit)
    best, link, free = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at, edges = 0, []
    for _ in range(n - 1):
        free[at] = False
        away = np.maximum(1.0 - unit @ unit[at], CLOSEST)
        nearer = free & (away < best)
        best[nearer], link[nearer] = away[nearer], at
        at = int(np.argmin(np.where(free, best, np.inf)))
        edges.append((float(best[at]), int(link[at]), at))
    return sorted(edges)


class _Dendrogram:
    """Clusters that live on while points or too small groups drop out of them."""

    def __init__(self, n: int, edges: list[tuple[float, int, int]], least: int):
        self.n = n
        self.up: dict[int, int] = {}  # cluster: the one it splits off
        self.born = {0: 0.0}  # cluster: density at its birth
        self.left: dict[int, tuple[int, float]] = {}  # point: the cluster it drops out of, and at what density
        halves, weight = self._merges(edges)
        top = 2 * n - 2
        walk = [(top, 0)]
        while walk:
            node, cluster = walk.pop()
            if node < n:
                self.left[node] = (cluster, np.inf)
                continue
            a, b, away = halves[node]
            dense = 1.0 / away
            large = [x for x in (a, b) if weight[x] >= least]
            if len(large) == 2:
                for x in large:
                    new = len(self.born)
                    self.up[new], self.born[new] = cluster, dense
                    walk.append((x, new))
                continue
            for x in (a, b):
                if x in large:
                    walk.append((x, cluster))
                else:
                    for p in self._points(x, halves):
                        self.left[p] = (cluster, dense)

    def _merges(self, edges):
        root, halves, weight = list(range(self.n)), {}, dict.fromkeys(range(self.n), 1)
        top = list(range(self.n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, (away, a, b) in enumerate(edges):
            a, b, node = find(a), find(b), self.n + i
            halves[node] = (top[a], top[b], away)
            weight[node] = weight[top[a]] + weight[top[b]]
            root[b] = a
            top[a] = node
        return halves, weight

    def _points(self, node, halves):
        walk = [node]
        while walk:
            x = walk.pop()
            if x < self.n:
                yield x
            else:
                walk += halves[x][:2]

    def stability(self) -> dict[int, float]:
        """How much density its members have seen in each cluster."""
        size: dict[int, int] = defaultdict(int)
        gained = dict.fromkeys(self.born, 0.0)
        for cluster, dense in self.left.values():
            gained[cluster] += min(dense, 1.0 / CLOSEST) - self.born[cluster]
            size[cluster] += 1
        for cluster in sorted(self.up, reverse=True):  # parts come after what they split off
            above = self.up[cluster]
            gained[above] += (self.born[cluster] - self.born[above]) * size[cluster]
            size[above] += size[cluster]
        return gained

    def most_stable(self) -> set[int]:
        """Clusters that are as stable as all chosen below them; the whole pool may be one."""
        gained = self.stability()
        below: dict[int, list[int]] = defaultdict(list)
        for x, above in self.up.items():
            below[above].append(x)
        chosen: dict[int, set[int]] = {}
        for cluster in sorted(self.born, reverse=True):
            parts = sum(gained[x] for x in below[cluster])
            if parts > gained[cluster]:
                gained[cluster] = parts
                chosen[cluster] = set().union(*(chosen.pop(x) for x in below[cluster]))
            else:
                for x in below[cluster]:
                    chosen.pop(x)
                chosen[cluster] = {cluster}
        return chosen[0]

    def widened(self, chosen: set[int], reach: float) -> set[int]:
        """Chosen clusters born closer than ``reach`` give way to the first above them that is not."""
        if chosen == {0}:
            return chosen
        out = set()
        for cluster in chosen:
            while cluster and 1.0 / self.born[cluster] < reach:
                cluster = self.up[cluster]
            out.add(cluster)
        return {x for x in out if not any(y in out for y in self._above(x))}

    def _above(self, cluster: int):
        while cluster in self.up:
            cluster = self.up[cluster]
            yield cluster


def density_clusters(vectors: np.ndarray, threshold: float, least: int = 2) -> np.ndarray:
    """Labels of a pool's vectors; a label is the index of its cluster's first member.

    Clusters have ``least`` members and are those whose members stay together
    over the widest band of densities; none is split inside a cosine of
    ``threshold``. The whole pool may be one cluster, of which then only points
    with a neighbour within the threshold are members. All others stand alone.
    """
    n = len(vectors)
    if n <= 1:
        return np.zeros(n, dtype=np.int64)
    reach = max(0.0, 1.0 - threshold)
    tree = _Dendrogram(n, spanning_tree(vectors), max(2, least))
    chosen = tree.widened(tree.most_stable(), reach)
    labels = np.arange(n)
    first: dict[int, int] = {}
    last = max(d for c, d in tree.left.values() if c == 0) if any(c == 0 for c, _ in tree.left.values()) else np.inf
    for point in range(n):
        cluster, dense = tree.left[point]
        while cluster not in chosen and cluster in tree.up:
            cluster = tree.up[cluster]
        if cluster not in chosen or (cluster == 0 and dense < (1.0 / reach if reach > 0 else last)):
            continue
        labels[point] = first.setdefault(cluster, point)
    return labels


def density_groups(pools: DataFrame, keys: list[str], threshold: float, least: int = 2) -> DataFrame:
    """(keys, id, cluster) of pools of vectors (keys, id, vec); a cluster is named by its smallest id.

    A pool is a partition that is merged by itself and fits a task; the time is
    quadratic in its size, the memory linear. Vocabularies without partitions
    take ``rounds.candidate_clusters``.
    """
    kinds = dict(pools.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                ids = [m["id"] for m in row.members]
                labels = density_clusters(np.array([m["vec"] for m in row.members], dtype=np.float64), threshold, least)
                out += [(*row[: len(keys)], i, ids[c]) for i, c in zip(ids, labels)]
            yield pd.DataFrame(out, columns=[*keys, "id", "cluster"])

    lists = pools.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("members"))
    return lists.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", id {kinds['id']}, cluster {kinds['id']}")
