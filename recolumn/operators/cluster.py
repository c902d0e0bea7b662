"""Density clusters of each user's positives (hierarchical, by excess of mass), in numpy inside a grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class cosine_distances:
    """Cosine distances of vectors, computed by rows when asked for: d[k] or d[i:j]; no square matrix is held."""

    def __init__(self, x: np.ndarray):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        self.unit = np.divide(x, size, out=np.zeros_like(x, dtype=float), where=size > 0)

    def __len__(self) -> int:
        return len(self.unit)

    def __getitem__(self, k) -> np.ndarray:
        d = 1 - self.unit[k] @ self.unit.T
        if isinstance(k, slice):
            own = np.arange(*k.indices(len(self)))
            d[np.arange(len(own)), own] = 0
        else:
            d[k] = 0
        return np.clip(d, 0, 2).round(12)  # the same whichever product gave it, so equal heights stay equal


def density_clusters(d: np.ndarray, least: int = 5, samples: int = 3) -> np.ndarray:
    """Cluster numbers from distances (a matrix, or rows on demand), -1 for noise. Memory grows with the points, not their square.

    Mutual reachability (a point is its own first neighbour), a minimum spanning
    tree, the hierarchy of splits with at least `least` points on both sides, and from it the
    set of clusters with the largest stability. The root is never a cluster.
    """
    n = len(d)
    if n < least:
        return np.arange(n)
    nth, some = min(samples, n) - 1, max(1, (1 << 22) // n)
    core = np.concatenate([np.partition(d[i : i + some], nth, axis=1)[:, nth].copy() for i in range(0, n, some)])
    reach = lambda k: np.maximum(d[k], np.maximum(core[k], core))
    # Prim's tree
    best, source, done, edges = reach(0), np.zeros(n, int), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        k = int(np.where(done, np.inf, best).argmin())
        edges.append((best[k], source[k], k))
        done[k] = True
        row = reach(k)
        nearer = row < best
        best[nearer], source[nearer] = row[nearer], k
    # single-linkage merges
    root, size, children, heights = list(range(n)), [1] * n, {}, {}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for height, a, b in sorted(edges, key=lambda e: e[0]):
        a, b, new = find(a), find(b), len(root)
        root.append(new)
        root[a] = root[b] = new
        children[new], heights[new] = (a, b), height
        size.append(size[a] + size[b])

    def points(node) -> list[int]:
        found, walk = [], [node]
        while walk:
            node = walk.pop()
            if node < n:
                found.append(node)
            else:
                walk += children[node]
        return found

    # condensed clusters: (top node, birth, stability, children), walked from the root down
    clusters, stack = [], [(len(root) - 1, 0.0, None)]
    while stack:
        node, birth, parent = stack.pop()
        own = {"top": node, "stability": 0.0, "children": [], "parent": parent}
        clusters.append(own)
        me = len(clusters) - 1
        if parent is not None:
            clusters[parent]["children"].append(me)
        while node in children:
            density = 1 / heights[node] if heights[node] > 0 else 1e12
            a, b = children[node]
            big = [k for k in (a, b) if size[k] >= least]
            if len(big) == 2:
                own["stability"] += (density - birth) * size[node]
                stack += [(a, density, me), (b, density, me)]
                break
            gone = size[node] - (size[big[0]] if big else 0)
            own["stability"] += (density - birth) * gone
            if not big:
                break
            node = big[0]
    labels = np.full(n, -1)
    chosen: list[int] = []
    value = [c["stability"] for c in clusters]
    for k in range(len(clusters) - 1, 0, -1):
        below = sum(value[c] for c in clusters[k]["children"])
        if clusters[k]["children"] and below > value[k]:
            value[k] = below
        else:
            clusters[k]["chosen"] = True
    walk = list(clusters[0]["children"])
    while walk:
        k = walk.pop()
        if clusters[k].get("chosen"):
            chosen.append(k)
        else:
            walk += clusters[k]["children"]
    for label, own in enumerate(sorted((points(clusters[k]["top"]) for k in chosen), key=min)):
        labels[own] = label
    return labels


def user_clusters(positives: DataFrame, items: DataFrame, least: int = 5, samples: int = 3) -> DataFrame:
    """user_id, item_id, cluster of each user's positives; a user's history must fit one task."""
    rows = positives.select("user_id", "item_id").distinct().join(items.select("item_id", F.col("vector").cast("array<double>").alias("vector")), "item_id")

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item_id")
        group["cluster"] = density_clusters(cosine_distances(np.array(group.vector.tolist(), float)), least, samples)
        return group[["user_id", "item_id", "cluster"]]

    kinds = f"user_id {positives.schema['user_id'].dataType.simpleString()}, item_id {positives.schema['item_id'].dataType.simpleString()}, cluster long"
    return rows.groupBy("user_id").applyInPandas(label, kinds)
