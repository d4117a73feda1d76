"""Semantic batches: grouping the answers of one question by meaning and size.

A group is the answers kept for one question. Retrieval bounds it by top-k
(500 at most), so one task per question is enough and questions run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BUCKET_TOKENS = 2_000
MIN_VARIANCE = 0.75
MAX_DIMENSIONS = 100
DIVIDERS = (2, 3, 4, 5, 6)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Scaled principal components when there are more dimensions than texts allow for."""
    width = min(MAX_DIMENSIONS, len(x))
    if x.shape[1] <= width:
        return x
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    total = (s ** 2).sum()
    if total == 0 or (s[:width] ** 2).sum() / total < MIN_VARIANCE:
        return x
    return u[:, :width] * s[:width]


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean, symmetric, with a zero diagonal."""
    squared = (x ** 2).sum(1)
    d = np.sqrt(np.maximum(squared[:, None] + squared[None, :] - 2 * x @ x.T, 0.0))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0.0)
    return d


def ward(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (left, right, height) in order; the i-th merge makes node n + i."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, node, merges = np.ones(n), np.arange(n), []
    for step in range(n - 1):
        a, b = divmod(int(np.argmin(d)), n)
        a, b = min(a, b), max(a, b)
        height = d[a, b]
        merges.append((*sorted((int(node[a]), int(node[b]))), float(height)))
        total = size[a] + size[b] + size
        with np.errstate(invalid="ignore"):
            joined = np.sqrt(np.maximum(((size[a] + size) * d[a] ** 2 + (size[b] + size) * d[b] ** 2
                                         - size * height ** 2) / total, 0.0))
        joined[~np.isfinite(d[a]) | ~np.isfinite(d[b])] = np.inf
        d[a, :], d[:, a] = joined, joined
        d[b, :], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        node[a] = n + step
    return merges


def leaf_order(merges: list[tuple[int, int, float]], dist: np.ndarray) -> list[int]:
    """Order of the leaves that keeps neighbours closest among all ways to turn the tree's branches."""
    n = len(dist)
    children = {n + i: (left, right) for i, (left, right, _) in enumerate(merges)}
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    cost = np.full((n, n), np.inf)
    np.fill_diagonal(cost, 0.0)

    def sides(node: int, leaf_first: list[int]) -> list[int]:
        """Leaves that can end the branch when one of ``leaf_first`` starts it."""
        if node < n:
            return [node]
        left, right = children[node]
        return leaves[right] if leaf_first[0] in set(leaves[left]) else leaves[left]

    def halves(node: int) -> list[list[int]]:
        return [[node]] if node < n else [leaves[c] for c in children[node]]

    def through(a: list[int], m: list[int], k: list[int], b: list[int]) -> np.ndarray:
        first = np.min(cost[np.ix_(a, m)][:, :, None] + dist[np.ix_(m, k)][None, :, :], axis=1)
        return np.min(first[:, :, None] + cost[np.ix_(k, b)][None, :, :], axis=1)

    for node in range(n, n + len(merges)):
        left, right = children[node]
        leaves[node] = leaves[left] + leaves[right]
        for a in halves(left):
            for b in halves(right):
                block = through(a, sides(left, a), sides(right, b), b)
                cost[np.ix_(a, b)] = block
                cost[np.ix_(b, a)] = block.T

    def unfold(node: int, start: int, end: int) -> list[int]:
        if node < n:
            return [node]
        left, right = children[node]
        if start not in set(leaves[left]):
            left, right = right, left
        m, k = sides(left, [start]), sides(right, [end])
        total = cost[start, m][:, None] + dist[np.ix_(m, k)] + cost[k, end][None, :]
        i, j = np.unravel_index(int(np.argmin(total)), total.shape)
        return unfold(left, start, m[i]) + unfold(right, k[j], end)

    root = n + len(merges) - 1
    left, right = children[root]
    ends = cost[np.ix_(leaves[left], leaves[right])]
    i, j = np.unravel_index(int(np.argmin(ends)), ends.shape)
    return unfold(root, leaves[left][i], leaves[right][j])


def cut(merges: list[tuple[int, int, float]], order: list[int], at_most: int) -> np.ndarray:
    """Cluster of each leaf, numbered along the leaf order, with at most ``at_most`` clusters."""
    n = len(order)
    top = merges[n - 1 - at_most][2] if at_most < n else -1.0
    parent = list(range(n + len(merges)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (left, right, height) in enumerate(merges):
        if height <= top:
            parent[root(left)] = parent[root(right)] = n + i
    numbers: dict[int, int] = {}
    labels = np.zeros(n, dtype=int)
    for leaf in order:
        labels[leaf] = numbers.setdefault(root(leaf), len(numbers) + 1)
    return labels


def choose_cut(merges, order: list[int], sizes: np.ndarray, cap: int) -> np.ndarray | None:
    """The first cut whose mean cluster size is between half the cap and the cap, else the smallest mean."""
    n, rated = len(order), []
    for divider in DIVIDERS:
        if divider > n:
            continue
        labels = cut(merges, order, n // divider)
        found = np.unique(labels)
        if len(found) > 1:
            rated.append((float(np.mean([sizes[labels == c].mean() for c in found])), labels))
    for mean, labels in rated:
        if cap / 2 <= mean < cap:
            return labels
    return min(rated, key=lambda r: r[0])[1] if rated else None


def _no_singletons(labels: np.ndarray, dist: np.ndarray) -> np.ndarray:
    labels = labels.copy()
    while True:
        lone = [c for c in np.unique(labels) if (labels == c).sum() == 1]
        if not lone:
            return labels
        i = int(np.argmax(labels == lone[0]))
        others = dist[i].copy()
        others[i] = np.inf
        near = int(np.argmin(others))
        if (labels == labels[near]).sum() + 1 == len(labels):
            labels[near] = lone[0]
        else:
            labels[i] = labels[near]


def _buckets(labels: np.ndarray, order: list[int], sizes: np.ndarray, dist: np.ndarray, cap: int) -> list[list[int]]:
    rank = {leaf: i for i, leaf in enumerate(order)}
    buckets: list[list[int]] = []
    for cluster in np.unique(labels):
        held, size = [], 0
        for i in np.flatnonzero(labels == cluster):
            if held and size + sizes[i] > cap:
                buckets.append(held)
                held, size = [], 0
            held, size = [*held, int(i)], size + sizes[i]
        buckets.append(held)
    buckets = [sorted(b, key=rank.__getitem__) for b in buckets]
    while any(len(b) == 1 for b in buckets):
        at = next(i for i, b in enumerate(buckets) if len(b) == 1)
        if at == 0:
            to = 1
        elif at == len(buckets) - 1:
            to = at - 1
        else:
            before, after = (dist[buckets[at][0], buckets[at + s]].min() for s in (-1, 1))
            to = at - 1 if before < after else at + 1
        later = to > at
        if len(buckets[to]) <= 2:
            lone = buckets[at].pop()
            buckets[to].insert(0 if later else len(buckets[to]), lone)
        else:
            buckets[at].append(buckets[to].pop(0 if later else -1))
        buckets = [b for b in buckets if b]
    return buckets


def batches(vectors: np.ndarray, sizes: np.ndarray, cap: int = BUCKET_TOKENS) -> list[list[int]]:
    """Positions of the texts, batch by batch; nothing lost, no batch of one when there are two texts."""
    n = len(sizes)
    if n <= 3:
        return [list(range(n))]
    dist = distances(_reduced(vectors))
    merges = ward(dist)
    order = leaf_order(merges, dist)
    labels = choose_cut(merges, order, sizes, cap)
    if labels is None:
        return [order]
    return _buckets(_no_singletons(labels, dist), order, sizes, dist, cap)


def semantic_batches(answers: DataFrame, keys: list[str], id_col: str, cap: int = BUCKET_TOKENS) -> DataFrame:
    """Add (batch, pos) to each answer. ``answers``: keys, id, tokens, embedding; a key
    holds the answers of one question, so its number is the top-k that the question asked for."""
    fields = {f.name: f.dataType.simpleString() for f in answers.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in (*keys, id_col)] + ["batch int", "pos int"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_col, ignore_index=True)
        found = batches(np.vstack(group["embedding"].to_numpy()).astype(float), group["tokens"].to_numpy(), cap)
        rows = [(i, b, p) for b, members in enumerate(found) for p, i in enumerate(members)]
        picked = group.loc[[r[0] for r in rows], [*keys, id_col]].reset_index(drop=True)
        return picked.assign(batch=[r[1] for r in rows], pos=[r[2] for r in rows])

    return answers.select(*keys, id_col, "tokens", "embedding").groupBy(*keys).applyInPandas(run, schema)


def group_distances(answers: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Per answer: nearest other answer of its group, its distance, and the mean distance to the others."""
    fields = {f.name: f.dataType.simpleString() for f in answers.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in (*keys, id_col)]
                       + [f"other_id {fields[id_col]}", "nearest double", "mean_distance double", "leaf_rank int"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_col, ignore_index=True)
        dist = distances(np.vstack(group["embedding"].to_numpy()).astype(float))
        ids = group[id_col].to_numpy()
        out = group[[*keys, id_col]].copy()
        if len(group) == 1:
            return out.assign(other_id=None, nearest=None, mean_distance=None, leaf_rank=0)
        order = leaf_order(ward(dist), dist)
        apart = dist + np.diag(np.full(len(dist), np.inf))
        out["other_id"], out["nearest"] = ids[apart.argmin(axis=1)], apart.min(axis=1)
        out["mean_distance"] = dist.sum(axis=1) / (len(dist) - 1)
        out["leaf_rank"] = np.argsort(order)
        return out

    return answers.select(*keys, id_col, "embedding").groupBy(*keys).applyInPandas(run, schema)
