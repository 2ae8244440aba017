"""Hierarchical density clustering of points in memory."""

from __future__ import annotations

import numpy as np

from trackloom.functions.distances import nearest_in_block

#: Points that one fit takes in memory: it keeps a few arrays of this length and takes its square in time.
MOST_POINTS = 50_000


def core_distances(x, k: int):
    """Distance to the k-th nearest point, the point itself being the first."""
    x = np.asarray(x, dtype=float)
    return nearest_in_block(x, x, np.arange(len(x)), k)[0][:, -1] if len(x) else np.empty(0)


def spanning_tree(x, core) -> list[tuple[float, int, int]]:
    """Edges (weight, a, b) of a minimum spanning tree under mutual reachability, by weight and ends; of
    trees of equal weight that of least edges in this order."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    every = np.arange(n)
    near, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    done = np.zeros(n, dtype=bool)
    edges, now = [], 0
    for _ in range(n - 1):
        done[now] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[now]) ** 2).sum(axis=1)), core), core[now])
        lo, hi = np.minimum(every, now), np.maximum(every, now)
        closer = ~done & ((d < near) | ((d == near) & ((lo < low) | ((lo == low) & (hi < high)))))
        near[closer], low[closer], high[closer] = d[closer], lo[closer], hi[closer]
        ties = np.flatnonzero(~done & (near == near[~done].min()))
        now = int(ties[np.lexsort((high[ties], low[ties]))[0]])
        edges.append((float(near[now]), int(low[now]), int(high[now])))
    return sorted(edges)


def merge_tree(edges, n: int) -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) for each merge; merge i makes node n + i."""
    above, size, merges = list(range(2 * n)), [1] * n, []

    def top(i):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for w, a, b in edges:
        a, b = sorted((top(a), top(b)))
        above[a] = above[b] = n + len(merges)
        size.append(size[a] + size[b])
        merges.append((a, b, w, size[-1]))
    return merges


def condensed_tree(merges, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size): splits into two parts of at least `least` points make new
    clusters, numbered from n; other points fall out of their cluster. Children under n are points."""
    if not merges:
        return []

    def leaves(node):
        stack, out = [node], []
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += merges[i - n][:2]
        return out

    size = lambda i: 1 if i < n else merges[i - n][3]
    rows, stack, fresh = [], [(n + len(merges) - 1, n)], n + 1
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        left, right, w, _ = merges[node - n]
        density = 1.0 / w if w > 0 else np.inf
        big = [s for s in (left, right) if size(s) >= least]
        if len(big) == 2:
            for side in (left, right):
                rows.append((cluster, fresh, density, size(side)))
                stack.append((side, fresh))
                fresh += 1
        else:
            for side in (left, right):
                if side in big:
                    stack.append((side, cluster))
                else:
                    rows += [(cluster, p, density, 1) for p in leaves(side)]
    return rows


def leaf_labels(tree, n: int):
    """Labels (from 0, -1 for noise) and probabilities by the clusters that have no cluster below."""
    parents = {p for p, c, _, _ in tree if c >= n}
    clusters = sorted({c for _, c, _, _ in tree if c >= n and c not in parents})
    number = {c: i for i, c in enumerate(clusters)}
    labels, strength = np.full(n, -1), np.zeros(n)
    members: dict[int, list[tuple[int, float]]] = {}
    for p, c, density, _ in tree:
        if c < n and p in number:
            members.setdefault(p, []).append((c, density))
    for cluster, points in members.items():
        finite = [d for _, d in points if np.isfinite(d)]
        top = max(finite, default=0.0)
        for point, density in points:
            labels[point] = number[cluster]
            strength[point] = 1.0 if top == 0 or not np.isfinite(density) else min(density, top) / top
    return labels, strength


def densities(tree, n: int):
    """Of each leaf cluster, by label: the density at which it begins and its greatest finite one."""
    parents = {p for p, c, _, _ in tree if c >= n}
    clusters = sorted({c for _, c, _, _ in tree if c >= n and c not in parents})
    number = {c: i for i, c in enumerate(clusters)}
    birth, top = np.zeros(len(clusters)), np.zeros(len(clusters))
    for p, c, density, _ in tree:
        if c in number:
            birth[number[c]] = density
        elif p in number and np.isfinite(density):
            top[number[p]] = max(top[number[p]], density)
    return birth, top


def fit(x, min_cluster_size: int, min_samples: int):
    """(labels, probabilities, condensed tree) of the rows of x."""
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; one fit takes {MOST_POINTS}")
    if n < 2:
        return np.full(n, -1), np.zeros(n), []
    x = np.asarray(x, dtype=float)
    edges = spanning_tree(x, core_distances(x, max(1, min_samples)))
    tree = condensed_tree(merge_tree(edges, n), n, max(2, min_cluster_size))
    labels, strength = leaf_labels(tree, n)
    return labels, strength, tree


def sizes_for(frames: int, cluster: float = 0.5, samples: float = 0.02) -> tuple[int, int]:
    """min_cluster_size and min_samples; parameters below 1 are shares of the frames; at least 2 and 1."""
    scaled = [int(v * frames) if v < 1 else int(v) for v in (cluster, samples)]
    return max(2, scaled[0]), max(1, scaled[1])
