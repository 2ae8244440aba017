"""Clustering in blocks and levels against the fit in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import hdbscan
from trackloom.operators import cluster, components, density


def table(spark, x, first=0):
    rows = [(int(i) * 3 + first, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "linear_ind bigint, x array<double>")


def blobs(seed=3, n=30, centres=4, noise=15):
    rng = np.random.default_rng(seed)
    middle = rng.uniform(-20, 20, (centres, 3))
    return np.concatenate([*(m + rng.normal(0, 0.6, (n, 3)) for m in middle), rng.uniform(-30, 30, (noise, 3))])


def same_partition(found, wanted):
    to = {}
    return all(to.setdefault(a, b) == b for a, b in zip(found, wanted, strict=True)) and len(set(to.values())) == len(to) and all((a == -1) == (b == -1) for a, b in to.items())


@pytest.mark.parametrize("kind", ["blobs", "ties"])
def test_same_tree_and_labels_as_in_memory(spark, kind):
    x = blobs() if kind == "blobs" else np.array([[i % 5, i // 5 % 4, 0] for i in range(60)], dtype=float)  # a grid, each point three times
    points = table(spark, x)
    edges = density.spanning_edges(points, 3, block=40).cache()
    wanted = hdbscan.spanning_tree(x, hdbscan.core_distances(x, 3))
    assert sorted((r["w"], r["a"] // 3, r["b"] // 3) for r in edges.collect()) == wanted
    for least, nodes in ((5, 1000),) if kind == "blobs" else ((12, 45),):
        tree = density.condensed_tree(points, edges, least, nodes).cache()
        labels, strength, memory = hdbscan.fit(x, least, 3)
        assert sorted((r["lambda"], r["size"]) for r in tree.collect()) == sorted((d, s) for _, _, d, s in memory)
        found = {r["linear_ind"] // 3: r for r in density.leaf_clusters(tree).collect()}
        assert same_partition([found[i]["label"] if i in found else -1 for i in range(len(x))], labels.tolist())
        birth, top = hdbscan.densities(memory, len(x))
        for i, r in found.items():
            assert (r["prob"], r["birth"], r["top"]) == (strength[i], birth[labels[i]], top[labels[i]])


def test_fit_beyond_a_block_gives_the_same_rows(spark, monkeypatch):
    points = table(spark, blobs(5)).withColumn("g", (F.col("linear_ind") % 2).cast("int"))
    for by in ("g",):
        local = cluster.fitted(points, 6, 3, by).collect()
        with monkeypatch.context() as m:
            m.setattr(cluster, "LOCAL_POINTS", 50)
            m.setattr(hdbscan, "MOST_POINTS", 67)
            wide = cluster.fitted(points, 6, 3, by).collect()
        key = lambda r: (r["g"] if by else 0, r["linear_ind"])
        local, wide = sorted(local, key=key), sorted(wide, key=key)
        assert [key(r) for r in local] == [key(r) for r in wide]
        for g in {key(r)[0] for r in local}:
            assert same_partition([r["label"] for r in wide if key(r)[0] == g], [r["label"] for r in local if key(r)[0] == g])
        assert [(r["prob"], r["core"]) for r in local] == [(r["prob"], r["core"]) for r in wide]


def test_few_points(spark):
    none = table(spark, np.empty((0, 2)))
    one = table(spark, np.ones((1, 2)))
    for points in (none, one):
        edges = density.spanning_edges(points, 2)
        assert edges.count() == 0 and density.condensed_tree(points, edges, 2).count() == 0
    three = table(spark, np.array([[0.0, 0], [1, 0], [5, 0]]))
    assert sorted(r["w"] for r in density.spanning_edges(three, 9).collect()) == [5.0, 5.0]  # fewer points than min_samples


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(1000, 1030)] + [(7, 7), (5000, 4000), (4000, 5000)]
    above = {}

    def top(n):
        while above.setdefault(n, n) != n:
            n = above[n]
        return n

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            above[b] = a
    wanted = sorted((n, top(n)) for n in above if any(n in e and e[0] != e[1] for e in edges))
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert sorted(map(tuple, components.components(df).collect())) == wanted
    monkeypatch.setattr(components, "TASK_EDGES", 60)
    assert sorted(map(tuple, components.components(df).collect())) == wanted
    assert components.components(df.where("false")).count() == 0
