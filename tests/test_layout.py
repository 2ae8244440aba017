"""Fuzzy neighbour graphs and layouts on planted points."""

import numpy as np
import pytest

from test_density import table
from trackloom.operators import graph, layout


def planted(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 40, (3, 10))
    return table(spark, np.concatenate([m + rng.normal(0, 1, (25, 10)) for m in middle]))


def test_weights_add_up(spark):
    near = graph.knn(planted(spark), 8).cache()
    scales = {r["src"]: r for r in layout.fuzzy_scales(near).collect()}
    far = {}
    for r in near.where("src <> dst").collect():
        far.setdefault(r["src"], []).append(r["dist"])
    assert len(scales) == 75
    for p, d in far.items():
        assert scales[p]["rho"] == min(d)
        assert np.exp(-(np.array(d) - min(d)) / scales[p]["sigma"]).sum() == pytest.approx(np.log2(8), abs=1e-5)
    w = {(r["src"], r["dst"]): r["w"] for r in layout.fuzzy_graph(near).collect()}
    assert all(w[b, a] == pytest.approx(v) and 0 < v <= 1 for (a, b), v in w.items())


def test_equal_and_lone_points(spark):
    points = table(spark, np.array([[0.0, 0], [0, 0], [0, 0], [3, 4]]))
    w = {(r["src"] // 3, r["dst"] // 3): r["w"] for r in layout.fuzzy_graph(graph.knn(points, 3)).collect()}
    assert w[0, 1] == w[1, 0] == 1.0 and all(0 < v <= 1 for v in w.values())
    alone = graph.knn(points.where("linear_ind = 0"), 3)
    assert [tuple(r) for r in layout.fuzzy_scales(alone).collect()] == [(0, 0.0, 0.0)]
    assert layout.fuzzy_graph(alone).count() == 0 and layout.spectral_layout(layout.fuzzy_graph(alone), 2).count() == 0


def test_layout_keeps_planted_groups_apart(spark):
    """Groups that share no edge lie at one place each; with a few links between them, close to it."""
    fuzzy = layout.fuzzy_graph(graph.knn(planted(spark), 8))
    links = spark.createDataFrame([(0, 75, 0.05), (75, 0, 0.05), (90, 170 // 3 * 3, 0.05), (170 // 3 * 3, 90, 0.05)], "src bigint, dst bigint, w double")
    found = {r["node"] // 3: np.array(r["x"]) for r in layout.spectral_layout(fuzzy.unionByName(links), 2, rounds=24).collect()}
    group = lambda g: np.array([found[i] for i in range(25 * g, 25 * g + 25)])
    middles = [group(g).mean(axis=0) for g in range(3)]
    spread = max(np.linalg.norm(group(g) - middles[g], axis=1).max() for g in range(3))
    assert min(np.linalg.norm(middles[a] - middles[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > 2 * spread
