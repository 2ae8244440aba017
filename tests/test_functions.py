import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.functions import hdbscan
from trackloom.functions.hungarian import assign, total_cost


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_optimal(n, m, data):
    cost = np.array(data.draw(st.lists(st.lists(st.integers(-9, 9), min_size=m, max_size=m), min_size=n, max_size=n)), dtype=float)
    pairs = assign(cost)
    assert len(pairs) == min(n, m) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
    small = cost if n <= m else cost.T
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert total_cost(cost, pairs) == pytest.approx(best)


def test_assignment_edges():
    assert assign(np.empty((0, 3))) == []
    with pytest.raises(ValueError):
        assign([[np.nan]])


def test_blobs_are_clusters():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    labels, strength, tree = hdbscan.fit(x, 10, 3)
    for i in range(3):
        own = labels[30 * i : 30 * i + 30]
        assert len(set(own) - {-1}) == 1 and (own >= 0).mean() > 0.7
    assert len(set(labels) - {-1}) == 3
    assert ((strength >= 0) & (strength <= 1)).all()
    assert sorted(c for _, c, _, _ in tree if c < 90) == list(range(90))


def test_fits_of_few_and_equal_points():
    assert hdbscan.fit(np.zeros((1, 2)), 2, 1)[0].tolist() == [-1]
    labels, strength, _ = hdbscan.fit(np.zeros((6, 2)), 2, 1)
    assert len(labels) == 6 and np.isfinite(strength).all()


def test_core_distance_counts_the_point_itself():
    assert hdbscan.core_distances(np.array([[0.0], [1.0], [3.0]]), 2).tolist() == [1.0, 1.0, 2.0]
    assert hdbscan.sizes_for(50) == (25, 1) and hdbscan.sizes_for(2) == (2, 1) and hdbscan.sizes_for(100, 7, 0.05) == (7, 5)
