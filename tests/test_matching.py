"""Matchings over sparse pairs against the dense assignment."""

import numpy as np
import pytest

from trackloom.functions import auction
from trackloom.functions.hungarian import assign
from trackloom.operators import matching


def best(rows, columns, weights):
    table = np.zeros((max(rows) + 1, max(columns) + 1))
    table[rows, columns] = weights
    return sum(table[r, c] for r, c in assign(-table))


def drawn(rng, n=12, m=9, share=0.3, most=20):
    pairs = [(r, c) for r in range(n) for c in range(m) if rng.random() < share] or [(0, 0)]
    return [r for r, _ in pairs], [c for _, c in pairs], rng.integers(1, most, len(pairs)).tolist()


def one_to_one(pairs):
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_auction_has_the_greatest_total():
    rng = np.random.default_rng(1)
    for case in range(150):
        rows, columns, weights = drawn(rng, *rng.integers(1, 14, 2), share=rng.uniform(0.1, 1), most=int(rng.choice([2, 4, 1000])))
        weight = dict(zip(zip(rows, columns, strict=True), weights, strict=True))
        found = auction.match(rows, columns, weights)
        assert one_to_one(found) and sum(weight[p] for p in found) == best(rows, columns, weights), case
    assert auction.match([], [], []) == []


def test_many_names_in_bounded_memory():
    """Ten thousand names with planted partners among 100,000 pairs."""
    rng = np.random.default_rng(2)
    n = 10_000
    planted = rng.permutation(n)
    rows = [*range(n), *rng.integers(0, n, 9 * n).tolist()]
    columns = [*planted.tolist(), *rng.integers(0, n, 9 * n).tolist()]
    weight = {}
    for i, (r, c) in enumerate(zip(rows, columns, strict=True)):
        weight.setdefault((r, c), 100 if i < n else int(rng.integers(1, 40)))
    found = auction.match([r for r, _ in weight], [c for _, c in weight], list(weight.values()))
    assert {r: c for r, c in found} == dict(enumerate(planted.tolist()))


@pytest.mark.parametrize("way", ["dense", "sparse", "rounds"])
def test_components_and_groups(spark, monkeypatch, way):
    if way != "dense":
        monkeypatch.setattr(matching, "CELLS", 3)
    if way == "rounds":
        monkeypatch.setattr(matching, "TASK_PAIRS", 6)
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for g in range(1 if way == "rounds" else 3):
        r, c, w = drawn(rng, 6, 5, 0.4, 6)
        wanted[g] = best(r, c, w)
        rows += [(g, a, b + 100, int(n)) for a, b, n in zip(r, c, w, strict=True)]
    rows += [(0, 50, 150, 3), (0, 51, 151, 0)]  # a component of its own, and no pair at all
    found = [tuple(r) for r in matching.matched(spark.createDataFrame(rows, "grp int, gt int, pred int, n bigint")).collect()]
    assert set(found) <= set(rows) and (0, 50, 150, 3) in found
    for g in wanted:
        some = [(b, c) for a, b, c, _ in found if a == g and b < 50]
        assert one_to_one(some) and sum(n for a, b, _, n in found if a == g and b < 50) == wanted[g]
