"""Agglomeration in pieces of the tree against the rule followed over the whole tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import agglomeration, cluster

TREE = "parent bigint, child bigint, lambda double, size bigint, point bigint"
SEEN = "linear_ind bigint, t int, score double, label int"


def grown(rng, n):
    """Rows of a random tree over n points: nodes split, or lose points one by one."""
    rows, name = [], iter(range(10_000, 100_000))

    def grow(node, points):
        while len(points) > 1 and rng.random() < 0.3:
            rows.append((node, int(points[0]), 1.0, 1, int(points[0])))
            points = points[1:]
        if len(points) < 4:
            rows.extend((node, int(p), 1.0, 1, int(p)) for p in points)
            return
        at = int(rng.integers(2, len(points) - 1))
        for part in (points[:at], points[at:]):
            child = next(name)
            rows.append((node, child, 1.0, len(part), None))
            grow(child, part)

    grow(next(name), np.arange(n))
    return rows


def one_by_one(spark, tree, seen, min_kept, least, patience, alpha):
    """The rule as the docstring tells it, everything computed anew at every step."""
    above = {c: p for p, c, *_ in tree}
    leaf = {point: c for _, c, _, _, point in tree if point is not None}
    frame, score = {p: t for p, t, _, _ in seen}, {p: s for p, _, s, _ in seen}
    label = {p: k for p, _, _, k in seen if k and k > 0}
    frames = [r["t"] for r in spark.createDataFrame([(t,) for t in set(frame.values())], "t int").orderBy(F.xxhash64(F.lit(0), "t")).collect()]

    def path(node):
        while node is not None:
            yield node
            node = above.get(node)

    under = {}
    for p, node in leaf.items():
        for a in path(node):
            under.setdefault(a, []).append(p)
    good = lambda kept, members: (1 - alpha) * len(kept) / len(members) + alpha * len(kept) / len(frames)
    taken, used, out, number, idle = set(), set(), set(), 0, 0

    def keep(members):
        kept = set()
        for t in {frame[p] for p in members}:
            kept.add(max((p for p in members if frame[p] == t), key=lambda p: (p not in taken, score[p], p)))
        return kept

    for t in frames:
        new = False
        for p in sorted(p for p in leaf if frame[p] == t):
            if p in taken:
                continue
            options, first = [], leaf[p]
            members = [q for q in label if label[q] == label.get(p)]
            if members and len(members) <= 1.2 * len(frames) and len(keep(members)) >= 0.8 * len(members):
                first = above[leaf[p]]
                if label[p] not in used:
                    options.append((good(keep(members), members), first, members, False))
            for node in path(first):
                if min_kept <= len(under[node]) <= 2 * len(frames) and len(kept := keep(under[node])) >= min_kept and not kept & taken:
                    value = good(kept, under[node])
                    if value > (options[-1][0] + 1e-6 if options else least):
                        options.append((value, node, under[node], True))
            if options and options[-1][0] > least and not keep(options[-1][2]) & taken:
                _, node, members, changed = options[-1]
                kept = keep(members)
                number += 1
                new |= changed
                if label.get(p) and options[0][3] is False:
                    used.add(label[p])
                taken |= kept
                out |= {(number, node, q, q in kept) for q in members}
        idle += not new
        if idle > patience:
            break
    return out


@pytest.mark.parametrize("case", range(5))
def test_pieces_give_what_the_whole_tree_gives(spark, case):
    rng = np.random.default_rng(case)
    n, n_frames = 150, (9, 14, 20, 9, 400)[case]
    tree = grown(rng, n)
    label = np.where(rng.random(n) < 0.6, np.arange(n) // 8, 0) if case % 2 else np.zeros(n)
    seen = [(p, p % n_frames if case != 2 else int(rng.integers(n_frames)), float(rng.integers(4)), int(label[p]) or None) for p in range(n)]
    patience, min_kept, least = (1, 3, 50)[case % 3], (2, 3, 1)[case % 3], (0.1, 0.3, 0.2)[case % 3]
    wanted = one_by_one(spark, tree, seen, min_kept, least, patience, 0.9)
    table, det = spark.createDataFrame(tree, TREE), spark.createDataFrame(seen, SEEN)
    table = table if case % 2 else table.drop("size")
    found = cluster.agglomerate(table, det, min_kept, least, patience, task_rows=60)
    assert {tuple(r) for r in found.collect()} == wanted and wanted
    if case < 2:  # one piece of everything
        assert {tuple(r) for r in cluster.agglomerate(table, det, min_kept, least, patience).collect()} == wanted
    if n_frames < 20:
        split = agglomeration.pieces(table, 2 * n_frames)
        assert split.select("piece").distinct().count() > 3
        assert split.where("point is not null").groupBy("piece").count().where(f"count > {2 * n_frames}").isEmpty()
        assert split.where("point is not null").count() == n


def test_odd_trees(spark):
    det = spark.createDataFrame([(0, 0, None, None), (1, 1, None, None), (2, 1, 1.0, None)], SEEN)
    none = spark.createDataFrame([], TREE)
    assert cluster.agglomerate(none, det).isEmpty() and cluster.agglomerate(none, det.limit(0)).isEmpty()
    tree = spark.createDataFrame([(9, 0, 1.0, 1, 0), (9, 1, 1.0, 1, 1), (9, 2, 1.0, 1, 2), (9, 3, 1.0, 1, 3)], TREE)
    found = {tuple(r) for r in cluster.agglomerate(tree, det).collect()}
    assert found == {(1, 9, 0, True), (1, 9, 1, False), (1, 9, 2, True)}  # point 3 has no detection; a null score is the least


def test_labels_that_join_too_much(spark, monkeypatch):
    monkeypatch.setattr(agglomeration, "MOST_ROWS", 3)
    tree = spark.createDataFrame(grown(np.random.default_rng(1), 60), TREE)
    det = spark.createDataFrame([(p, p % 20, 1.0, None) for p in range(60)], SEEN)
    with pytest.raises(ValueError, match="one piece"):
        cluster.agglomerate(tree, det, task_rows=10)
