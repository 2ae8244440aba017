"""What is shuffled and done must grow as the input does."""

from __future__ import annotations

import numpy as np

from trackloom.functions.distances import nearest_in_block
from trackloom.operators import agglomeration, density, graph


def test_copies_of_points_do_not_grow_with_their_number():
    for n in (100_000, 600_000):
        assert graph.blocks_of(n, 4096) <= 10 and graph.blocks_of(n, 512) <= 10
    assert graph.blocks_of(10_000, 4096) == 3 and graph.blocks_of(0, 4096) == 1
    assert 3_000_000 / graph.blocks_of(3_000_000, 4096) <= graph.MOST_POINTS  # a task's block stays bounded


def test_nearest_by_groups_of_columns_is_exact_with_ties():
    r = np.random.default_rng(3)
    b = np.repeat(r.integers(0, 3, (700, 4)).astype(float), 3, axis=0)
    ids = r.permutation(len(b))
    d = np.sqrt(((b[:90, None] - b) ** 2).sum(axis=2))
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :7]
    got_d, got_i = nearest_in_block(b[:90], b, ids, 7)
    assert (got_i == ids[order]).all() and (got_d == np.take_along_axis(d, order, axis=1)).all()


def test_large_blocks_are_searched_in_single_precision_exactly():
    from trackloom.functions import distances

    r = np.random.default_rng(4)
    plain = r.normal(size=(6000, 8))
    outlier, copies = plain.copy(), plain.copy()
    outlier[7] *= 1e6
    copies[::9] = copies[0]
    for b in (plain, plain + 1000, outlier, copies, plain * 1e-9, plain * 1e15, plain[:, :1], np.round(plain)):
        ids, a = r.permutation(len(b)), b[:60]
        d = np.sqrt(((a[:, None] - b) ** 2).sum(axis=2))
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :5]
        got_d, got_i = nearest_in_block(a, b, ids, 5)
        assert (got_i == ids[order]).all() and (got_d == np.take_along_axis(d, order, axis=1)).all()
    looked = sum(len(at) for _, _, at, _ in distances._by_groups(outlier[100:400], outlier, np.zeros(8), 5))
    assert looked < 300 * (5 * 2 + distances.GROUP)  # a far point widens what is measured anew by its own group alone


def test_a_point_moves_as_often_whatever_their_number(spark, monkeypatch):
    """Copies that pairs of blocks take: they grew from 6 to 16 a point between a tenth of a GB and one."""
    points = spark.range(300).selectExpr("id as linear_ind", "array(double(id % 17), double(id % 5)) as x").cache()
    dealt, group = [], type(points).groupBy
    monkeypatch.setattr(type(points), "groupBy", lambda df, *by: (dealt.append(df) if by == ("i", "j") else None, group(df, *by))[1])
    copies = []
    for n in (30, 300):
        some = points.where(f"linear_ind < {n}")
        rows = graph.knn(some, 3, block=10).collect()
        assert len(rows) == 3 * n and all(r.rk != 1 or r.dist == 0 for r in rows)
        copies.append(dealt.pop().count() / n)
    assert copies == [8, 8]


def test_vectors_of_unequal_length_are_no_points(spark):
    import pytest

    for rows in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0]), (2, None)]):
        with pytest.raises(Exception, match="one length"):
            graph.knn(spark.createDataFrame(rows, "linear_ind bigint, x array<double>"), 1).collect()


def test_knn_of_many_small_blocks_is_that_of_one(spark):
    r = np.random.default_rng(5)
    points = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(120)], "linear_ind bigint, x array<double>")
    rows = lambda block: {tuple(x) for x in graph.knn(points, 4, block=block).select("src", "dst", "rk").collect()}
    assert rows(3) == rows(4096)


def _chain(spark):
    edges = spark.createDataFrame([(a, b) for a in range(40) for b in (a - 1, a, a + 1, (a * 7) % 40) if 0 <= b < 40], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(r, n, k + 1) for r, ns in ((0, (0, 13, 39)), (4, (5, 20))) for k, n in enumerate(ns)], "run int, node bigint, label int")
    return edges, seeds


def test_blocks_of_shares_are_few_however_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_BLOCKS", 3)
    assert graph.blocks_of(40, 2) == 3
    edges, seeds = _chain(spark)
    rows = lambda df: {(r.run, r.node): (r.label, round(r.p, 9)) for r in df.collect()}
    assert rows(graph.seed_shares(edges, seeds, 4, node_block=2, label_chunk=2)) == rows(graph.seed_shares(edges, seeds, 4))


def test_shares_of_more_nodes_than_a_block_need_no_shuffle_per_step(spark, monkeypatch):
    edges, seeds = _chain(spark)
    want = {tuple(r) for r in graph.seed_shares(edges, seeds, 3).select("run", "node", "label").collect()}
    monkeypatch.setattr(graph, "NODE_BLOCK", 10)
    monkeypatch.setattr(graph, "BAND", 7)
    monkeypatch.setattr(graph, "COLUMN_CELLS", 80)  # two labels a task: a run's labels meet after
    monkeypatch.setattr(graph, "blocks_of", None)
    assert {tuple(r) for r in graph.seed_shares(edges, seeds, 3).select("run", "node", "label").collect()} == want


def test_buckets_of_nearly_all_points_are_not_joined(spark, monkeypatch):
    """Twelve tables whose buckets hold all points: every pair would be a row, twelve times."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    r = np.random.default_rng(6)
    points = spark.createDataFrame([(i, (r.normal(size=8) / 8).tolist()) for i in range(90)], "linear_ind bigint, x array<double>")
    want = {tuple(x) for x in graph.knn(points, 4).where("dist <= 0.4").select("src", "dst").collect()}
    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", None)
    assert {tuple(x) for x in graph.knn_lsh(points, 4, 0.4, tables=12, width=1.0).select("src", "dst").collect()} == want


def test_windows_of_a_frame_are_found_without_the_list_of_all(spark):
    from pyspark.sql import functions as F

    from trackloom.operators import frames

    for n_frames, width, stride in ((11, 4, 2), (11, 4, 3), (12, 5, 7), (5, 5, 2), (4, 6, None), (1, 1, 1), (6, 5, 2), (9, 3, 1)):
        rows = spark.range(n_frames).select(F.col("id").cast("int").alias("t"))
        every = spark.range(1).select(F.explode(F.array_distinct(frames.window_starts(F.lit(n_frames), width, stride))).alias("start")).collect()
        want = sorted((s, t) for s, in every for t in range(n_frames) if s <= t < s + width)
        found = frames.overlapping_windows(rows, width, stride)
        assert sorted(tuple(r) for r in found.collect()) == want and found.schema["start"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan.lower().replace("filter (", "")  # no row goes through all starts


def test_votes_of_a_frame_are_fused_as_the_assignment_of_most_votes(spark):
    from itertools import permutations

    from trackloom.operators import sync

    votes = {5: {(1, 2): 3, (1, 4): 1, (2, 2): 2, (3, 4): 5}, 6: {(9, 1): 1}}
    rows = [(t, o, lab, n) for t, of in votes.items() for (o, lab), n in of.items()]
    found = sync.fuse_votes(spark.createDataFrame(rows, "t int, linear_ind bigint, label int, n bigint"), 5).collect()
    assert {r.t: round(sum(x.confidence for x in found if x.t == r.t) * 5) for r in found} == {
        t: max(sum(of.get(p, 0) for p in zip(os, sorted({lab for _, lab in of}))) for os in permutations(sorted({o for o, _ in of}), len({lab for _, lab in of}))) for t, of in votes.items()
    }
    assert sorted((r.t, r.linear_ind, r.label) for r in found) == [(5, 1, 2), (5, 3, 4), (6, 9, 1)]


def test_size_estimates_do_not_multiply_over_rounds(spark):
    """A checkpoint keeps its plan's estimate, and a join's is a product: in six rounds it had a hundred thousand digits."""
    r = np.random.default_rng(2)
    points = spark.createDataFrame([(i, r.normal(size=2).tolist()) for i in range(250)], "linear_ind bigint, x array<double>")
    edges = density.spanning_edges(points, 2)
    assert edges.count() == 249
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert bits(edges) < 500
    assert bits(density.condensed_tree(points, edges, 4, task_nodes=40)) < 500


def test_a_deep_tree_takes_memory_by_its_rows():
    import tracemalloc

    import pandas as pd

    n = 3000  # a caterpillar: a point falls out at each node
    inner = [(-1 - i, -i if i else -1, False, 0) for i in range(n)]
    rows = pd.DataFrame([*inner, *((n + i, -1 - i, True, i) for i in range(n))], columns=["node", "parent", "is_point", "point"])
    rows = rows.assign(t=rows.point, score=1.0, order=rows.point, label=0)
    tracemalloc.start()
    found = list(agglomeration._accept(rows, n, 2, 0.5, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and all(x[4] for x in found)
    assert peak < 12e6


def test_neighbours_neighbours_are_measured_by_pairs_of_blocks(spark):
    """A point is in very many groups: of each pair of blocks its nearest alone go on, whatever the blocks."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    x, held, member = r.normal(size=(30, 3)), 3, [(g, int(n), bool(r.random() < 0.5)) for g in range(80) for n in r.choice(30, 9, replace=False)]
    chosen = spark.createDataFrame(member, "grp bigint, node bigint, fresh boolean")
    far = spark.createDataFrame([(i, 1.5) for i in range(30)], "node bigint, far double")
    of = {}
    for g, n, f in member:
        of.setdefault(g, []).append((n, f))
    pairs = {(a, b) for ms in of.values() for a, f in ms for b, h in ms if a != b and (f or h)}
    near = lambda rows: {s: sorted((d, t) for a, t, d in rows if a == s)[:held] for s in {a for a, _, _ in rows}}
    want = near([(a, b, d) for a, b in pairs if (d := float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) < 1.5])
    for blocks in (1, 3):
        rows = [(i, i % blocks, i // blocks, x[i].tolist()) for i in range(30)]
        points = spark.createDataFrame(rows, "node bigint, block int, at int, x array<double>")
        found = [tuple(row) for row in graph._met(chosen, points, far, blocks, held).collect()]
        assert near(found) == want and len(found) <= 30 * held * blocks < len(pairs)
    assert graph._met(chosen.where("false"), points, far, 3, held).count() == 0
    assert 600_000 / graph.blocks_of(600_000, 4096, graph.DESCENT_BLOCKS, graph.DESCENT_POINTS) >= 100_000  # few copies
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(90, 3)))], "linear_ind bigint, x array<double>")
    all_rows = lambda block: sorted(map(tuple, graph.knn_descent(plain, 4, rounds=2, block=block).select(F.col("src"), "dst", "rk").collect()))
    assert all_rows(20) == all_rows(4096)


def test_the_tracker_searches_the_same_way_whatever_the_number_of_points(spark, monkeypatch):
    """Beyond a number of points the graph was that of the search among neighbours' neighbours, which is not exact."""
    from trackloom.plans.tracker import Tracker

    r = np.random.default_rng(12)
    data = [(t * 3 + k, t, k, 0.5, (np.eye(4)[k] * 9 + r.normal(0, 0.2, 4)).tolist()) for t in range(8) for k in range(3)]
    points = spark.createDataFrame(data, "linear_ind bigint, t int, raw_neuron_ind int, likelihood double, x array<double>")
    monkeypatch.setattr(graph, "EXACT_POINTS", 1, raising=False)
    monkeypatch.setattr(graph, "knn_descent", None)
    assert Tracker(points, 8, neighbours=5, steps=3).track("label_propagation").count() > 12
    assert Tracker(points, 8, cluster_size=0.7, layout_dimensions=2, layout_neighbours=5).track("global").count() >= 0


def test_products_of_columns_take_no_row_for_each_pair_of_runs(spark, monkeypatch):
    """An object of 100 runs made 10,000 rows; 2,000 columns went 30 times through all objects instead."""
    from trackloom.operators import sync

    r = np.random.default_rng(11)
    full = np.zeros((40, 15))  # objects by 5 runs of 3 labels
    for o in range(40):
        for run in range(5):
            if r.random() < 0.8:
                full[o, run * 3 + r.integers(3)] = r.random() + 0.1
    rows = [(10 + int(c) // 3, int(o), int(c) % 3 + 1, float(full[o, c])) for o, c in zip(*np.nonzero(full))]
    entries = spark.createDataFrame(rows, "run int, linear_ind bigint, label int, val double")
    for name, value in (("gram_matrix", None), ("GATHERED", 7), ("GRAM_CELLS", 40)):
        monkeypatch.setattr(sync, name, value, raising=False)
    values, vectors = sync._leading_dense(entries, {10 + i: i for i in range(5)}, 3)
    want, directions = np.linalg.eigh(full.T @ full)
    assert np.allclose(values, want[::-1][:3]) and np.allclose(abs((vectors * directions[:, ::-1][:, :3]).sum(axis=0)), 1)
    assert sync.DENSE_COLUMNS >= 100 * (10 + 10)  # the tracker's runs of ten labels and ten spare


def test_edges_of_unequal_numbers_are_summed_side_by_side(spark, monkeypatch):
    r = np.random.default_rng(13)
    pairs = sorted({(a, int(b)) for a in range(50) for b in r.integers(0, 50, a % 7)})
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    seeds = spark.createDataFrame([(run, 7 * run + k, k + 1) for run in range(3) for k in range(5)], "run int, node bigint, label int")
    monkeypatch.setattr(graph, "BAND", 11)
    table = lambda df: {(x.run, x.node): (x.label, round(x.p, 12)) for x in df.collect()}
    want = table(graph.label_topk(graph.label_rownorm(graph.propagate(edges, seeds, 3, least=0.0).where("p > 0")), 1))
    got = table(graph.seed_shares(edges, seeds, 3))
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_neighbours_that_are_a_share_of_the_points_are_no_rows(spark, monkeypatch):
    """2 % of the frames as neighbours were as many rows for each point and block: the square of the points."""
    from trackloom.functions import hdbscan

    r = np.random.default_rng(14)
    x = np.concatenate([r.normal(c, 1.0, (50, 3)) for c in (0, 3, 9)] + [np.repeat(r.normal(5, 1, (5, 3)), 4, axis=0)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "linear_ind bigint, x array<double>")
    knn = graph.knn
    monkeypatch.setattr(graph, "knn", lambda points, k, *a, **b: knn(points, k, *a, **b) if k <= 20 else None)
    for name, value in (("MOST_ROWS", 20), ("KEPT", 30 * 40), ("PACKED", 9), ("MOST_BLOCKS", 3)):
        monkeypatch.setattr(graph, name, value, raising=False)
    want = hdbscan.spanning_tree(x, hdbscan.core_distances(x, 40))
    edges = density.spanning_edges(points, 40, block=60)
    assert sorted((e.w, e.a, e.b) for e in edges.collect()) == want
    held = density.cores(points, 40, block=60).collect()
    assert {h.linear_ind: h.core for h in held} == dict(enumerate(hdbscan.core_distances(x, 40).tolist()))
    near = {(n.src, n.dst, n.dist) for n in knn(points, density.NEAR).collect()}
    assert {(h.linear_ind, e.dst, e.dist) for h in held for e in h.near} == near
    far = density.cores(points.where("linear_ind < 12"), 40).collect()  # fewer points than neighbours: the farthest
    assert {h.linear_ind: h.core for h in far} == dict(enumerate(hdbscan.core_distances(x[:12], 40).tolist()))
    assert density.cores(points.where("false"), 40).count() == 0


def test_nearest_of_rows_that_come_by_blocks_are_those_of_all():
    from trackloom.functions.distances import Nearest

    r = np.random.default_rng(15)
    for x in (r.normal(size=(500, 5)), np.round(r.normal(size=(500, 2))), np.ones((400, 3)), r.normal(size=(400, 4)) * 1e15, r.normal(size=(300, 64)) + 100):
        ids = r.permutation(len(x))
        for k, few in ((40, 16), (5, 5), (len(x), 3)):
            state = Nearest(x[:270], k, few)
            for lo in range(0, len(x), 130):
                state.add(ids[lo : lo + 130], x[lo : lo + 130])
            d, i = nearest_in_block(x[:270], x, ids, k)
            assert (state.last() == d[:, -1]).all() and (state.near == d[:, :few]).all() and (state.ids == i[:, :few]).all()


def test_least_edges_are_found_in_single_precision_exactly(monkeypatch):
    r = np.random.default_rng(16)
    monkeypatch.setattr(density, "TILE", 100)
    monkeypatch.setattr(density, "WAITING", 50)
    for x in (r.normal(size=(300, 5)), np.round(r.normal(size=(300, 2))), np.ones((300, 3)), r.normal(size=(300, 4)) * 1e15):
        ids, core, comp = r.permutation(300), r.random(300) * abs(x).max(), r.integers(0, 9, 300)
        a, b = slice(0, 290), slice(100, 300)
        w = np.maximum(np.maximum(np.sqrt(((x[a][:, None] - x[b]) ** 2).sum(axis=2)), core[a][:, None]), core[b])
        low, high = np.minimum(ids[a][:, None], ids[b]), np.maximum(ids[a][:, None], ids[b])
        want = {}
        for c in range(9):
            at = (comp[a][:, None] == c) & (comp[b] != c)
            want[c] = min(zip(w[at].tolist(), low[at].tolist(), high[at].tolist()))
        for most in (np.full(290, np.inf), np.array([want[c][0] for c in comp[a]])):
            found = density._bests((ids[a], x[a], core[a], comp[a], most), (ids[b], x[b], core[b], comp[b]))
            assert {int(c): (float(v), int(lo), int(hi)) for c, v, lo, hi in zip(*found)} == want


def test_the_search_among_neighbours_neighbours_begins_near_its_end(spark, monkeypatch):
    """From random cells of 6 k points it went through nearly all points' pairs, round by round."""
    r = np.random.default_rng(17)
    x = r.normal(size=(900, 12))
    x[700:] = x[700]  # points that no plane parts
    points = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(x)], "linear_ind bigint, x array<double>")
    met, rounds = graph._met, []
    monkeypatch.setattr(graph, "CELL", 150, raising=False)
    monkeypatch.setattr(graph, "_met", lambda *a: (rounds.append(1), met(*a))[1])
    found = {(a.src, a.dst): a.dist for a in graph.knn_descent(points, 5).collect()}
    want = {(a.src, a.dst): a.dist for a in graph.knn(points.where("linear_ind < 4900"), 5).collect()}
    assert len(found) == 5 * 900 and sum(pair in found for pair in want) >= 0.95 * len(want)
    assert all(d == 0 for (a, _), d in found.items() if a >= 4900) and len(rounds) <= 3


def test_planes_halve_a_sample_and_leaves_of_equal_points_are_dealt():
    r = np.random.default_rng(18)
    x = r.normal(size=(512, 6))
    levels, pieces = graph._planes(x, 5120, 640, 3)
    at = np.zeros(512, dtype=np.int64)
    for level in levels:
        at = graph._beyond(x, at, *level)
    assert np.bincount(at).tolist() == [64] * 8 and pieces.tolist() == [1] * 8
    assert graph._planes(np.ones((512, 6)), 5120, 640, 3)[1].tolist() == [6] + [1] * 7
