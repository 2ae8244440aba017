"""Planted answers, invariants and edge cases of the tracking operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import assign, cluster, corr, crops, evaluate, frames, graph, sync, trials
from trackloom.plans import catalogue
from trackloom.functions import hdbscan
from trackloom.operators.checkpoints import cut
from trackloom.plans.tracker import Tracker, window_names
from trackloom.sources import configs, fixtures
from trackloom.sources.tables import Catalog, clone, null_for_missing

SF = "/root/testdata/sf0.001"
DET = "linear_ind bigint, t int, raw_neuron_ind int, raw_seg_id int, gt_label int, likelihood double, z double, x double, y double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_match_tracks_finds_the_planted_names(spark):
    gt, pred = fixtures.gt(spark, SF), fixtures.pred(spark, SF)
    found = {g: p for g, p, _ in rows(evaluate.match_tracks(gt, pred), "gt_name", "pred_name", "n")}
    planted = {r["gt_name"]: r["pred_name"] for r in fixtures.mapping(spark, SF).collect()}
    assert found == planted


def test_accuracy_parts_add_up(spark):
    r = catalogue.queries()["accuracy_total"](spark, SF).first()
    cells = catalogue.queries()["accuracy_cells"](spark, SF)
    assert r["misses"] + r["mismatches"] + cells.where("correct").count() == r["n_gt"] and 0 <= r["accuracy"] <= 1


def test_accuracy_without_truth_is_null(spark):
    none = spark.createDataFrame([], "name int, t int, gt_seg int, pred_seg int")
    assert evaluate.accuracy(none).first()["accuracy"] is None


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(5, 0, 5, 1, 0.5), (3, 0, 3, 1, 0.5), (1, 0, 1, -1, 0.9)], "linear_ind bigint, t int, raw_neuron_ind int, label int, likelihood double")
    assert rows(assign.best_per_cell(df), "name", "raw_neuron_ind") == [(1, 3)]
    assert rows(assign.last_per_cell(df), "name", "raw_neuron_ind") == [(1, 5)]
    assert rows(assign.first_per_cell(df), "name", "raw_neuron_ind") == [(1, 1)]


def test_padding(spark):
    t = spark.createDataFrame([(0, 1.0), (1, 2.0)], "t int, v double")
    assert rows(frames.pad_rows(t, 4), "t") == [(0,), (1,), (2,), (3,)]
    assert frames.pad_rows(t, 2).count() == 2
    assert rows(frames.pad_rows(t.where("false"), 2), "t") == [(0,), (1,)]


def test_windows_leave_the_last_frame_out(spark):
    det = spark.createDataFrame([(i, i) for i in range(10)], "linear_ind bigint, t int")
    dealt = frames.overlapping_windows(det, 4)
    assert {r[0] for r in rows(dealt, "start")} == {0, 2, 4, 5} and max(r[0] for r in rows(dealt, "t")) == 8


def test_split_sizes_are_exact(spark):
    t = spark.range(11).select(F.col("id").cast("int").alias("t"))
    got = [r[0] for r in rows(frames.train_val_test_split(t, [F.col("t")], 0.7, 2), "split")]
    assert (got.count("train"), got.count("val"), got.count("test")) == (7, 2, 2)


def test_crop_voxels_pads_at_the_start(spark):
    shape, target = (2, 3, 3), (2, 2, 2)
    det = spark.createDataFrame([(1, 0, 0.0, 1.0, 2.0), (2, 0, None, 1.0, 1.0)], "linear_ind bigint, t int, z double, x double, y double")
    bounds = crops.crop_bounds(det, shape, target).withColumn("t", F.lit(0))
    video = np.arange(18, dtype=float)
    volumes = spark.createDataFrame([(0, video.tolist())], "t int, voxels array<double>").withColumn("voxels", F.col("voxels").cast("array<float>"))
    (got,) = crops.crop_voxels(bounds, crops.chunked(volumes, shape, (1, 2, 2)), shape, (1, 2, 2), target).collect()
    v = video.reshape(shape)[0:1, 0:2, 1:3]
    want = np.zeros(target)
    want[1:, :, :] = v
    assert np.array(got["voxels"]).reshape(target).tolist() == want.tolist()


def test_untracked_names_are_optional(spark):
    det = spark.createDataFrame([(7, 3, 4, 5), (8, 3, 1, 2)], "linear_ind bigint, t int, raw_neuron_ind int, raw_seg_id int")
    tracks = spark.createDataFrame([(8, 12)], "linear_ind bigint, name int")
    assert rows(crops.detection_names(det, tracks)) == [(7, "untracked_time_3_0004_0005"), (8, "neuron_012")]
    assert rows(crops.detection_names(det, tracks, include_untracked=False)) == [(8, "neuron_012")]


def test_carried_index(spark):
    t = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("a", 2, 3)], "name string, t int, raw_neuron_ind int")
    assert [r[2] for r in rows(evaluate.carried_index(t), "name", "t", "prev_ind")] == [None, 1, 1]


def planted(spark, n_frames=12, labels=5, runs=6, seed=4):
    """Labelings of n_frames frames with one object per label, each run under its own names."""
    rng = np.random.default_rng(seed)
    det = [(t * labels + k, t, k) for t in range(n_frames) for k in range(labels)]
    names = [rng.permutation(labels) + 1 for _ in range(runs)]
    runs_rows = [(r, i, t, int(names[r][k]), float(rng.uniform(0.6, 0.9))) for r in range(runs) for i, t, k in det if rng.random() < 0.9]
    return spark.createDataFrame(det, "linear_ind bigint, t int, k int"), spark.createDataFrame(runs_rows, "run int, linear_ind bigint, t int, label int, prob double")


def one_to_one(pairs):
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_spectral_sync_recovers_planted_names(spark):
    det, labelings = planted(spark)
    found = sync.spectral_sync(labelings, det).join(det, ["linear_ind", "t"])
    assert found.count() == det.count()
    assert one_to_one(set(rows(found, "label", "k")))


def test_spectral_step_without_the_matrix_agrees(spark):
    _, labelings = planted(spark, n_frames=15, labels=4, runs=7, seed=9)
    entries = cut(sync.row_normalize(assign.greedy_top1(labelings).withColumn("val", F.col("prob"))).select("run", "linear_ind", "label", "val"))
    dense, free = (rows(sync.spectral_permutations(entries, 4, dense=d), "run", "label", "mapped") for d in (1000, 0))
    assert one_to_one({(a[2], b[2]) for a, b in zip(dense, free, strict=True)})  # the same but for the names
    assert len(dense) == 28


def test_sizes_are_checked_before_anything_is_collected(spark, monkeypatch):
    _, labelings = planted(spark)
    monkeypatch.setattr(sync, "MATCH_CELLS", 3)
    with pytest.raises(ValueError):
        sync.align_pair(labelings.where("run = 0"), labelings.where("run = 1"))


def test_align_all_recovers_planted_names(spark):
    det, labelings = planted(spark)
    found = sync.align_all(labelings, list(range(6))).join(det, ["linear_ind", "t"]).where("confidence > 0")
    assert one_to_one(set(rows(found, "label", "k"))) and found.count() > 0.95 * det.count()
    assert found.groupBy("t", "label").count().where("count > 1").count() == 0


def test_align_pair_without_overlap_is_fresh(spark):
    kind = "run int, linear_ind bigint, t int, label int, prob double"
    ref, new = spark.createDataFrame([(0, 1, 0, 4, 1.0)], kind), spark.createDataFrame([(1, 2, 0, 1, 1.0), (1, 3, 0, 2, 1.0)], kind)
    assert rows(sync.align_pair(ref, new), "linear_ind", "label") == [(2, 5), (3, 6)]


def test_one_row_of_a_block_at_most_has_no_column():
    got = sync.round_block([[0.9, 0.0], [0.0, 0.01]])
    assert got == [0, None]
    assert sync.round_block([[0.9, 0.0], [0.0, 0.8]]) == [0, 1]


def test_frames_of_one_object_get_no_label(spark):
    det = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "linear_ind bigint, t int")
    votes = spark.createDataFrame([(1, 1, 3.0), (2, 1, 3.0), (3, 1, 2.0)], "linear_ind bigint, label int, votes double")
    assert rows(sync.unique_per_frame(votes, det, 3, 3), "linear_ind", "label") == [(2, 1)]


def test_knn_blocks_agree(spark):
    x = fixtures.vectors(spark, SF).where("linear_ind < 120")
    assert rows(graph.knn(x, 4, block=17), "src", "dst", "rk") == rows(graph.knn(x, 4), "src", "dst", "rk")


def test_knn_lsh_finds_near_points(spark):
    x = fixtures.vectors(spark, SF).where("linear_ind < 100")
    exact = set(rows(graph.knn(x, 3), "src", "dst"))
    near = set(rows(graph.knn_lsh(x, 3, radius=10.0, tables=12, width=4.0), "src", "dst"))
    assert len(exact & near) / len(exact) > 0.8


def test_propagation_keeps_seeds(spark):
    edges = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "run int, node bigint, label int")
    state = graph.propagate(edges, seeds, 7)
    assert {(n, lab): p for n, lab, p in rows(state, "node", "label", "p") if n < 2} == {(0, 1): 1.0, (1, 2): 1.0}
    p = dict(((lab), v) for n, lab, v in rows(state, "node", "label", "p") if n == 2)
    assert p[1] == pytest.approx(p[2]) and 0 < p[1] < 0.5
    zero = graph.label_softmax(state, 0.5, include_zero_class=True).groupBy("node").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    assert all(s == pytest.approx(1.0) for s, in rows(zero, "s"))


def blobs(spark, n_frames=12, labels=4):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 20, (labels, 6))
    data = [(t * labels + k, t, k, 0.5, (centres[k] + rng.normal(0, 0.3, 6)).tolist()) for t in range(n_frames) for k in range(labels)]
    return spark.createDataFrame(data, "linear_ind bigint, t int, raw_neuron_ind int, likelihood double, x array<double>")


@pytest.mark.parametrize("mode", ["global", "streaming", "overlapping_windows", "label_propagation"])
def test_tracker_finds_blobs(spark, mode):
    tracker = Tracker(blobs(spark), 12, cluster_size=0.7, neighbours=6, steps=3, seeds=5, window=6, fitted_frames=8)
    found = tracker.track(mode)
    cells = rows(found, "name", "t", "raw_neuron_ind")
    assert len({c[:2] for c in cells}) == len(cells)
    assert one_to_one({(n, k) for n, _, k in cells}) and len(cells) >= 4 * (12 - (mode == "overlapping_windows") * 2) * 0.7


def test_tracker_works_at_the_reference_parameters(spark):
    t = Tracker(blobs(spark), 12)
    assert (t.seeds, t.steps, t.window, t.fitted_frames, t.least_share, t.over_chance) == (100, 100, 120, 120, 0.1, 1.1)
    assert rows(t.track("overlapping_windows").agg(F.max("t")), "max(t)") == [(11,)]
    assert len(rows(t.track("streaming"), "name", "t")) >= 40


def test_seed_shares_equal_propagation(spark):
    points = fixtures.vectors(spark, SF).where("linear_ind < 120")
    edges = cut(graph.knn(points, 4))
    seeds = cut(graph.seed_labels(points, [0, 7]))
    want = {(r["run"], r["node"]): (r["label"], r["p"]) for r in graph.label_topk(graph.label_rownorm(graph.propagate(edges, seeds, 7, least=0.0).where("p > 0")), 1).collect()}
    # in one block of nodes, and in four with three labels a chunk
    for parts in ({}, {"node_block": 40, "label_chunk": 3}):
        got = {(r["run"], r["node"]): (r["label"], r["p"]) for r in graph.seed_shares(edges, seeds, 7, **parts).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1]) for k in want)
        assert sum(got[k][0] != want[k][0] for k in want) <= 2  # equals but for rounding


def test_a_seed_without_edges_keeps_its_label(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0, 1, 1), (0, 9, 2)], "run int, node bigint, label int")
    for parts in ({}, {"node_block": 1}):
        assert rows(graph.seed_shares(edges, seeds, 2, **parts)) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 9, 2, 1.0)]
    assert rows(graph.seed_shares(edges.where("false"), seeds, 2)) == [(0, 1, 1, 1.0), (0, 9, 2, 1.0)]


def test_neighbours_of_neighbours(spark):
    """Nearly the exact neighbours in every block of points; distances are exact, a point is its own first."""
    points = fixtures.vectors(spark, SF).select("linear_ind", "x")
    exact, found = (f(points, 8).collect() for f in (graph.knn, graph.knn_descent))
    of = {(r["src"], r["dst"]): r["dist"] for r in exact}
    hits = [r for r in found if (r["src"], r["dst"]) in of]
    assert all(r["dist"] == pytest.approx(of[r["src"], r["dst"]]) for r in hits) and all(r["src"] == r["dst"] for r in found if r["rk"] == 1)
    for block in range(5):
        wanted = sum(s % 5 == block for s, _ in of)
        assert sum(r["src"] % 5 == block for r in hits) >= 0.9 * wanted
    assert len(found) == len({(r["src"], r["rk"]) for r in found}) == 8 * points.count()
    few = points.where("linear_ind < 4")
    assert {(r["src"], r["dst"]) for r in graph.knn_descent(few, 8).collect()} == {(a, b) for a in range(4) for b in range(4)}
    assert graph.knn_descent(points.where("false"), 3).count() == 0


def test_labels_spread_along_a_long_chain(spark):
    """A point 30 steps from the seeds takes their label at 100 steps, and has none at 10."""
    x = [(0, 0, 0, 0.5, [0.0]), (1, 0, 1, 0.5, [1000.0])] + [(i + 1, i, 0, 0.5, [float(i)]) for i in range(1, 31)]
    points = spark.createDataFrame(x, "linear_ind bigint, t int, raw_neuron_ind int, likelihood double, x array<double>")
    seeds = graph.seed_labels(points, [0])
    edges = graph.knn(points, 3)
    assert graph.seed_shares(edges, seeds, 10).where("node = 31").count() == 0
    assert rows(graph.seed_shares(edges, seeds, 100).where("node = 31"), "label", "p") == [(1, 1.0)]


def correlation(a, b):
    """Of the columns of a with those of b."""
    z = [(v - v.mean(0)) / v.std(0, ddof=1) for v in (a, b)]
    return z[0].T @ z[1] / len(a)


def vectors_of(spark):
    got = fixtures.vectors(spark, SF).orderBy("linear_ind").collect()
    return np.array([r["linear_ind"] for r in got]), np.array([r["t"] for r in got]), np.array([r["x"] for r in got])


def test_object_correlation_of_every_frame(spark):
    ids, t, x = vectors_of(spark)
    got = {(r["t"], r["i"], r["j"]): r["c"] for r in catalogue.queries()["cross_corr_objects"](spark, SF).collect()}
    assert len(got) == sum((t == f).sum() ** 2 for f in set(t)) and {k[0] for k in got} == set(t)
    for f in (0, 7, int(t.max())):
        own, c = ids[t == f], correlation(x[t == f].T, x[t == f][:, ::-1].T)
        assert all(got[f, i, j] == pytest.approx(c[a, b], abs=2e-6) for a, i in enumerate(own) for b, j in enumerate(own))


def test_features_and_losses_of_whole_vectors(spark):
    _, t, x = vectors_of(spark)
    size = x.shape[1]
    c = correlation(x, x[:, ::-1])
    got = {(r["i"], r["j"]): r["c"] for r in catalogue.queries()["cross_corr_features"](spark, SF).collect()}
    assert len(got) == size**2 and all(got[i + 1, j + 1] == pytest.approx(c[i, j], abs=2e-6) for i in range(size) for j in range(size))

    def loss(cells):
        return np.mean([((m - 1) ** 2 * np.eye(len(m)) + corr.LAMBDA * m**2 * (1 - np.eye(len(m)))).sum() for m in cells]) / len(cells[0]) ** 2

    objects = [correlation(x[t == f].T, x[t == f][:, ::-1].T) for f in sorted(set(t))]
    r = catalogue.queries()["barlow_loss"](spark, SF).first()
    assert (r["loss_feat"], r["loss_obj"]) == (pytest.approx(loss([c]), abs=2e-6), pytest.approx(loss(objects), abs=2e-6))


def test_rescale_of_whole_stacks(spark):
    ids, t, x = vectors_of(spark)
    want = np.empty_like(x)
    for f in set(t):
        low, high = np.percentile(x[t == f], 5), x[t == f].max()
        want[t == f] = (np.maximum(x[t == f], low) - low) / (high - low)
    got = rows(catalogue.queries()["rescale_intensity"](spark, SF), "linear_ind", "pos", "val")
    assert [g[:2] for g in got] == [(i, p) for i in ids for p in range(x.shape[1])]
    assert np.allclose([g[2] for g in got], want.ravel(), atol=2e-6)


def test_nearest_of_equal_points_and_ties():
    rng = np.random.default_rng(0)
    b = np.vstack([rng.normal(size=(300, 8)), np.ones((40, 8))])
    a, ids = np.vstack([b[:50], np.ones((5, 8))]), rng.permutation(340) * 3
    order = np.argsort(ids)
    dist, found = graph.nearest_in_block(a, b[order], ids[order], 7)
    for r in range(len(a)):
        d = np.sqrt(((b - a[r]) ** 2).sum(1))
        want = np.lexsort((ids, d))[:7]
        assert found[r].tolist() == ids[want].tolist() and np.allclose(dist[r], d[want])
    assert graph.nearest_in_block(a, b[:3], ids[:3], 7)[0].shape == (55, 3)


def test_nearest_in_blocks_of_a_frame(spark, monkeypatch):
    det = fixtures.det(spark, SF).withColumn("t", F.lit(0))
    want = rows(evaluate.nearest_distance(det), "linear_ind", "dist")
    monkeypatch.setattr(evaluate, "FRAME_BLOCK", 16)
    assert rows(evaluate.nearest_distance(det), "linear_ind", "dist") == want
    p = np.array(rows(det, "linear_ind", "z", "x", "y"))
    gaps = np.sqrt(((p[:, None, 1:] - p[None, :, 1:]) ** 2).sum(2)) + np.where(np.eye(len(p)), np.inf, 0)
    assert np.allclose([d for _, d in want], gaps.min(1))


def test_predicting_from_a_fit(spark):
    """Points in a blob take its label, points between blobs hardly, and those farther than blobs are from each other are noise."""
    points = blobs(spark)
    model = cut(cluster.fitted(points, 5, 2).join(points, "linear_ind"))
    assert model.where("label < 0").count() < 5
    centres = {r["label"]: np.mean(r["xs"], axis=0) for r in model.where("label >= 0").groupBy("label").agg(F.collect_list("x").alias("xs")).collect()}
    far = [(900 + k, c.tolist()) for k, c in sorted(centres.items())] + [(990, (centres[0] / 2 + centres[1] / 2).tolist()), (991, [500.0] * 6)]
    got = {r["linear_ind"]: r for r in cluster.approximate_predict(spark.createDataFrame(far, "linear_ind bigint, x array<double>"), model, 2).collect()}
    assert all(got[900 + k]["label"] == k and got[900 + k]["prob"] > 0.5 for k in centres)
    assert got[990]["prob"] < 0.1 and (got[991]["label"], got[991]["prob"]) == (-1, 0.0)


def test_names_of_windows(spark):
    """Tracks keep their name along a chain through the base, the window of most tracks; others get new ones."""
    cells = [(0, 0, 1), (0, 0, 2), (0, 1, 3), (2, 0, 2), (2, 1, 3), (2, 2, 4), (4, 5, 4), (4, 6, 9), (6, 0, 9), (6, 1, 77)]
    names = window_names(spark.createDataFrame(cells, "start int, label int, linear_ind bigint"))
    assert rows(names, "start", "label", "name") == [(0, 0, 1), (0, 1, 2), (2, 0, 1), (2, 1, 2), (2, 2, 3), (4, 5, 3), (4, 6, 4), (6, 0, 4), (6, 1, 5)]


def test_svd_of_many_batches_and_its_bound(spark, monkeypatch):
    x = fixtures.vectors(spark, SF).repartition(7)
    a = np.array([r["x"] for r in x.orderBy("linear_ind").collect()])
    e = np.array([r["embedding"] for r in corr.svd_embed(x, 10).orderBy("linear_ind").collect()])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.abs(e), np.abs(u[:, :10] * s[:10]), atol=1e-8)
    monkeypatch.setattr(corr, "MOST_DIMENSIONS", 10)
    with pytest.raises(ValueError):
        corr.svd_embed(x, 3)


def test_clone_and_yaml(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    for name, n in (("tracks", 3), ("trials", 4)):
        one.write(name, spark.range(n))
    two.write("trials", spark.range(9))
    assert clone(one, two, ["tracks", "trials", "none"]) == ["tracks"]
    assert two.read("tracks").count() == 3 and two.read("trials").count() == 9
    (tmp_path / "c.yaml").write_text('# top\nname: "a: b"\nlist:\n  - 1\nnest:\n  name: x\nsteps: 5 # five\nsteps: 6\nempty:\npath: /a#b\n')
    assert configs.read_yaml(spark, str(tmp_path / "c.yaml")).first()["config"] == {"name": "a: b", "list.0": "1", "nest.name": "x", "steps": "6", "empty": None, "path": "/a#b"}
    (tmp_path / "d.yaml").write_text("- only a list\n")
    (tmp_path / "e.yaml").write_text("")
    assert configs.read_yaml(spark, str(tmp_path / "d.yaml")).first()["config"] == {"0": "only a list"}
    assert configs.read_yaml(spark, str(tmp_path / "e.yaml")).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        Tracker(blobs(spark), 12).track("other")


def test_agglomerate_is_disjoint_and_one_per_frame(spark):
    points = blobs(spark)
    tree = cluster.condensed_tree(points, 4, 2)
    found = cluster.agglomerate(tree, points.withColumn("score", F.col("likelihood"))).join(points.select("linear_ind", "t", "raw_neuron_ind"), "linear_ind")
    kept = found.where("kept")
    assert kept.groupBy("linear_ind").count().where("count > 1").count() == 0
    assert kept.groupBy("cluster", "t").count().where("count > 1").count() == 0
    assert one_to_one(set(rows(kept, "cluster", "raw_neuron_ind"))) and kept.count() > 40
    rated = cluster.node_goodness(tree, points)
    assert rated.where("goodness > 1 or purity > 1").count() == 0 and rated.count() > 0


def test_agglomeration_starts_from_a_fit(spark):
    points = blobs(spark)
    tree = cut(cluster.condensed_tree(points, 4, 2))
    fit = cluster.hdbscan_labels(points, 4, 2).select("linear_ind", "label")
    scored = points.withColumn("score", F.col("likelihood")).join(fit, "linear_ind")
    found = cluster.agglomerate(tree, scored).join(scored.select("linear_ind", "t", "label", "raw_neuron_ind"), "linear_ind")
    kept = found.where("kept")
    assert kept.groupBy("linear_ind").count().where("count > 1").count() == 0
    assert one_to_one(set(rows(kept, "cluster", "raw_neuron_ind"))) and kept.count() >= 40
    # with nothing better above, a fitted cluster is taken as it is, whole
    whole = found.where("label > 0").groupBy("cluster").agg(F.collect_set("linear_ind").alias("m")).collect()
    members = {r["label"]: set(r["m"]) for r in scored.where("label > 0").groupBy("label").agg(F.collect_set("linear_ind").alias("m")).collect()}
    assert any(set(r["m"]) == m for r in whole for m in members.values())
    impure = scored.withColumn("label", F.lit(1))  # one cluster of everything is no start
    assert rows(cluster.agglomerate(tree, impure)) == rows(cluster.agglomerate(tree, scored.drop("label")))


def test_svd_keeps_products(spark):
    x = fixtures.vectors(spark, SF).where("linear_ind < 60").withColumn("x", F.slice("x", 1, 5))
    a = np.array([r["x"] for r in x.orderBy("linear_ind").collect()])
    e = np.array([r["embedding"] for r in corr.svd_embed(x, 5).orderBy("linear_ind").collect()])
    assert np.allclose(a @ a.T, e @ e.T)


def test_trials(spark, tmp_path):
    paths = spark.createDataFrame([("a/trial_3/x",), ("a/my_trial_4",), ("none",), ("b/trial_3",)], "path string")
    assert rows(trials.discover(paths), "trial") == [(3,), (4,)]
    assert rows(trials.discover(paths, anchored=True), "trial") == [(3,)]
    nan = spark.createDataFrame([(1, float("nan")), (2, None), (3, 2e6)], "trial int, val_loss double")
    assert rows(trials.best_trial(nan), "trial", "val_loss") == [(1, 1e6)]
    written = spark.createDataFrame([(1, 1, 1, None, 0.5), (1, 0, 0, 1.0, None), (2, 0, 0, 3.0, None)], "trial int, pos int, epoch int, loss double, val_loss double")
    configs.write_stats(written, str(tmp_path / "stats"))
    stats = configs.read_stats(spark, str(tmp_path / "stats"))
    assert rows(stats, "trial", "pos", "epoch", "loss", "val_loss") == rows(written, "trial", "pos", "epoch", "loss", "val_loss")
    assert rows(trials.second_last(stats, "loss"), "trial", "val_loss") == [(1, 1.0), (2, None)]
    assert spark.range(1).select(trials.learning_rate(F.lit(0), 10, 20, 1.0)).first()[0] == 0.0
    assert trials.repeated(nan.select("trial"), 3).count() == 9


def test_config_maps(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS base, map('b', '3') AS own")
    got = df.select(configs.merged(F.col("base"), F.col("own")).alias("m")).first()["m"]
    assert got == {"a": "1", "b": "3"}
    assert df.select(*configs.known_keys(F.col("own"), ["b", "c"])).first() == ("3", None)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(0, 1.0), (1, float("nan"))], "t int, v double")

    assert not c.exists("s")
    assert c.stage("s", make).count() == c.stage("s", make).count() == 2 and len(made) == 1
    assert rows(null_for_missing(c.read("s")).where("v is null"), "t") == [(1,)]
    c.write("f", c.read("s"), by_frame=True)
    assert c.read("f", frame=1).count() == 1
    e = c.write_embeddings(spark.range(5).select(F.col("id").alias("linear_ind"), F.array(F.col("id").cast("float")).alias("embedding")))
    assert e.count() == 5


def test_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming import tracks

    points = blobs(spark)
    fitted = points.where("t < 6").select("linear_ind", "x", F.col("raw_neuron_ind").alias("label"))
    points.where("t >= 6").repartition(3).write.parquet(str(tmp_path / "in"))
    q = tracks.assign_labels(tracks.detections(spark, str(tmp_path / "in")), fitted, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 24 and got.where("label <> raw_neuron_ind").count() == 0
    assert tracks.best_so_far(got).count() == 24


def test_empty_tables(spark):
    det = spark.createDataFrame([], DET)
    assert evaluate.nearest_distance(det).count() == 0 and frames.linear_index(det).count() == 0
    assert crops.crop_bounds(det, (4, 4, 4), (2, 2, 2)).count() == 0
    assert assign.time_purity(det.select(F.col("gt_label").alias("cand"), "t")).count() == 0
    assert sync.spectral_sync(spark.createDataFrame([], "run int, linear_ind bigint, t int, label int, prob double"), det).count() == 0
