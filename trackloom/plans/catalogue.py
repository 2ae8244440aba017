"""The tracking queries: each operator over the fixture tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.rounding import r6
from trackloom.operators import assign, cluster, corr, crops, density, evaluate, frames, graph, layout, sync, trials
from trackloom.operators.checkpoints import cut, ensure_checkpoint_dir
from trackloom.plans import oracle
from trackloom.plans.tracker import Tracker
from trackloom.sources import configs, tables
from trackloom.sources import fixtures as fx
from trackloom.streaming import tracks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHAPE, TARGET = (16, 128, 128), (8, 64, 64)
WINDOW, STRIDE, SAMPLED = 20, 10, 12
SEED_FRAMES, TEMPLATE_FRAMES = [0, 3, 6], [1, 2, 4, 7, 8]
#: Buckets of stages by frame; a large project takes about one for each 128 MB of its largest stage.
STAGE_BUCKETS = 8
#: Documents of a file of configurations, which a task reads whole.
YAML_DOCUMENTS = 1000
GRID = {"lr": [0.1, 0.01], "dim": [32, 64], "z": [4, 8]}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()


def _aligned(spark, d):
    return evaluate.align(fx.gt(spark, d), fx.pred(spark, d), fx.mapping(spark, d))


def _labelled(spark, d):
    return fx.det(spark, d).withColumnRenamed("gt_label", "label")


def _candidates(spark, d):
    return fx.det(spark, d).select(F.col("gt_label").alias("cand"), "t", "linear_ind", (F.col("linear_ind") % 5 == 0).alias("assigned"), F.col("likelihood").alias("score"))


def _unrotated(spark, d):
    return fx.labelings(spark, d).withColumn("label", fx.unrotated(F.col("label"), F.col("run")))


def _noisy_vectors(spark, d):
    label = F.when(F.col("linear_ind") % 9 == 0, -1).otherwise(F.col("gt_label")).cast("int")
    return fx.vectors(spark, d).join(fx.det(spark, d).select("linear_ind", label.alias("label")), "linear_ind")


def _entries(spark, d):
    return assign.greedy_top1(fx.labelings(spark, d)).select("run", "linear_ind", "label", F.col("prob").alias("val"))


def _perms(spark, d):
    return fx.labelings(spark, d).select("run", "label").distinct().withColumn("mapped", fx.unrotated(F.col("label"), F.col("run")))


def _state(spark, d, steps):
    seeds = graph.seed_labels(fx.det(spark, d), SEED_FRAMES)
    return graph.propagate(graph.knn(fx.vectors(spark, d), 10), seeds, steps)


# evaluate


@query
def align_reindex(spark, d):
    return _aligned(spark, d)


@query
def track_contingency(spark, d):
    return evaluate.contingency(fx.gt(spark, d), fx.pred(spark, d))


@query
def match_tracks(spark, d):
    return evaluate.match_tracks(fx.gt(spark, d), fx.pred(spark, d))


@query
def match_on_frames(spark, d):
    return evaluate.match_on_frames(fx.gt(spark, d), fx.pred(spark, d), TEMPLATE_FRAMES)


@query
def finished_only(spark, d):
    """Even names are finished in the first half of the rows; in the other none is, so all stay."""
    gt = fx.gt(spark, d).select("name", "t")
    some = gt.where("name % 2 = 0").select("name").distinct()
    halves = [evaluate.finished_only(gt, f).withColumn("finished", F.lit(k)) for k, f in ((True, some), (False, some.where("false")))]
    return halves[0].unionByName(halves[1])


@query
def rename_by(spark, d):
    back = fx.mapping(spark, d).select(F.col("pred_name").alias("old"), F.when(F.col("gt_name") > 2, F.col("gt_name")).alias("new"))
    return evaluate.rename_by(fx.pred(spark, d).select("name", "t", "raw_seg_id"), back)


@query
def class_embeddings(spark, d):
    found = evaluate.class_embeddings(_noisy_vectors(spark, d))
    return found.select("label", "place", "linear_ind", F.posexplode("x").alias("i", "v")).withColumn("v", r6("v"))


@query
def combine_first(spark, d):
    return evaluate.combine_first(fx.pred(spark, d), fx.gt(spark, d))


@query
def mode_vote(spark, d):
    return evaluate.mode_vote(_unrotated(spark, d))


@query
def enrich_tracks(spark, d):
    return evaluate.enrich(fx.pred(spark, d), fx.det(spark, d)).select("name", "t", "raw_neuron_ind", *[r6(c).alias(c) for c in "zxy"])


def _rated(df):
    return df.withColumn("accuracy", r6("accuracy"))


@query
def accuracy_total(spark, d):
    return _rated(evaluate.accuracy(_aligned(spark, d)))


@query
def accuracy_per_neuron(spark, d):
    return _rated(evaluate.accuracy(_aligned(spark, d), "name"))


@query
def accuracy_per_timepoint(spark, d):
    return _rated(evaluate.accuracy(_aligned(spark, d), "t"))


@query
def accuracy_grouping_sets(spark, d):
    return evaluate.accuracy_grouping_sets(_aligned(spark, d))


@query
def accuracy_cells(spark, d):
    return evaluate.accuracy_cells(_aligned(spark, d))


def _metrics(spark, d):
    return evaluate.track_metrics(frames.with_frame_count(_aligned(spark, d), fx.det(spark, d)), F.col("n_frames"))


@query
def track_metrics(spark, d):
    return _metrics(spark, d).withColumns({c: r6(c) for c in ("frac_gaps", "pct_tracked", "accuracy", "frac_mistakes")})


def _metrics_no_gt(spark, d):
    return evaluate.track_metrics_no_truth(frames.with_frame_count(fx.pred(spark, d), fx.det(spark, d)), F.col("n_frames"))


@query
def track_metrics_no_gt(spark, d):
    return _metrics_no_gt(spark, d).withColumns({c: r6(c) for c in ("frac_gaps", "pct_tracked")})


@query
def trace_correlation(spark, d):
    mean_z = fx.det(spark, d).groupBy("t").agg(F.avg("z").alias("b"))
    traces = fx.gt(spark, d).select("name", "t", F.col("likelihood").alias("a")).join(mean_z, "t")
    return evaluate.trace_correlation(traces).withColumn("correlation", r6("correlation"))


@query
def coverage_histogram(spark, d):
    found = evaluate.log_histogram(_metrics_no_gt(spark, d).select(F.col("pct_tracked").alias("v")), 10.0, 100.0)
    return found.withColumns({c: r6(c) for c in ("lo", "hi", "pct")})


@query
def trend_fit(spark, d):
    points = _metrics(spark, d).select(F.col("pct_tracked").alias("x"), F.col("accuracy").alias("y"))
    return evaluate.trend(points).select(*[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


@query
def accuracy_macro_micro(spark, d):
    return evaluate.macro_micro(_aligned(spark, d)).select(r6("macro").alias("macro"), r6("micro").alias("micro"))


@query
def confidence_by_correct(spark, d):
    cells = evaluate.accuracy_cells(_aligned(spark, d)).join(fx.gt(spark, d).select("name", "t", F.col("likelihood").alias("conf")), ["name", "t"])
    return evaluate.confidence_by_correct(cells).withColumn("conf", r6("conf"))


@query
def displacement(spark, d):
    padded = frames.pad_frames(fx.gt(spark, d), fx.det(spark, d))
    return evaluate.displacement(padded).withColumn("dist", r6("dist"))


@query
def nn_distance_all(spark, d):
    return evaluate.nearest_distance(fx.det(spark, d)).withColumn("dist", r6("dist"))


@query
def nn_distance_mean(spark, d):
    return evaluate.nearest_distance_mean(fx.det(spark, d)).withColumn("mean_dist", r6("mean_dist"))


@query
def adjacent_tracking_accuracy(spark, d):
    return evaluate.adjacent_accuracy(fx.gt(spark, d), fx.det(spark, d))


@query
def carried_index(spark, d):
    return evaluate.carried_index(frames.pad_frames(fx.gt(spark, d), fx.det(spark, d)))


@query
def template_match(spark, d):
    rows = fx.vectors(spark, d).join(fx.det(spark, d).select("linear_ind", F.col("gt_label").alias("label")), "linear_ind")
    return evaluate.template_match(rows.where("t > 0"), rows.where("t = 0")).withColumn("conf", r6("conf"))


@query
def common_neurons(spark, d):
    return evaluate.common_names(fx.gt(spark, d), fx.pred(spark, d))


# frames


@query
def pad_frames(spark, d):
    return frames.pad_frames(fx.pred(spark, d).select("name", "t", "raw_seg_id"), fx.det(spark, d))


@query
def frame_size_filter(spark, d):
    return frames.frames_within(fx.gt(spark, d))


@query
def pad_rows(spark, d):
    every = fx.gt(spark, d).groupBy("t").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return frames.pad_rows(every, frames.frame_count(fx.det(spark, d)).first()[0] + 7)


@query
def drop_last_frame(spark, d):
    return frames.drop_last_frame(fx.gt(spark, d).select("name", "t"), fx.det(spark, d))


@query
def valid_sample(spark, d):
    return frames.valid_sample(fx.gt(spark, d), 6, [(F.col("t") * 7919) % 1009, F.col("t")], least=5)


@query
def base_window(spark, d):
    return frames.base_window(frames.overlapping_windows(fx.gt(spark, d), 4, 2), "name")


@query
def overlapping_windows(spark, d):
    dealt = frames.overlapping_windows(fx.det(spark, d), WINDOW, STRIDE)
    return dealt.groupBy("start", "t").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query
def global_frames(spark, d):
    return frames.evenly_spaced(fx.det(spark, d), SAMPLED)


@query
def nonglobal_frames(spark, d):
    det = fx.det(spark, d)
    return frames.other_frames(det, frames.evenly_spaced(det, SAMPLED))


@query
def linear_index(spark, d):
    return frames.linear_index(fx.det(spark, d))


@query
def frames_by_size(spark, d):
    return frames.frames_by_size(fx.gt(spark, d))


@query
def train_val_test_split(spark, d):
    every = fx.det(spark, d).select("t").distinct()
    return frames.train_val_test_split(every, [(F.col("t") * 7919) % 1009, F.col("t")], 0.8, 0.1)


# crops


@query
def crop_bounds(spark, d):
    return crops.crop_bounds(fx.det(spark, d), SHAPE, TARGET)


@query
def crop_bounds_bbox(spark, d):
    boxes = fx.det(spark, d).select("linear_ind", *[(F.col(a) + s).alias(f"b{a}{i}") for i, s in ((0, -1.3), (1, 1.3)) for a in "zxy"])
    return crops.crop_bounds_bbox(boxes, SHAPE, TARGET)


def _names(spark, d):
    return crops.detection_names(fx.det(spark, d), fx.gt(spark, d))


@query
def detection_names(spark, d):
    return _names(spark, d)


@query
def tracked_names(spark, d):
    return crops.detection_names(fx.det(spark, d), fx.gt(spark, d), include_untracked=False)


@query
def crop_voxels(spark, d):
    """Crops of a small volume per frame, whose voxels count up, in chunks that divide no axis evenly but one."""
    shape, target, chunk = (4, 6, 5), (2, 4, 3), (2, 4, 2)
    small = fx.det(spark, d).select("linear_ind", "t", (F.col("z") / 4).alias("z"), (F.col("x") / 20).alias("x"), (F.col("y") / 25).alias("y"))
    bounds = crops.crop_bounds(small, shape, target).join(small.select("linear_ind", "t"), "linear_ind")
    volumes = small.select("t").distinct().withColumn("voxels", F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: (i + F.col("t") * 1000 + 1).cast("float")))
    found = crops.crop_voxels(bounds, crops.chunked(volumes, shape, chunk), shape, chunk, target)
    return found.select("linear_ind", F.posexplode("voxels").alias("pos", "v")).select("linear_ind", "pos", F.col("v").cast("double").alias("v"))


@query
def names_by_segment(spark, d):
    return crops.names_by_segment(fx.pred(spark, d), fx.det(spark, d))


@query
def raw_index(spark, d):
    det = fx.det(spark, d)
    first = det.where("linear_ind % 3 = 0").select("linear_ind", (F.col("raw_neuron_ind") + 100).alias("raw_neuron_ind"))
    return crops.raw_index(det, first, det.where("linear_ind % 5 <> 0"))


@query
def parse_untracked_name(spark, d):
    return crops.parse_untracked_name(_names(spark, d))


@query
def pivot_frame(spark, d):
    wide = crops.pivot_frame(fx.det(spark, d), 0, list(range(1, 11)))
    return wide.select("t", *[r6(c).alias(c) for c in wide.columns[1:]])


@query
def rescale_intensity(spark, d):
    """A frame's vectors as one stack."""
    return crops.rescale_intensity(fx.vectors(spark, d).select("t", "linear_ind", F.col("x").alias("vals")), by="t").withColumn("val", r6("val"))


# assign


@query
def cluster_to_tracks(spark, d):
    return assign.best_per_cell(_labelled(spark, d)).withColumn("likelihood", r6("likelihood"))


@query
def cluster_to_tracks_last(spark, d):
    return assign.last_per_cell(_labelled(spark, d))


@query
def cluster_to_tracks_first(spark, d):
    return assign.first_per_cell(_labelled(spark, d))


@query
def time_purity(spark, d):
    return assign.time_purity(_candidates(spark, d)).select(F.col("cand").alias("gt_label"), "kept", "total", r6("purity").alias("purity"))


@query
def time_purity_kept(spark, d):
    return assign.time_purity_kept(_candidates(spark, d)).select(F.col("cand").alias("gt_label"), "t", "linear_ind")


@query
def cluster_goodness(spark, d):
    rated = frames.with_frame_count(assign.time_purity(_candidates(spark, d)), fx.det(spark, d))
    return rated.select(F.col("cand").alias("gt_label"), r6(assign.goodness(F.col("purity"), F.col("kept") / F.col("n_frames"))).alias("goodness"))


@query
def greedy_top1(spark, d):
    return assign.greedy_top1(fx.labelings(spark, d)).select("run", "t", "label", "linear_ind")


@query
def unassigned_points(spark, d):
    return assign.unassigned_points(fx.det(spark, d), assign.time_purity_kept(_candidates(spark, d)))


@query
def outlier_points(spark, d):
    c = _candidates(spark, d)
    return assign.outlier_points(c, assign.time_purity_kept(c)).withColumnRenamed("cand", "gt_label")


@query
def neither(spark, d):
    c = _candidates(spark, d)
    kept = assign.time_purity_kept(c)
    return assign.neither(fx.det(spark, d), kept, assign.outlier_points(c, kept).where("cand % 2 = 0"))


@query
def without_noise(spark, d):
    return assign.without_noise(_noisy_vectors(spark, d)).select("linear_ind", "label")


@query
def thresholded(spark, d):
    return assign.thresholded(fx.labelings(spark, d), 0.75).select("run", "linear_ind", "label", r6("prob").alias("prob"))


@query
def seed_stats(spark, d):
    seeds = fx.det(spark, d).select("t", (F.col("linear_ind") % 5 == 0).alias("assigned"), (F.col("gt_label") - 1).alias("label"))
    return assign.seed_stats(seeds, "t")


# trials


@query
def stats_second_last(spark, d):
    return trials.second_last(fx.stats(spark, d)).withColumn("val_loss", r6("val_loss"))


@query
def discover_trials(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("runs/trial_"), F.col("user_id").cast("string"), F.lit("/log")).alias("path"))
    return trials.discover(users)


@query
def discover_anchored(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 2).alias("odd"), F.col("user_id").cast("string").alias("u"))
    return trials.discover(users.select(F.concat(F.when(F.col("odd") == 1, "runs/trial_").otherwise("trial_9/old_trial_"), F.col("u")).alias("path")), anchored=True)


@query
def read_stats(spark, d):
    """Written as training writes logs, one JSON text per trial, and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/stats-{uuid.uuid4().hex}"
    configs.write_stats(fx.stats(spark, d), path)
    return configs.read_stats(spark, path).select("trial", "pos", r6("loss").alias("loss"))


def _configs(spark, d):
    k = F.max(F.from_json("props", "k bigint")["k"]).cast("string")
    held = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("trial")).agg(k.alias("k"))
    path = F.concat(F.lit("/old/run"), F.col("trial").cast("string"))
    return held.select("trial", F.create_map(F.lit("k"), "k", F.lit("folder"), path).alias("config"))


@query
def config_merge(spark, d):
    base = F.create_map(F.lit("k"), F.lit("0"), F.lit("lr"), F.lit("0.1"))
    return _configs(spark, d).select("trial", *configs.known_keys(configs.merged(base, F.col("config")), ["k", "lr", "dim"]))


@query
def config_changes(spark, d):
    """What a bulk rewrite and a move of folders would change."""
    before = _configs(spark, d)
    updates = F.create_map(F.lit("k"), F.lit("7"), F.lit("new"), F.lit("x"))
    return configs.changes(before, "config", configs.moved(configs.rewritten(F.col("config"), updates), "/old/", "/new/"), "trial")


def _yaml_folder(spark, d):
    """Configurations with blocks, lists, quotes and comments: a document for each trial, YAML_DOCUMENTS in a file at most."""
    path = f"{ensure_checkpoint_dir(spark)}/yaml-{uuid.uuid4().hex}"
    lines = ["---", "# run", "lr: 0.5", F.concat(F.lit("k: '"), F.col("config")["k"], F.lit("'  # of the run")), "nest:", "  k: 3", "  deep: {a: 1, b: [x, y]}", "sizes:", "- 1", "- 2", "lr: 0.25", F.concat(F.lit("folder: "), F.col("config")["folder"])]
    text = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    _configs(spark, d).select(text.alias("value")).write.option("maxRecordsPerFile", YAML_DOCUMENTS).text(path)
    return path


@query
def read_yaml(spark, d):
    held = configs.read_yaml(spark, _yaml_folder(spark, d))
    return held.select(*configs.known_keys(F.col("config"), ["folder", "k", "lr", "nest"]), *[F.try_element_at("config", F.lit(k)).alias(n) for k, n in (("nest.k", "nest_k"), ("nest.deep.b.1", "b"), ("sizes.1", "size"))])


@query
def rewrite_yaml(spark, d):
    """Overrides below the top level merged into every file, written, read again and listed by key."""
    path = _yaml_folder(spark, d)
    override = F.create_map(*map(F.lit, ("nest.deep.b.0", "z", "nest.new", "1", "lr", "7")))
    configs.rewrite_yaml(spark, path, f"{path}-after", override, dry_run=False).collect()
    return configs.read_yaml(spark, f"{path}-after").select(F.explode("config").alias("name", "value")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def repeated_trials(spark, d):
    return trials.repeated(_trials(spark, d), 3)


@query
def trial_accuracy(spark, d):
    """The summary with the accuracy of the trials that tracks exist for: those numbered as a name."""
    config = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("trial")).agg(F.max(F.from_json("props", "k bigint")["k"]).alias("k"))
    found = evaluate.accuracy(_aligned(spark, d), "name").select(F.col("name").cast("bigint").alias("trial"), "accuracy")
    return trials.summary(fx.stats(spark, d), config, found).withColumns({c: r6(c) for c in ("val_loss", "accuracy")})


@query
def training_finished(spark, d):
    return trials.training_finished(fx.stats(spark, d), 69)


def _trials(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("trial")).distinct()


@query
def trial_project_join(spark, d):
    every = _trials(spark, d)
    projects = every.where("trial % 2 = 0").select(F.concat(F.lit("project_"), F.col("trial").cast("string")).alias("project"))
    return trials.join_projects(every, projects)


@query
def param_grid(spark, d):
    """The grid for every trial that is logged."""
    return _trials(spark, d).crossJoin(F.broadcast(trials.param_grid(spark, GRID)))  # a grid of a few values


@query
def one_at_a_time(spark, d):
    return _trials(spark, d).crossJoin(F.broadcast(trials.one_at_a_time(spark, GRID)))


@query
def loss_by_epoch(spark, d):
    return trials.loss_by_epoch(fx.stats(spark, d)).withColumn("loss", r6("loss"))


@query
def best_trial(spark, d):
    return trials.best_trial(trials.second_last(fx.stats(spark, d))).withColumn("val_loss", r6("val_loss"))


@query
def trial_summary(spark, d):
    config = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("trial")).agg(
        F.max(F.from_json("props", "k bigint")["k"]).alias("k")
    )
    return trials.summary(fx.stats(spark, d), config).withColumn("val_loss", r6("val_loss"))


@query
def lr_schedule(spark, d):
    """The rate at every logged record, twenty steps apart."""
    steps = fx.stats(spark, d).select("trial", "pos", (F.col("pos") * 20).alias("step"))
    return steps.select("trial", "pos", F.round(trials.learning_rate(F.col("step"), 400, 2000, 1 / 256), 9).alias("lr"))


@query
def split_model_name(spark, d):
    """Names of one to four parts, of every user and kind of event."""
    events = spark.read.parquet(f"{d}/events.parquet")
    user = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 3 == 0, user).when(F.col("user_id") % 3 == 1, F.concat_ws("_", F.lit("net"), user, "event_type")).otherwise(F.concat_ws("_", F.lit("a"), F.lit("b"), user, F.lit("lab")))
    return trials.split_model_name(events.select(name.alias("model")).where("model is not null").distinct())


# graph


@query
def knn_graph(spark, d):
    return graph.knn(fx.vectors(spark, d), 10).select("src", "dst", "rk")


def _recall(exact, found, least=0.9):
    """block, wanted, enough: of five blocks of points, their exact neighbours and whether `least` of them were found."""
    hits = found.select("src", "dst", F.lit(True).alias("hit"))
    rows = exact.join(hits, ["src", "dst"], "left").groupBy((F.col("src") % 5).alias("block"))
    return rows.agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= least * F.count(F.lit(1))).alias("enough"))


@query
def knn_lsh(spark, d):
    """The approximate search within a radius against the exact one."""
    points = fx.vectors(spark, d)
    exact = graph.knn(points, 5).where("dist <= 0.9").select("src", "dst")
    return _recall(exact, graph.knn_lsh(points, 5, 0.9, tables=12, width=1.0))


@query
def knn_descent(spark, d):
    """The search among neighbours' neighbours against the exact one."""
    points = fx.vectors(spark, d)
    return _recall(graph.knn(points, 10), graph.knn_descent(points, 10))


@query
def fuzzy_graph(spark, d):
    return layout.fuzzy_graph(graph.knn(fx.vectors(spark, d), 10)).select("src", "dst", r6("w").alias("w"))


@query
def seed_shares(spark, d):
    """The share of the likeliest label after three steps, by blocks of 128 nodes and 4 labels."""
    seeds = graph.seed_labels(fx.det(spark, d), SEED_FRAMES)
    found = graph.seed_shares(graph.knn(fx.vectors(spark, d), 10), seeds, 3, node_block=128, label_chunk=4)
    return found.select("run", "node", r6("p").alias("p"))


@query
def labelings_of(spark, d):
    """Labels by softmax with the class of none, where they are sure enough."""
    state = _state(spark, d, 3).withColumn("p", F.round("p", 9))
    return graph.labelings_of(state, fx.det(spark, d), threshold=1.1 / 10).select("run", "linear_ind", "t", "label", r6("prob").alias("prob"))


@query
def node_goodness(spark, d):
    """Leaves of the tree are the detections, in order."""
    nodes = fx.tree(spark, d)
    n = fx.det(spark, d).agg(F.count(F.lit(1)).alias("n"))
    point = F.when(F.col("node") >= F.col("n") - 1, F.col("node") - F.col("n") + 1)
    tree = nodes.crossJoin(F.broadcast(n)).select("parent", F.col("node").alias("child"), point.cast("bigint").alias("point"))  # one row
    return cluster.node_goodness(tree, fx.det(spark, d)).withColumns({c: r6(c) for c in ("purity", "goodness")})


@query
def seed_labels(spark, d):
    return graph.seed_labels(fx.det(spark, d), SEED_FRAMES)


@query
def label_prop_step(spark, d):
    return _state(spark, d, 1).select("run", "node", "label", r6("p").alias("p"))


@query
def label_prop_3(spark, d):
    return _state(spark, d, 3).select("run", "node", "label", r6("p").alias("p"))


@query
def label_topk(spark, d):
    # rounded first, so that equal shares are equal in any order of summing
    state = _state(spark, d, 3).withColumn("p", F.round("p", 9))
    return graph.label_topk(state, 2).select("run", "node", "label", r6("p").alias("p"), "rk")


@query
def label_softmax(spark, d):
    return graph.label_softmax(_state(spark, d, 3), 0.02).select("run", "node", "label", r6("p").alias("p"))


@query
def label_rownorm(spark, d):
    return graph.label_rownorm(_state(spark, d, 3)).select("run", "node", "label", r6("p").alias("p"))


@query
def tree_closure(spark, d):
    return graph.tree_closure(fx.tree(spark, d))


@query
def tree_ancestors(spark, d):
    return graph.tree_ancestors(fx.tree(spark, d))


# sync


@query
def vote_counts(spark, d):
    return sync.vote_counts(_unrotated(spark, d))


@query
def label_confusion(spark, d):
    runs = fx.labelings(spark, d)
    return sync.label_confusion(runs.where("run = 0"), runs.where("run = 1"))


@query
def column_weights(spark, d):
    return sync.column_weights(_entries(spark, d)).withColumn("w", r6("w"))


@query
def row_normalize(spark, d):
    return sync.row_normalize(_entries(spark, d)).select("run", "linear_ind", "label", r6("val").alias("val"))


@query
def consensus_votes(spark, d):
    return sync.consensus_votes(_entries(spark, d), _perms(spark, d)).withColumn("votes", r6("votes"))


@query
def label_coverage_diag(spark, d):
    return sync.coverage_diagnostics(fx.det(spark, d), fx.labelings(spark, d)).withColumn("mean_n", r6("mean_n"))


@query
def unmatched_labels(spark, d):
    runs = fx.labelings(spark, d)
    new = runs.where("run = 1")
    return sync.unmatched_labels(new, sync.label_confusion(runs.where("run = 0 and label <= 5"), new), 3)


@query
def gram_matrix(spark, d):
    return sync.gram_matrix(sync.row_normalize(_entries(spark, d))).withColumn("g", r6("g"))


@query
def fuse_labels(spark, d):
    return sync.fuse_labels(_unrotated(spark, d), fx.RUNS)


def _votes_of_frames(fused):
    """The votes that each frame's assignment has; many assignments may have as many."""
    return fused.groupBy("t").agg(F.round(F.sum("confidence") * fx.RUNS).cast("bigint").alias("votes"))


@query
def fuse_labels_votes(spark, d):
    return _votes_of_frames(sync.fuse_labels(_unrotated(spark, d), fx.RUNS))


@query
def align_all_votes(spark, d):
    return _votes_of_frames(sync.align_all(fx.labelings(spark, d), list(range(fx.RUNS))))


@query
def align_pair(spark, d):
    runs = fx.labelings(spark, d)
    return sync.align_pair(runs.where("run = 0"), runs.where("run = 1")).withColumn("prob", r6("prob"))


@query
def align_all(spark, d):
    return sync.align_all(fx.labelings(spark, d), list(range(fx.RUNS)))


@query
def spectral_sync(spark, d):
    return sync.spectral_sync(fx.labelings(spark, d), fx.det(spark, d))


# corr


def _features(spark, d):
    return corr.cross_corr(fx.vectors(spark, d).select(F.col("x").alias("a"), F.reverse("x").alias("b")))


def _objects(spark, d):
    views = fx.vectors(spark, d).select("t", "linear_ind", F.col("x").alias("a"), F.reverse("x").alias("b"))
    return corr.cross_corr_objects(views, by=("t",))


@query
def cross_corr_features(spark, d):
    return _features(spark, d).withColumn("c", r6("c"))


@query
def cross_corr_objects(spark, d):
    return _objects(spark, d).withColumn("c", r6("c"))


@query
def barlow_loss(spark, d):
    """Over all dimensions and over all cells of every frame's objects."""
    return corr.barlow_loss(_features(spark, d), _objects(spark, d)).select(*[r6(c).alias(c) for c in ("loss_feat", "loss_obj", "loss")])


@query
def feature_gram(spark, d):
    return corr.feature_gram(fx.vectors(spark, d)).withColumn("g", r6("g"))


@query
def svd_embed(spark, d):
    return corr.svd_embed(fx.vectors(spark, d), 10)


@query
def svd_products(spark, d):
    """Products of a frame's embeddings of all dimensions: those of the vectors themselves."""
    points = fx.vectors(spark, d)
    held = corr.svd_embed(points, 64).join(points.select("linear_ind", "t"), "linear_ind")
    i, j = held.select("t", F.col("linear_ind").alias("i"), F.col("embedding").alias("a")), held.select("t", F.col("linear_ind").alias("j"), F.col("embedding").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return i.join(j, "t").where("i <= j").select("i", "j", r6(product).alias("p"))


# cluster


def _knn5(spark, d):
    return cut(graph.knn(fx.vectors(spark, d), 5))


@query
def core_distance(spark, d):
    return cluster.core_distance(_knn5(spark, d), 5).withColumn("core", r6("core"))


@query
def mutual_reachability(spark, d):
    near = _knn5(spark, d)
    return cluster.mutual_reachability(near, cluster.core_distance(near, 5)).withColumn("mr", r6("mr"))


@query
def nn_label_assign(spark, d):
    rows = fx.vectors(spark, d).join(fx.det(spark, d).select("linear_ind", F.col("gt_label").alias("label")), "linear_ind")
    chosen = frames.evenly_spaced(fx.det(spark, d), SAMPLED)
    return cluster.nn_label_assign(rows.join(chosen, "t", "left_anti"), rows.join(chosen, "t", "left_semi"))


def _fitted_some(spark, d):
    chosen = frames.evenly_spaced(fx.det(spark, d), SAMPLED)
    points = _noisy_vectors(spark, d)
    some = points.join(chosen, "t", "left_semi")
    core = cluster.core_distance(graph.knn(some, 3), 3)
    model = cut(some.join(core, "linear_ind").withColumns({"birth": 1.0 + F.col("label") / 50, "top": 2.0 + F.col("label") / 10}))
    return model, points.join(chosen, "t", "left_anti")


@query
def approximate_predict(spark, d):
    """Fitted points of the sampled frames, with clusters that begin and end at densities of their own; the other frames' points."""
    model, rest = _fitted_some(spark, d)
    return cluster.approximate_predict(rest, model, 3).withColumn("prob", r6("prob"))


@query
def cluster_counts(spark, d):
    return cluster.cluster_counts(_labelled(spark, d))


@query
def noise_count(spark, d):
    noisy = _labelled(spark, d).withColumn("label", F.when(F.col("linear_ind") % 9 == 0, -1).otherwise(F.col("label")))
    return cluster.noise_count(noisy)


@query
def cluster_centroids(spark, d):
    rows = fx.vectors(spark, d).join(fx.det(spark, d).select("linear_ind", F.col("gt_label").alias("label")), "linear_ind")
    return cluster.cluster_centroids(rows).withColumn("mean", r6("mean"))


@query
def spanning_weights(spark, d):
    """How many edges of the minimum spanning tree under mutual reachability have a weight, in blocks of 512 points."""
    edges = density.spanning_edges(fx.vectors(spark, d), 3, block=512)
    return edges.groupBy(r6("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query
def hdbscan_labels(spark, d):
    return cluster.hdbscan_labels(fx.vectors(spark, d), 10, 3)


@query
def agglomerate(spark, d):
    tree = cut(cluster.condensed_tree(fx.vectors(spark, d), 4, 2))
    return cluster.agglomerate(tree, fx.det(spark, d).withColumn("score", F.col("likelihood")), min_goodness=0.3)


@query
def catalog_tables(spark, d):
    """Tables of a project written by frame and in ranges, cloned and read again: detections of each frame with their vector's length."""
    root = f"{ensure_checkpoint_dir(spark)}/project-{uuid.uuid4().hex}"
    one, two = tables.Catalog(spark, f"{root}-a"), tables.Catalog(spark, f"{root}-b")
    one.write("detections", fx.det(spark, d).select("linear_ind", "t"), by_frame=True)
    one.write_embeddings(fx.vectors(spark, d).select("linear_ind", "x"))
    tables.clone(one, two, ["detections", "embeddings", "missing"])
    early = two.read("detections", 0).unionByName(two.read("detections").where("t > 0"))
    return early.join(two.read("embeddings"), "linear_ind").select("linear_ind", F.col("t").cast("int").alias("t"), F.size("x").cast("bigint").alias("n"))


def _bucketed(spark, name, df):
    """A stage of a new project in buckets by frame, written, and read as a later run does."""
    project = tables.Catalog(spark, f"{ensure_checkpoint_dir(spark)}/project-{uuid.uuid4().hex}")
    project.stage_bucketed(name, lambda: df, STAGE_BUCKETS)
    return project.stage_bucketed(name, lambda: df, STAGE_BUCKETS)


@query
def bucketed_votes(spark, d):
    """Votes from a stage in buckets by frame: counted without a shuffle."""
    return sync.vote_counts(_bucketed(spark, "labelings", _unrotated(spark, d)))


@query
def bucketed_accuracy(spark, d):
    """Accuracy of each frame from a stage in buckets by frame."""
    return _rated(evaluate.accuracy(_bucketed(spark, "aligned", _aligned(spark, d)), "t"))


@query
def nan_to_null(spark, d):
    holes = fx.det(spark, d).select("linear_ind", F.when(F.col("linear_ind") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("z")).alias("z"))
    return tables.null_for_missing(holes).withColumn("z", r6("z"))


@query
def stream_labels(spark, d):
    """Frames that arrive as files: labelled by their nearest fitted point, then the best of each cell, both as streams."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    det = fx.det(spark, d)
    points = fx.vectors(spark, d).join(det.select("linear_ind", "raw_neuron_ind", "likelihood", F.col("gt_label").alias("label")), "linear_ind")
    chosen = frames.evenly_spaced(det, SAMPLED)
    arriving = points.join(chosen, "t", "left_anti").select("linear_ind", F.col("t").cast("int").alias("t"), "raw_neuron_ind", "likelihood", "x")
    arriving.repartition(3, "t").write.parquet(f"{root}/in")
    fitted = cut(points.join(chosen, "t", "left_semi"))
    tracks.assign_labels(tracks.detections(spark, f"{root}/in"), fitted, f"{root}/out", f"{root}/state").awaitTermination()
    return tracks.best_so_far(spark.read.parquet(f"{root}/out/*")).select(F.col("name").cast("int").alias("name"), "t", "raw_neuron_ind")


@query
def stream_predict(spark, d):
    """Frames that arrive as files, labelled by density and mutual reachability as in a batch."""
    root = f"{ensure_checkpoint_dir(spark)}/predict-{uuid.uuid4().hex}"
    det = fx.det(spark, d)
    model, rest = _fitted_some(spark, d)
    arriving = rest.join(det.select("linear_ind", "raw_neuron_ind", "likelihood"), "linear_ind").select("linear_ind", F.col("t").cast("int").alias("t"), "raw_neuron_ind", "likelihood", "x")
    arriving.repartition(3, "t").write.parquet(f"{root}/in")
    tracks.assign_labels(tracks.detections(spark, f"{root}/in"), model, f"{root}/out", f"{root}/state", 3).awaitTermination()
    return spark.read.parquet(f"{root}/out/*").select("linear_ind", "label", r6("likelihood").alias("prob"))


@query
def agglomerate_prior(spark, d):
    points = fx.vectors(spark, d)
    tree = cut(cluster.condensed_tree(points, 4, 2))
    fit = cluster.hdbscan_labels(points, 4, 2).select("linear_ind", "label")
    return cluster.agglomerate(tree, fx.det(spark, d).withColumn("score", F.col("likelihood")).join(fit, "linear_ind"), min_goodness=0.3)


def _tracker(spark, d):
    det = fx.det(spark, d)
    points = cut(fx.vectors(spark, d).join(det.select("linear_ind", "raw_neuron_ind", "likelihood"), "linear_ind"))
    return Tracker(points, frames.frame_count(det).first()[0], cluster_size=0.1)


@query
def track_global(spark, d):
    return _tracker(spark, d).track("global")


@query
def track_streaming(spark, d):
    return _tracker(spark, d).track("streaming")


@query
def track_label_propagation(spark, d):
    return _tracker(spark, d).track("label_propagation")


@query
def track_overlapping_windows(spark, d):
    return _tracker(spark, d).track("overlapping_windows")
