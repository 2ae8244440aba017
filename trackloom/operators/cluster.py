"""Density clustering over detections, and the goodness of its tree's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import hdbscan
from trackloom.functions.rounding import long_count
from trackloom.operators import density, graph
from trackloom.operators.agglomeration import agglomerate  # noqa: F401
from trackloom.operators.checkpoints import cut


def core_distance(neighbours: DataFrame, k: int | None) -> DataFrame:
    """linear_ind, core: the distance to the k-th neighbour, itself being the first; without k to the farthest of those there."""
    if k is None:
        return neighbours.groupBy(F.col("src").alias("linear_ind")).agg(F.max("dist").alias("core"))
    return neighbours.where(F.col("rk") == k).select(F.col("src").alias("linear_ind"), F.col("dist").alias("core"))


def mutual_reachability(neighbours: DataFrame, core: DataFrame) -> DataFrame:
    """src, dst, mr of the edges between different points."""
    of = lambda side: core.select(F.col("linear_ind").alias(side), F.col("core").alias(f"core_{side}"))
    edges = neighbours.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst")
    return edges.select("src", "dst", F.greatest("core_src", "core_dst", "dist").alias("mr"))


#: Points of a fit without groups that one task makes; more are fitted in blocks and levels, see density.
LOCAL_POINTS = 4096


def _in_memory(rows: DataFrame, key: str, min_cluster_size: int, min_samples: int) -> DataFrame:
    """One task's fit for each group of key."""

    def solve(pdf):
        import numpy as np

        pdf = pdf.sort_values("linear_ind")
        x = np.stack(pdf.x.to_list())
        labels, strength, tree = hdbscan.fit(x, min_cluster_size, min_samples)
        birth, top = hdbscan.densities(tree, len(x))
        at = np.append(np.arange(len(birth)), -1)[labels] if len(birth) else np.full(len(x), -1)
        out = pdf[[key, "linear_ind"]].assign(label=labels.astype("int32"), prob=strength)
        return out.assign(core=hdbscan.core_distances(x, max(1, min_samples)), birth=np.append(birth, np.nan)[at], top=np.append(top, np.nan)[at])

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, linear_ind bigint, label int, prob double, core double, birth double, top double"
    return rows.select(key, "linear_ind", "x").groupBy(key).applyInPandas(solve, schema)


def _in_blocks(points: DataFrame, min_cluster_size: int, min_samples: int, block: int = graph.BLOCK, task_nodes: int | None = None) -> DataFrame:
    """The same of all points, however many: linear_ind, label, prob, core, birth, top."""
    points = cut(points.select("linear_ind", "x"))
    core = density.cores(points, min_samples, block)
    edges = cut(density.spanning_edges(points, min_samples, block, core))
    leaves = density.leaf_clusters(density.condensed_tree(points, edges, min_cluster_size, task_nodes))
    held = core.select("linear_ind", "core").join(leaves, "linear_ind", "left")
    return held.select("linear_ind", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("prob", F.lit(0.0)).alias("prob"), "core", "birth", "top")


def fitted(points: DataFrame, min_cluster_size: int, min_samples: int, by: str | None = None) -> DataFrame:
    """(by,) linear_ind, label, prob, core, birth, top: one fit per group of by, or one of all points.

    core: the core distance of a point; birth and top: the densities at which its cluster begins and at which it is densest
    (null for noise, label -1). A group is a task's work while it has hdbscan.MOST_POINTS points at
    most, all points without groups LOCAL_POINTS; larger fits are made in blocks, one after the other.
    """
    if not by:
        if points.count() > LOCAL_POINTS:
            return _in_blocks(points, min_cluster_size, min_samples)
        return _in_memory(points.withColumn("_all", F.lit(0)), "_all", min_cluster_size, min_samples).drop("_all")
    large = [r[0] for r in points.groupBy(by).count().where(F.col("count") > hdbscan.MOST_POINTS).select(by).collect()]
    found = _in_memory(points.where(~F.col(by).isin(large)) if large else points, by, min_cluster_size, min_samples)
    for key in large:
        one = _in_blocks(points.where(F.col(by) == key), min_cluster_size, min_samples)
        found = found.unionByName(one.withColumn(by, F.lit(key).cast(points.schema[by].dataType)))
    return found


def hdbscan_labels(points: DataFrame, min_cluster_size: int, min_samples: int, by: str | None = None) -> DataFrame:
    """(by,) linear_ind, label, prob of fitted; -1 is noise."""
    return fitted(points, min_cluster_size, min_samples, by).select(*([by] if by else []), "linear_ind", "label", "prob")


def condensed_tree(points: DataFrame, min_cluster_size: int, min_samples: int) -> DataFrame:
    """parent, child, lambda, size, point: the condensed tree; point is the child's linear_ind where it is one."""
    if points.count() > LOCAL_POINTS:
        points = cut(points.select("linear_ind", "x"))
        return density.condensed_tree(points, density.spanning_edges(points, min_samples), min_cluster_size)

    def solve(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("linear_ind")
        ids = pdf.linear_ind.to_numpy()
        _, _, tree = hdbscan.fit(np.stack(pdf.x.to_list()), min_cluster_size, min_samples)
        out = pd.DataFrame(tree, columns=["parent", "child", "lambda", "size"])
        out["point"] = [int(ids[c]) if c < len(ids) else None for c in out.child]
        return out.astype({"point": "Int64"})

    rows = points.select(F.lit(0).alias("_all"), "linear_ind", "x")
    return rows.groupBy("_all").applyInPandas(solve, "parent bigint, child bigint, lambda double, size bigint, point bigint")


def approximate_predict(points: DataFrame, model: DataFrame, min_samples: int) -> DataFrame:
    """linear_ind, label, prob of new points: model is fitted's result with x.

    A point's nearest fitted point is that of least mutual reachability among the nearest 2 *
    min_samples. It takes that one's cluster if it is dense enough there to lie within it, with its
    density over the cluster's greatest as probability; else, and next to noise, it is noise.
    """
    near = graph.knn(points, max(2, 2 * min_samples), model.select("linear_ind", "x"))
    own = near.groupBy("src").agg(F.max(F.when(F.col("rk") <= max(1, min_samples), F.col("dist"))).alias("own_core"))
    held = model.select(F.col("linear_ind").alias("dst"), "label", "core", "birth", "top")
    reach = F.greatest("dist", "own_core", "core")
    best = near.join(own, "src").join(held, "dst").groupBy("src").agg(F.min(F.struct(reach.alias("reach"), "dst", "label", "birth", "top")).alias("b"))
    density = F.when(F.col("b.reach") > 0, 1 / F.col("b.reach")).otherwise(F.lit(float("inf")))
    inside = (F.col("b.label") >= 0) & (density >= F.col("b.birth"))
    share = F.when(F.col("b.top") > 0, F.least(density, F.col("b.top")) / F.col("b.top")).otherwise(F.lit(1.0))
    label = F.when(inside, F.col("b.label")).otherwise(F.lit(-1)).cast("int")
    return best.select(F.col("src").alias("linear_ind"), label.alias("label"), F.when(inside, share).otherwise(F.lit(0.0)).alias("prob"))


def nn_label_assign(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """linear_ind, label of the nearest labelled point."""
    near = graph.knn(points, 1, labelled.select("linear_ind", "x"))
    labels = labelled.select(F.col("linear_ind").alias("dst"), "label")
    return near.join(labels, "dst").select(F.col("src").alias("linear_ind"), "label")


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """t, n: distinct labels of a frame but noise."""
    return labelled.groupBy("t").agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).cast("bigint").alias("n"))


def noise_count(labelled: DataFrame) -> DataFrame:
    return labelled.agg(long_count(F.col("label") == -1).alias("n"))


def cluster_centroids(labelled: DataFrame) -> DataFrame:
    """label, i (from 0), mean: each dimension's mean over the cluster's x."""
    return labelled.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("mean"))


def node_goodness(tree: DataFrame, detections: DataFrame, alpha: float = 0.9) -> DataFrame:
    """node, total, kept, purity, goodness of every node, in one aggregation over the tree's closure;
    nodes of more than twice as many points as there are frames are left out."""
    from trackloom.operators.assign import goodness
    from trackloom.operators.frames import with_frame_count

    nodes = tree.select(F.coalesce("point", F.col("child")).alias("id"), "parent", "child", "point")
    closure = graph.tree_closure(nodes.select(F.col("child").alias("node"), "parent"))
    points = nodes.where("point is not null").select(F.col("child").alias("node"), F.col("point").alias("linear_ind"))
    members = closure.join(points, "node").join(detections.select("linear_ind", "t"), "linear_ind")
    counts = members.groupBy(F.col("anc").alias("node")).agg(long_count().alias("total"), F.count_distinct("t").cast("bigint").alias("kept"))
    rated = with_frame_count(counts, detections).where(F.col("total") <= 2 * F.col("n_frames"))
    purity = F.col("kept") / F.col("total")
    return rated.select("node", "total", "kept", purity.alias("purity"), goodness(purity, F.col("kept") / F.col("n_frames"), alpha).alias("goodness"))
