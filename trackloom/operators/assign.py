"""One detection per identity and frame, and the purity of candidate clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.rounding import long_count


def _first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_noise(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("label") != -1)


def best_per_cell(labelled: DataFrame) -> DataFrame:
    """name, t, raw_neuron_ind, likelihood: the likeliest detection of each label and frame, the first of equals."""
    rows = _first(without_noise(labelled), ["label", "t"], [F.desc("likelihood"), "linear_ind"])
    return rows.select(F.col("label").alias("name"), "t", "raw_neuron_ind", "likelihood")


def last_per_cell(labelled: DataFrame) -> DataFrame:
    """name, t, raw_neuron_ind of the last detection of each label and frame."""
    return _first(without_noise(labelled), ["label", "t"], [F.desc("linear_ind")]).select(F.col("label").alias("name"), "t", "raw_neuron_ind")


def first_per_cell(labelled: DataFrame) -> DataFrame:
    """The same of the first, and raw_neuron_ind its place within the frame."""
    place = (F.row_number().over(W.partitionBy("t").orderBy("linear_ind")) - 1).cast("int")
    rows = labelled.withColumn("raw_neuron_ind", place)
    return _first(without_noise(rows), ["label", "t"], ["linear_ind"]).select(F.col("label").alias("name"), "t", "raw_neuron_ind")


def time_purity_kept(candidates: DataFrame) -> DataFrame:
    """Rows of candidates (cand, t, linear_ind, assigned, score) that stay: one per candidate and frame,
    unassigned before assigned, then by score, then by index, greatest first."""
    return _first(candidates, ["cand", "t"], ["assigned", F.desc("score"), F.desc("linear_ind")])


def time_purity(candidates: DataFrame) -> DataFrame:
    """cand, kept, total, purity."""
    kept = F.count_distinct("t")
    return candidates.groupBy("cand").agg(kept.cast("bigint").alias("kept"), long_count().alias("total"), (kept / F.count(F.lit(1))).alias("purity"))


def goodness(purity: Column, coverage: Column, alpha: float = 0.9) -> Column:
    return (1 - alpha) * purity + alpha * coverage


def greedy_top1(labelings: DataFrame) -> DataFrame:
    """run, t, label, linear_ind, prob: per run and frame each label's most probable object.

    Taking objects by falling probability and skipping taken labels, with no second choice, comes to this.
    """
    return _first(labelings, ["run", "t", "label"], [F.desc("prob"), "linear_ind"]).select("run", "t", "label", "linear_ind", "prob")


def thresholded(labelings: DataFrame, threshold: float) -> DataFrame:
    """label -1 and prob 0 where prob is under the threshold."""
    low = F.col("prob") < threshold
    return labelings.withColumns({"label": F.when(low, -1).otherwise(F.col("label")), "prob": F.when(low, 0.0).otherwise(F.col("prob"))})


def unassigned_points(detections: DataFrame, kept: DataFrame) -> DataFrame:
    return detections.select("linear_ind").join(kept.select("linear_ind"), "linear_ind", "left_anti")


def outlier_points(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """cand and linear_ind of the members that did not stay."""
    return candidates.select("cand", "linear_ind").join(kept.select("cand", "linear_ind"), ["cand", "linear_ind"], "left_anti")


def neither(detections: DataFrame, kept: DataFrame, outliers: DataFrame) -> DataFrame:
    """linear_ind of detections that are neither assigned nor outliers."""
    return unassigned_points(unassigned_points(detections, kept), outliers)


def seed_stats(seeds: DataFrame, *by: str) -> DataFrame:
    """(by,) n_assigned, n_cluster, n_leaf of seeds (assigned, label): only labels above 0 count as clusters."""
    free = ~F.col("assigned")
    return seeds.groupBy(*by).agg(
        long_count(F.col("assigned")).alias("n_assigned"),
        long_count(free & (F.col("label") > 0)).alias("n_cluster"),
        long_count(free & (F.col("label") <= 0)).alias("n_leaf"),
    )
