"""Frames: padding, windows over time, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.rounding import long_count


def frame_count(detections: DataFrame) -> DataFrame:
    """One row: n_frames, the greatest frame plus one (not the number of distinct frames)."""
    return detections.agg((F.max("t") + 1).cast("int").alias("n_frames"))


def with_frame_count(df: DataFrame, detections: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(frame_count(detections)))  # one row by construction


def spine(names: DataFrame, detections: DataFrame) -> DataFrame:
    """name and t for every name and every frame from 0."""
    return with_frame_count(names.select("name").distinct(), detections).select("name", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("t"))


def pad_frames(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """tracks with a row for every frame of every name; null where there was none."""
    return spine(tracks, detections).join(tracks, ["name", "t"], "left")


def pad_rows(df: DataFrame, target_length: int) -> DataFrame:
    """df (with t) and rows of nulls, numbered on from its greatest t, up to target_length rows."""
    size = df.agg(F.count(F.lit(1)).cast("int").alias("n"), F.coalesce(F.max("t"), F.lit(-1)).alias("last"))
    extra = size.where(F.col("n") < target_length).select(
        F.explode(F.sequence(F.col("last") + 1, F.col("last") + target_length - F.col("n"))).alias("t")
    )
    return df.unionByName(extra, allowMissingColumns=True)


def frames_within(detections: DataFrame, least: int = 1, most: int = 200) -> DataFrame:
    """t and n of frames with more than least and at most most objects."""
    return detections.groupBy("t").agg(long_count().alias("n")).where((F.col("n") > least) & (F.col("n") <= most))


def drop_last_frame(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    return with_frame_count(tracks, detections).where(F.col("t") < F.col("n_frames") - 1).drop("n_frames")


def frames_by_size(detections: DataFrame) -> DataFrame:
    """t, n and rk: largest first, equal sizes by time. One row per frame goes through one sort."""
    sized = detections.groupBy("t").agg(long_count().alias("n"))
    return sized.withColumn("rk", F.row_number().over(W.orderBy(F.desc("n"), "t")).cast("bigint"))


def window_starts(n_frames: Column, width: int, stride: int | None = None) -> Column:
    """Starts at every stride before n_frames - width, and n_frames - width - 1, so the last frame is in no window."""
    stride = stride or max(1, width // 2)
    last = n_frames - width - 1
    regular = F.when(n_frames - width > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.concat(regular, F.array(last))


def overlapping_windows(detections: DataFrame, width: int, stride: int | None = None) -> DataFrame:
    """start and the columns of detections, for every window that a detection is in.

    A detection knows its own windows from its frame, so there is no join with the list of windows, nor is
    that list made: only the starts around the frame are. They are those of window_starts.
    """
    stride = stride or max(1, width // 2)
    rows = with_frame_count(detections, detections)
    last = F.col("n_frames") - width - 1
    least = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / stride) * stride).cast("int")
    most = (F.floor(F.least(F.col("t"), last) / stride) * stride).cast("int")
    none = F.array().cast("array<int>")
    regular = F.when((last >= 0) & (least <= most), F.sequence(least, most, F.lit(stride))).otherwise(none)
    end = F.when((last <= F.col("t")) & (F.col("t") <= last + width - 1), F.array(last)).otherwise(none)
    return rows.select(F.explode(F.array_distinct(F.concat(regular, end))).alias("start"), *detections.columns)


def evenly_spaced(detections: DataFrame, n: int) -> DataFrame:
    """t: n frames at even distances from 0."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("n_frames") / n).cast("int"))
    return frame_count(detections).select(F.explode(F.array_distinct(spaced)).alias("t"))


def other_frames(detections: DataFrame, sample: DataFrame) -> DataFrame:
    """The frames that are not in the sample."""
    return detections.select("t").distinct().join(sample.select("t"), "t", "left_anti")


def linear_index(detections: DataFrame) -> DataFrame:
    """linear_ind and new_ind, its place by (gt_label, t, linear_ind).

    Frames are counted first. Running sums over the frames of each label, and over the labels, give
    offsets, so no sort is of more than one label's frames or of one row per label.
    """
    counts = detections.groupBy("gt_label", "t").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    labels = counts.groupBy("gt_label").agg(F.sum("n").alias("n")).select("gt_label", before(W.orderBy("gt_label")).alias("first"))
    offsets = counts.select("gt_label", "t", before(W.partitionBy("gt_label").orderBy("t")).alias("offset"))
    inside = F.row_number().over(W.partitionBy("gt_label", "t").orderBy("linear_ind")) - 1
    rows = detections.join(offsets, ["gt_label", "t"]).join(labels, "gt_label")
    return rows.select("linear_ind", (F.col("first") + F.col("offset") + inside).cast("bigint").alias("new_ind"))


def hashed_order(df: DataFrame, key: str, seed: int = 0) -> Column:
    """An order that looks random and is the same in each run."""
    return F.xxhash64(F.lit(seed), F.col(key))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hashed order: a sampling operator, so the limit is its purpose."""
    return df.orderBy(hashed_order(df, key, seed), key).limit(n)


def valid_sample(detections: DataFrame, n: int, order: list[Column], least: int = 1, most: int = 200) -> DataFrame:
    """t of n + 1 frames of a valid size, the first by order: frames are taken until there are more than n."""
    return frames_within(detections, least, most).orderBy(*order).limit(n + 1).select("t")


def base_window(dealt: DataFrame, label: str) -> DataFrame:
    """start and n of the window with most different labels, the first of equals."""
    counts = dealt.groupBy("start").agg(F.count_distinct(label).cast("bigint").alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "start", "n")).alias("b")).select("b.start", "b.n")


def train_val_test_split(frames: DataFrame, order: list[Column], train: float, val: float) -> DataFrame:
    """t and split, of exact sizes: a fraction below 1 is of all frames, else a number of frames; the rest is test."""
    ranked = frames.select("t", F.row_number().over(W.orderBy(*order)).alias("rn"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    size = lambda f: F.floor(F.col("n") * f) if f < 1 else F.lit(int(f))
    split = F.when(F.col("rn") <= size(train), "train").when(F.col("rn") <= size(train) + size(val), "val").otherwise("test")
    return ranked.select("t", split.alias("split"))
