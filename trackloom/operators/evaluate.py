"""Tracks against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.distances import nearest_in_block
from trackloom.functions.rounding import long_count
from trackloom.operators import matching

def align(truth: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """name, t, gt_seg, pred_seg for each cell of the truth; predicted cells of no other use are left out.

    mapping (gt_name, pred_name) says which predicted track stands for a name.
    """
    p = predicted.select(F.col("name").alias("pred_name"), "t", F.col("raw_seg_id").alias("pred_seg"))
    rows = truth.join(mapping, F.col("name") == F.col("gt_name"), "left").join(p, ["pred_name", "t"], "left")
    return rows.select("name", "t", F.col("raw_seg_id").alias("gt_seg"), "pred_seg")


def finished_only(truth: DataFrame, finished: DataFrame) -> DataFrame:
    """truth of the finished names, or all of it where none is finished."""
    names = finished.select(F.col("name").alias("_of")).distinct()
    some = names.agg((F.count(F.lit(1)) > 0).alias("_some"))
    rows = truth.join(names, F.col("name") == F.col("_of"), "left").crossJoin(F.broadcast(some))  # one row by construction
    return rows.where(~F.col("_some") | F.col("_of").isNotNull()).select(*truth.columns)


def contingency(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """gt_name, pred_name, n: cells in which both tracks hold the same segment."""
    p = predicted.select(F.col("name").alias("pred_name"), "t", "raw_seg_id")
    return truth.select(F.col("name").alias("gt_name"), "t", "raw_seg_id").join(p, ["t", "raw_seg_id"]).groupBy("gt_name", "pred_name").agg(long_count().alias("n"))


def solve_matching(counts: DataFrame, by: str | None = None) -> DataFrame:
    """(by,) gt_name, pred_name, n of the one-to-one matching with most cells in common, of each group of
    by; pairs without any are unmatched. Equals go in order of the names where a task has them as a table; see matching.
    """
    group = F.col(by) if by else F.lit(1)
    found = matching.matched(counts.select(group.alias("grp"), F.col("gt_name").alias("gt"), F.col("pred_name").alias("pred"), F.col("n").cast("bigint").alias("n")))
    return found.select(*([F.col("grp").alias(by)] if by else []), F.col("gt").alias("gt_name"), F.col("pred").alias("pred_name"), "n")


def match_tracks(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """gt_name, pred_name, n of the one-to-one matching of tracks with most cells in common."""
    return solve_matching(contingency(truth, predicted))


def match_on_frames(truth: DataFrame, predicted: DataFrame, frames: list[int]) -> DataFrame:
    """The same over a few template frames only."""
    return match_tracks(truth.where(F.col("t").isin(frames)), predicted.where(F.col("t").isin(frames)))


def combine_first(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """name, t, raw_seg_id of both; where both have a cell, of the preferred unless it is null."""
    a = preferred.select("name", "t", F.col("raw_seg_id").alias("a"))
    b = other.select("name", "t", F.col("raw_seg_id").alias("b"))
    return a.join(b, ["name", "t"], "full").select("name", "t", F.coalesce("a", "b").alias("raw_seg_id"))


def mode_vote(votes: DataFrame) -> DataFrame:
    """linear_ind, label, n: the most frequent label, the smallest of equals."""
    counted = votes.where(F.col("label").isNotNull()).groupBy("linear_ind", "label").agg(long_count().alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "label", "n")).alias("b")
    return counted.groupBy("linear_ind").agg(best).select("linear_ind", "b.label", "b.n")


def enrich(tracks: DataFrame, detections: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Tracks with the ids and the position of their detection, null where it is unknown; fallback (t,
    raw_seg_id and the same columns) fills in what detections doesn't know."""
    if fallback is not None:
        known = ["raw_neuron_ind", "z", "x", "y"]
        both = detections.select("t", "raw_seg_id", *known).alias("d").join(fallback.select("t", "raw_seg_id", *known).alias("f"), ["t", "raw_seg_id"], "full")
        detections = both.select("t", "raw_seg_id", *[F.coalesce(f"d.{c}", f"f.{c}").alias(c) for c in known])
    return tracks.select("name", "t", "raw_seg_id").join(detections.select("t", "raw_seg_id", "raw_neuron_ind", "z", "x", "y"), ["t", "raw_seg_id"], "left").select("name", "t", "raw_neuron_ind", "z", "x", "y")


VALID = "gt_seg IS NOT NULL"
MISS = "gt_seg IS NOT NULL AND pred_seg IS NULL"
MISMATCH = "coalesce(gt_seg <> pred_seg, false)"
CORRECT = "coalesce(gt_seg = pred_seg, false)"


def accuracy_cells(aligned: DataFrame) -> DataFrame:
    """name, t and whether the cell counts, is missed, mismatched, correct."""
    return aligned.select("name", "t", *[F.expr(e).alias(n) for e, n in ((VALID, "gt_valid"), (MISS, "miss"), (MISMATCH, "mismatch"), (CORRECT, "correct"))])


def _counts() -> list[Column]:
    return [long_count(F.expr(VALID)).alias("n_gt"), long_count(F.expr(MISS)).alias("misses"), long_count(F.expr(MISMATCH)).alias("mismatches")]


def accuracy(aligned: DataFrame, by: str | None = None) -> DataFrame:
    """(by,) n_gt, misses, mismatches, accuracy; predictions where there is no truth are free, and no truth gives null."""
    grouped = aligned.groupBy(by) if by else aligned
    return grouped.agg(*_counts()).withColumn("accuracy", F.try_divide(F.col("n_gt") - F.col("misses") - F.col("mismatches"), F.col("n_gt")))


def accuracy_grouping_sets(aligned: DataFrame) -> DataFrame:
    """Totals, per name and per frame in one pass; name and t are null where a row is summed over them."""
    return aligned.groupingSets([[], ["name"], ["t"]], "name", "t").agg(*_counts())


def track_metrics(aligned: DataFrame, n_frames: Column) -> DataFrame:
    """Per name: detections, mistakes of each kind, gaps and their shares; aligned also has n_frames."""
    grouped = aligned.groupBy("name").agg(
        long_count(F.expr(VALID)).alias("num_detections"),
        long_count(F.expr(MISMATCH)).alias("num_mismatches"),
        long_count(F.expr(MISS)).alias("num_misses"),
        (F.max(n_frames) - F.count("pred_seg")).cast("bigint").alias("gaps"),
        F.max(n_frames).alias("n_frames"),
    )
    mistakes = F.col("num_mismatches") + F.col("num_misses")
    share = F.try_divide(F.col("gaps"), F.col("n_frames"))
    return grouped.select(
        "name", "num_detections", "num_mismatches", "num_misses", "gaps", share.alias("frac_gaps"), (100 * (1 - share)).alias("pct_tracked"),
        mistakes.alias("mistakes"), (1 - F.try_divide(mistakes, F.col("num_detections"))).alias("accuracy"), F.try_divide(mistakes, F.col("n_frames")).alias("frac_mistakes"),
    )


def track_metrics_no_truth(tracks: DataFrame, n_frames: Column) -> DataFrame:
    """name, gaps, frac_gaps, pct_tracked; tracks also has n_frames."""
    grouped = tracks.groupBy("name").agg((F.max(n_frames) - F.count("raw_seg_id")).cast("bigint").alias("gaps"), F.max(n_frames).alias("n_frames"))
    share = F.try_divide(F.col("gaps"), F.col("n_frames"))
    return grouped.select("name", "gaps", share.alias("frac_gaps"), (100 * (1 - share)).alias("pct_tracked"))


def trace_correlation(traces: DataFrame) -> DataFrame:
    """name and the Pearson correlation of columns a and b."""
    return traces.groupBy("name").agg(F.corr("a", "b").alias("correlation"))


def log_histogram(values: DataFrame, lo: float, hi: float, bins: int = 9) -> DataFrame:
    """bin, lo, hi, pct of column v over log-spaced edges; the last edge is widened so that hi is within.

    pct is of the values within the edges; every bin has a row.
    """
    from math import log10

    step = (log10(hi) - log10(lo)) / bins
    edges = [10 ** (log10(lo) + i * step) for i in range(bins + 1)]
    edges[0], edges[-1] = lo, hi + 1e-6
    found = F.when(F.lit(False), F.lit(0))
    for i in range(bins):
        found = found.when((F.col("v") >= edges[i]) & (F.col("v") < edges[i + 1]), F.lit(i))
    counted = values.select(found.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lo double, hi double")
    total = F.sum("n").over(W.partitionBy())
    share = F.coalesce(100.0 * F.col("n") / total, F.lit(0.0))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", "lo", "hi", share.alias("pct"))  # at most one row per bin


def trend(points: DataFrame) -> DataFrame:
    """slope, intercept, r2 of y over x."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def macro_micro(aligned: DataFrame) -> DataFrame:
    """The mean of the accuracies of names, and the accuracy of all cells."""
    per_name = accuracy(aligned, "name").withColumn("ok", F.col("n_gt") - F.col("misses") - F.col("mismatches"))
    return per_name.agg(F.avg("accuracy").alias("macro"), F.try_divide(F.sum("ok"), F.sum("n_gt")).alias("micro"))


def confidence_by_correct(scored: DataFrame) -> DataFrame:
    """name, correct, place (from 0) and conf: the confidences of a name's right and wrong cells, sorted."""
    w = W.partitionBy("name", "correct").orderBy("conf")
    return scored.select("name", "correct", (F.row_number().over(w) - 1).cast("bigint").alias("place"), "conf")


def displacement(padded: DataFrame) -> DataFrame:
    """name, t, dist from the frame before; null at the first frame and next to a gap."""
    w = W.partitionBy("name").orderBy("t")
    gone = sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in ("z", "x", "y")), F.lit(0.0))
    return padded.select("name", "t", F.sqrt(gone).alias("dist"))


def nearest_distance(detections: DataFrame) -> DataFrame:
    """linear_ind, t, dist to the nearest other detection of the frame; frames of one have none.

    A frame is searched in blocks of its own, as matrices, so no pair of detections is ever a row.
    """
    return _nearest_within(detections.withColumn("key", F.lit("")), detections, True).select("linear_ind", "t", "dist")


#: Detections of a block of a frame.
FRAME_BLOCK = 2_048


def _nearest_within(queries: DataFrame, detections: DataFrame, others: bool) -> DataFrame:
    """t, key, linear_ind of queries, dist and found: the nearest detection of the frame by position, then
    id; with others, other than itself. Each pair of blocks of a frame is one task's matrix."""

    def dealt(df, side):
        n = df.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / FRAME_BLOCK).cast("int").alias("blocks"))
        return df.join(n, "t").withColumn(side, F.pmod(F.xxhash64("linear_ind"), F.col("blocks")).cast("int")), n

    a, n_a = dealt(queries, "i")
    b, n_b = dealt(detections, "j")
    a = a.drop("blocks").join(n_b, "t").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    b = b.drop("blocks").join(n_a, "t").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"side": F.lit(1), "key": F.lit("")})
    columns = ["t", "i", "j", "side", "key", "linear_ind", "z", "x", "y"]

    def nearest(pdf):
        import numpy as np
        import pandas as pd

        q, d = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("linear_ind")
        gaps = np.sqrt(sum((q[c].to_numpy()[:, None] - d[c].to_numpy()) ** 2 for c in ("z", "x", "y")))
        if others:
            gaps[q.linear_ind.to_numpy()[:, None] == d.linear_ind.to_numpy()] = np.inf
        gaps = np.where(np.isnan(gaps), np.inf, gaps)
        best = gaps.argmin(axis=1) if len(d) else np.zeros(len(q), dtype=int)
        dist = gaps[np.arange(len(q)), best] if len(d) else np.full(len(q), np.inf)
        ok = np.isfinite(dist)
        return pd.DataFrame({"t": q.t.to_numpy()[ok], "key": q.key.to_numpy()[ok], "linear_ind": q.linear_ind.to_numpy()[ok], "dist": dist[ok], "found": d.linear_ind.to_numpy()[best[ok]]})

    kind = f"t {queries.schema['t'].dataType.simpleString()}, key string, linear_ind bigint, dist double, found bigint"
    cells = a.select(*columns).unionByName(b.select(*columns)).groupBy("t", "i", "j").applyInPandas(nearest, kind)
    return cells.groupBy("t", "key", "linear_ind").agg(F.min(F.struct("dist", "found")).alias("b")).select("t", "key", "linear_ind", "b.*")


def nearest_distance_mean(detections: DataFrame) -> DataFrame:
    """t, mean_dist for every frame; null with fewer than two detections."""
    found = nearest_distance(detections).groupBy("t").agg(F.avg("dist").alias("mean_dist"))
    return detections.select("t").distinct().join(found, "t", "left")


def adjacent_accuracy(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """name, correct, total over steps from a frame to the next in which the name is in both: right
    when the detection nearest to its position is the name's own."""
    step = truth.alias("a").join(truth.alias("n"), (F.col("n.name") == F.col("a.name")) & (F.col("n.t") == F.col("a.t") + 1))
    # where a name is now, asked in the frame and under the detection where it is next
    asked = step.select(F.col("a.name").alias("name"), F.col("a.name").cast("string").alias("key"), F.col("n.t").alias("t"), F.col("n.linear_ind").alias("linear_ind"), *[F.col(f"a.{c}").alias(c) for c in ("z", "x", "y")])
    nearest = _nearest_within(asked, detections, False)
    return asked.select("name", "key", "t", "linear_ind").join(nearest, ["t", "key", "linear_ind"], "left").groupBy("name").agg(long_count(F.col("found") == F.col("linear_ind")).alias("correct"), long_count().alias("total"))


def carried_index(truth: DataFrame) -> DataFrame:
    """name, t, raw_neuron_ind and prev_ind, the last index before t that isn't null."""
    w = W.partitionBy("name").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return truth.select("name", "t", "raw_neuron_ind", F.last("raw_neuron_ind", ignorenulls=True).over(w).alias("prev_ind"))


def template_match(queries: DataFrame, template: DataFrame, block: int = 2048) -> DataFrame:
    """linear_ind, template_ind, conf, agree: the nearest template, its softmax over -distance, and
    whether the labels agree (noise never does).

    Both sides are dealt into blocks; of two blocks only each query's best and its sum go on.
    """
    kind = template.schema["label"].dataType.simpleString()
    n_q, n_t = (max(1, -(-df.count() // block)) for df in (queries, template))
    place = lambda n: F.pmod(F.xxhash64("linear_ind"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    one = queries.select("linear_ind", "x", F.lit(None).cast(kind).alias("label"), F.lit(0).alias("side"), place(n_q).alias("i"), every(n_t).alias("j"))
    two = template.select("linear_ind", "x", "label", F.lit(1).alias("side"), place(n_t).alias("j"), every(n_q).alias("i"))

    def nearest(pdf):
        import numpy as np
        import pandas as pd

        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("linear_ind")
        names = ["linear_ind", "d", "template_ind", "tlabel", "z"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        x, y = np.stack(a.x.to_list()), np.stack(b.x.to_list())
        d, at = nearest_in_block(x, y, np.arange(len(b)), 1)
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
        z = np.exp(-np.sqrt(np.maximum(square, 0))).sum(axis=1)
        at = at[:, 0]
        return pd.DataFrame(dict(zip(names, (a.linear_ind.to_numpy(), d[:, 0], b.linear_ind.to_numpy()[at], b.label.to_numpy()[at], z))))

    cells = one.unionByName(two).groupBy("i", "j").applyInPandas(nearest, f"linear_ind bigint, d double, template_ind bigint, tlabel {kind}, z double")
    best = cells.groupBy("linear_ind").agg(F.min(F.struct("d", "template_ind", "tlabel")).alias("b"), F.sum("z").alias("z"))
    rows = best.join(queries.select("linear_ind", "label"), "linear_ind")
    agree = (F.col("label") == F.col("b.tlabel")) & (F.col("label") != -1)
    return rows.select("linear_ind", "b.template_ind", (F.exp(-F.col("b.d")) / F.col("z")).alias("conf"), agree.alias("agree"))


def class_embeddings(labelled: DataFrame) -> DataFrame:
    """label, place (from 0, by linear_ind), linear_ind and x: each class's embeddings as rows of its
    matrix. Noise and unlabelled points are in no class."""
    w = W.partitionBy("label").orderBy("linear_ind")
    some = labelled.where(F.col("label").isNotNull() & (F.col("label") != -1))
    return some.select("label", (F.row_number().over(w) - 1).cast("bigint").alias("place"), "linear_ind", "x")


def common_names(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.select("name").intersect(predicted.select("name"))


def rename_by(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """tracks under the names of mapping (old, new); tracks without a new name are left out."""
    return tracks.join(mapping.where(F.col("new").isNotNull()), F.col("name") == F.col("old")).drop("name", "old").withColumnRenamed("new", "name")
