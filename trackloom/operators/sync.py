"""Many labelings of the same objects into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.hungarian import assign
from trackloom.functions.rounding import long_count
from trackloom.operators.checkpoints import cut, within

#: Runs times labels up to which the spectral step makes its matrix of products, which is dense, and cells of a
#: task's matrix of objects by such columns.
DENSE_COLUMNS, GRAM_CELLS = 4_096, 1 << 23
#: Numbers that the spectral step holds on the driver, and cells of labels by labels that one task matches.
DRIVER_CELLS, MATCH_CELLS = 50_000_000, 4_000_000
#: Share of runs under which a label is dropped, and the cost of none.
LEAST_SHARE = 0.02


def vote_counts(labelings: DataFrame) -> DataFrame:
    return labelings.groupBy("t", "linear_ind", "label").agg(long_count().alias("n"))


def label_confusion(ref: DataFrame, new: DataFrame) -> DataFrame:
    """ref, new, n: objects with both labels."""
    a, b = (df.select("linear_ind", F.col("label").alias(name)) for df, name in ((ref, "ref"), (new, "new")))
    return a.join(b, "linear_ind").groupBy("ref", "new").agg(long_count().alias("n"))


def column_weights(entries: DataFrame, strategy: str = "inv_sqrt", eps: float = 1e-8) -> DataFrame:
    """run, label, w: from the sum of a label's values."""
    total = F.sum("val") + eps
    w = {"inv_sqrt": 1 / F.sqrt(total), "inv": 1 / total, "none": F.lit(1.0)}[strategy]
    return entries.groupBy("run", "label").agg(w.alias("w"))


def row_normalize(entries: DataFrame) -> DataFrame:
    """val over the sum of its run and object; sums of 0 divide by 1."""
    total = F.sum("val").over(W.partitionBy("run", "linear_ind"))
    return entries.withColumn("val", F.col("val") / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)))


def consensus_votes(entries: DataFrame, perms: DataFrame) -> DataFrame:
    """linear_ind, label, votes: values summed under each run's renaming; labels mapped to null drop out.

    perms (run, label, mapped) has a row per run and label, not per object.
    """
    mapped = perms.where(F.col("mapped").isNotNull())
    return entries.join(mapped, ["run", "label"]).groupBy("linear_ind", F.col("mapped").alias("label")).agg(F.sum("val").alias("votes"))


def coverage_diagnostics(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """min_n, max_n, mean_n: runs that label an object, objects without any included."""
    counts = entries.groupBy("linear_ind").agg(F.count_distinct("run").cast("bigint").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return objects.select("linear_ind").join(counts, "linear_ind", "left").agg(F.min(n).alias("min_n"), F.max(n).alias("max_n"), F.avg(n).alias("mean_n"))


def unmatched_labels(new: DataFrame, confusion: DataFrame, overlap: int = 0) -> DataFrame:
    """label: labels of new that meet no label of the other run in more than overlap objects."""
    met = confusion.where(F.col("n") > overlap).select(F.col("new").alias("label"))
    return new.select("label").distinct().join(met, "label", "left_anti")


def gram_matrix(entries: DataFrame) -> DataFrame:
    """run1, label1, run2, label2, g: products of the columns of all runs side by side. An object has
    one entry per run at most, so the join gives the square of the runs per object."""
    a = entries.select("linear_ind", F.col("run").alias("run1"), F.col("label").alias("label1"), F.col("val").alias("v1"))
    b = entries.select("linear_ind", F.col("run").alias("run2"), F.col("label").alias("label2"), F.col("val").alias("v2"))
    return a.join(b, "linear_ind").groupBy("run1", "label1", "run2", "label2").agg(F.sum(F.col("v1") * F.col("v2")).alias("g"))


def fuse_votes(votes: DataFrame, runs: int) -> DataFrame:
    """linear_ind, t, label, confidence of votes (t, linear_ind, label, n): per frame the assignment of
    labels to objects with most votes. A label may go to an object that has no vote for it, with
    confidence 0. A frame is one task's matrix."""

    def solve(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf if pdf.label.notna().all() else pdf[pdf.label.notna()]
        objects, row = np.unique(pdf.linear_ind.to_numpy(), return_inverse=True)
        labels, column = np.unique(pdf.label.to_numpy(), return_inverse=True)
        table = np.zeros((len(objects), len(labels)))
        np.add.at(table, (row, column), pdf.n.to_numpy())
        r, c = np.array(assign(-table), dtype=int).reshape(-1, 2).T
        frame = int(pdf.t.iloc[0]) if len(pdf) else 0
        return pd.DataFrame({"linear_ind": objects[r], "t": frame, "label": labels[c], "confidence": table[r, c] / runs})

    return votes.groupBy("t").applyInPandas(solve, "linear_ind bigint, t int, label int, confidence double")


def fuse_labels(labelings: DataFrame, runs: int) -> DataFrame:
    """linear_ind, t, label, confidence: fuse_votes of what the labelings vote for."""
    return fuse_votes(vote_counts(labelings), runs)


def _renaming(ref: DataFrame, new: DataFrame) -> DataFrame:
    """label, aligned: the labels of new by ref's, for align_pair.

    The confusion cells, of labels by labels, are counted before they go to one task.
    """
    cells = label_confusion(ref, new)
    every = new.select(F.lit(None).cast("int").alias("ref"), F.col("label").alias("new"), F.lit(0).cast("bigint").alias("n")).distinct()
    top = ref.agg(F.max("label").cast("int").alias("ref")).select("ref", F.lit(None).cast("int").alias("new"), F.lit(0).cast("bigint").alias("n"))
    rows = within(cells.select(F.col("ref").cast("int"), F.col("new").cast("int"), "n").unionByName(every).unionByName(top), MATCH_CELLS, "cells of labels to match")

    def solve(pdf):
        import numpy as np
        import pandas as pd

        top = pdf[pdf.new.isna()].ref.max()
        fresh = 0 if pd.isna(top) else int(top) + 1
        met = pdf[pdf.n > 0]
        columns, found = sorted(pdf.new.dropna().astype(int).unique()), {}
        if len(met):
            columns, rows = sorted(met.new.astype(int).unique()), sorted(met.ref.astype(int).unique())
            cost = np.zeros((len(rows), len(columns)))
            cost[np.searchsorted(rows, met.ref.astype(int)), np.searchsorted(columns, met.new.astype(int))] = -met.n
            found = {columns[j]: rows[i] for i, j in assign(cost)}
        for c in columns:
            if c not in found:
                found[c] = fresh
                fresh += 1
        return pd.DataFrame([(int(a), int(b)) for a, b in found.items()], columns=["label", "aligned"])

    return rows.groupBy(F.lit(1).alias("all")).applyInPandas(solve, "label int, aligned int")


def align_pair(ref: DataFrame, new: DataFrame) -> DataFrame:
    """new with its labels renamed to ref's by most objects in common. Labels that meet ref's but are
    left over get fresh numbers; labels that never meet them drop out; if nothing meets, all are fresh."""
    return new.join(_renaming(ref, new), "label").withColumn("label", F.col("aligned")).select(*new.columns)


def align_all(labelings: DataFrame, runs: list[int]) -> DataFrame:
    """Fused labels of all runs, each aligned in turn to the fusion of those before it.

    The votes of the runs so far are kept as a table, so a run adds its own votes and reads no earlier one again.
    """
    votes = cut(vote_counts(labelings.where(F.col("run") == runs[0])))
    for i, run in enumerate(runs[1:], start=1):
        own = labelings.where(F.col("run") == run)
        ref = cut(fuse_votes(votes, i).where("confidence > 0").select("linear_ind", "label"))
        both = votes.unionByName(vote_counts(align_pair(ref, own)))
        votes = cut(both.groupBy("t", "linear_ind", "label").agg(F.sum("n").alias("n")))
    return fuse_votes(votes, len(runs))


def round_block(block, null_cost: float | None = None) -> list[int | None]:
    """The column of each row of a square block by greatest absolute values; at most one row takes none."""
    import numpy as np

    size = np.abs(np.asarray(block, dtype=float))
    none = -0.5 * float(np.median(size.max(axis=1))) if null_cost is None else null_cost
    pairs = assign(np.hstack([-size, np.full((len(size), 1), none)]))
    return [c if c < len(size) else None for _, c in pairs]


def steady_basis(vectors):
    """vectors (rows by leading directions) turned so that rows of equal meaning point along one axis.

    Directions of nearly equal strength come in an arbitrary rotation; the rows farthest apart are
    chosen one by one, and the rotation nearest to putting them on the axes is applied.
    """
    import numpy as np

    rest, chosen = np.array(vectors, dtype=float), []
    for _ in range(vectors.shape[1]):
        norms = (rest**2).sum(axis=1)
        best = int(np.argmax(norms))
        if norms[best] < 1e-12:
            break
        chosen.append(best)
        axis = rest[best] / np.sqrt(norms[best])
        rest = rest - np.outer(rest @ axis, axis)
    u, _, v = np.linalg.svd(vectors[chosen].T, full_matrices=False)
    turned = np.zeros_like(vectors)
    turned[:, : len(chosen)] = vectors @ (u @ v)
    return turned


def _numbered(weighted: DataFrame, place: dict[int, int], labels: int) -> DataFrame:
    """linear_ind, c (a column's number), val: an object's rows stand together."""
    names = F.create_map(*[F.lit(x) for run, i in place.items() for x in (run, i)])
    columns = weighted.select("linear_ind", (names[F.col("run")] * labels + F.col("label") - 1).cast("int").alias("c"), "val")
    return columns.repartition("linear_ind").sortWithinPartitions("linear_ind")


#: Rows that are gathered before they are multiplied.
GATHERED = 1 << 18


def _whole_objects(batches):
    """(ids, c, values) of batches of linear_ind, c and val, many rows at once; an object that is cut by an end waits for the next."""
    import numpy as np

    def joined(parts):
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    waiting, n = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0))], 0
    for batch in batches:
        waiting.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
        n += batch.num_rows
        if n >= GATHERED:
            rows = joined(waiting)
            whole = np.searchsorted(rows[0], rows[0][-1])
            yield tuple(column[:whole] for column in rows)
            waiting, n = [tuple(column[whole:] for column in rows)], len(rows[0]) - whole
    yield joined(waiting)


def _leading_dense(weighted: DataFrame, place: dict[int, int], labels: int):
    """Leading eigenvectors of the products of all columns, and how strong they are.

    A task multiplies its objects' rows as matrices and adds up one matrix of columns by columns, a row of which goes on at a time.
    """
    import numpy as np

    size = len(place) * labels

    def run(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for ids, c, v in _whole_objects(batches):
            _, at = np.unique(ids, return_inverse=True)
            n, step = at[-1] + 1 if len(at) else 0, max(1, GRAM_CELLS // size)
            for lo in range(0, n, step):
                part, high = slice(*np.searchsorted(at, (lo, lo + step))), min(n, lo + step)
                rows = np.bincount((at[part] - lo) * size + c[part], weights=v[part], minlength=(high - lo) * size).reshape(-1, size)
                total += rows.T @ rows
        for lo in range(0, size, 256):  # a few at a time
            used = lo + np.flatnonzero(total[lo : lo + 256].any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array([r.tobytes() for r in total[used]], pa.binary())], names=["c", "row"])

    def added(key, table):
        import pyarrow as pa

        return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([sum(np.frombuffer(r.as_buffer()) for r in table.column("row")).tobytes()], pa.binary())})

    found = _numbered(weighted, place, labels).mapInArrow(run, "c int, row binary").groupBy("c").applyInArrow(added, "c int, row binary").toArrow()
    gram = np.zeros((size, size))
    for c, row in zip(found["c"].to_pylist(), found["row"], strict=True):
        gram[c] = np.frombuffer(row.as_buffer())
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return values[::-1][:labels], vectors[:, ::-1][:, :labels]


def _leading_free(weighted: DataFrame, place: dict[int, int], labels: int, rounds: int = 30, spare: int = 8, enough: float = 1e-8):
    """The same without that matrix: a few more directions than needed go through all objects' rows,
    round by round, each round one job that brings back columns by directions.

    Rows are dealt by object once and kept; a task adds up its own part of the product.
    """
    import numpy as np

    size, wide = len(place) * labels, min(len(place) * labels, labels + spare)
    rows = cut(_numbered(weighted, place, labels))

    def product(q):
        sent, shape = rows.sparkSession.sparkContext.broadcast(q), q.shape  # size by wide, checked by the caller

        def run(batches):
            import pyarrow as pa

            total = np.zeros(shape)
            for ids, c, v in _whole_objects(batches):
                _, at = np.unique(ids, return_inverse=True)
                y = np.zeros((at.max() + 1 if len(at) else 0, shape[1]))
                np.add.at(y, at, v[:, None] * sent.value[c])
                np.add.at(total, c, v[:, None] * y[at])
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["c", "row"])

        parts = rows.mapInArrow(run, "c int, row array<double>").select("c", F.posexplode("row").alias("k", "v"))
        found = parts.groupBy("c", "k").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(shape)
        out[found["c"].to_numpy(), found["k"].to_numpy()] = found["v"].to_numpy()
        sent.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(0).normal(size=(size, wide)))[0]
    before = None
    for _ in range(rounds):
        z = product(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, vectors = values[::-1], (q @ turn)[:, ::-1]
        if before is not None and np.abs(values[:labels] - before).max() <= enough * values[0]:
            break
        before = values[:labels]
        q = np.linalg.qr(z)[0]
    return values[:labels], vectors[:, :labels]


def spectral_permutations(entries: DataFrame, labels: int, weighting: str = "inv_sqrt", dense: int = DENSE_COLUMNS) -> DataFrame:
    """run, label, mapped: each run's labels to common ones, from the leading eigenvectors of the
    products of all runs' weighted columns.

    Up to dense columns (runs times labels) the matrix of products goes through the driver; with more,
    only columns by labels does, in rounds over the objects' rows (see _leading_free), up to DRIVER_CELLS.
    """
    w = column_weights(entries, weighting)
    weighted = entries.join(w, ["run", "label"]).withColumn("val", F.col("val") * F.col("w"))
    most = DRIVER_CELLS // max(1, labels) ** 2
    runs = sorted(r["run"] for r in entries.select("run").distinct().limit(most + 1).collect())
    if len(runs) > most:
        raise ValueError(f"more than {most} runs of {labels} labels; the spectral step takes {DRIVER_CELLS} cells of columns by labels")
    place = {r: i for i, r in enumerate(runs)}
    values, vectors = (_leading_dense if len(runs) * labels <= dense else _leading_free)(weighted, place, labels)
    top = steady_basis(vectors * (values > 1e-9 * values[0]))
    perms = [(int(run), k + 1, None if c is None else c + 1) for run, i in place.items() for k, c in enumerate(round_block(top[i * labels : (i + 1) * labels]))]
    return entries.sparkSession.createDataFrame(perms, "run int, label int, mapped int")


def unique_per_frame(consensus: DataFrame, detections: DataFrame, labels: int, runs: int, least: float = LEAST_SHARE) -> DataFrame:
    """linear_ind, t, label, prob: per frame the one-to-one assignment of most votes; frames of one
    object and shares of the runs under least have none."""
    votes = detections.select("linear_ind", "t").join(consensus, "linear_ind", "left")

    def solve(table):
        import numpy as np
        import pyarrow as pa

        objects, at = np.unique(table.column("linear_ind").to_numpy(), return_inverse=True)
        found, share = [], np.zeros((len(objects), labels))
        if len(objects) > 1:
            label, v = table.column("label").to_numpy(), table.column("votes").to_numpy()
            some = ~np.isnan(label.astype(float))
            share[at[some], label[some].astype(int) - 1] = v[some]
            side = max(share.shape)
            cost = np.full((side, side), -least)
            cost[: len(objects), :labels] = -share
            found = [(r, c) for r, c in assign(cost) if r < len(objects) and c < labels and share[r, c] / runs >= least]
        r, c = np.array(found, dtype=int).reshape(-1, 2).T
        t = np.full(len(r), table.column("t")[0].as_py() if len(r) else 0, dtype=np.int32)
        return pa.table({"linear_ind": objects[r], "t": t, "label": (c + 1).astype(np.int32), "prob": share[r, c] / runs})

    return votes.groupBy("t").applyInArrow(solve, "linear_ind bigint, t int, label int, prob double")


def spectral_sync(labelings: DataFrame, detections: DataFrame, spare: int = 10) -> DataFrame:
    """linear_ind, t, label, prob: one labeling from many runs with labels of their own, by spectral synchronisation."""
    from trackloom.operators.assign import greedy_top1
    entries = cut(row_normalize(greedy_top1(labelings).withColumn("val", F.col("prob"))).select("run", "linear_ind", "label", "val"))
    n_runs, top = entries.agg(F.count_distinct("run"), F.max("label")).first()
    if not n_runs:
        return detections.sparkSession.createDataFrame([], "linear_ind bigint, t int, label int, prob double")
    labels = top + spare
    perms = spectral_permutations(entries, labels)
    return unique_per_frame(consensus_votes(entries, perms), detections, labels, n_runs)
