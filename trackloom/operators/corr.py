"""Cross-correlation matrices of two views, their loss, and truncated SVD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.checkpoints import cut

LAMBDA, LAMBDA_OBJECTS = 0.0051, 0.67
#: Dimensions up to which their products go through the driver.
MOST_DIMENSIONS = 4_096


def _moments(views: DataFrame) -> DataFrame:
    """Rows of two arrays a and b to i, j, n, mx, my, c, vx, vy per task: count, means, and sums of
    products and squares about the means. A task holds one matrix of a's by b's dimensions."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        n = 0
        for batch in batches:
            x, y = (np.array(c.to_pylist(), dtype=float) for c in batch.columns)
            if not len(x):
                continue
            m, mx, my = len(x), x.mean(axis=0), y.mean(axis=0)
            c, vx, vy = (x - mx).T @ (y - my), ((x - mx) ** 2).sum(axis=0), ((y - my) ** 2).sum(axis=0)
            if n:  # two samples as one
                dx, dy, f = mx - old[0], my - old[1], n * m / (n + m)
                old = [old[0] + dx * m / (n + m), old[1] + dy * m / (n + m), old[2] + c + f * np.outer(dx, dy), old[3] + vx + f * dx**2, old[4] + vy + f * dy**2]
            else:
                old = [mx, my, c, vx, vy]
            n += m
        if n:
            mx, my, c, vx, vy = old
            i, j = np.divmod(np.arange(c.size), c.shape[1])
            columns = [i.astype("int32"), j.astype("int32"), np.full(c.size, n), mx[i], my[j], c.ravel(), vx[i], vy[j]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["i", "j", "n", "mx", "my", "c", "vx", "vy"])

    return views.select("a", "b").mapInArrow(add, "i int, j int, n bigint, mx double, my double, c double, vx double, vy double")


def cross_corr(views: DataFrame) -> DataFrame:
    """i, j, c from rows of two arrays a and b: the correlation of a's i-th with b's j-th, from 1,
    with sample deviations and divided by n, so that a view with itself has (n-1)/n on the diagonal.

    Each task brings one matrix of sums to the shuffle, not a row per detection and pair.
    """
    n = F.sum("n")
    about = lambda held, x, y: F.sum(held) + F.sum(F.col("n") * F.col(x) * F.col(y)) - F.sum(F.col("n") * F.col(x)) * F.sum(F.col("n") * F.col(y)) / n
    c = F.try_divide(about("c", "mx", "my"), F.sqrt(about("vx", "mx", "mx")) * F.sqrt(about("vy", "my", "my"))) * (n - 1) / n
    return _moments(views).groupBy((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")).agg(c.alias("c"))


def feature_gram(points: DataFrame) -> DataFrame:
    """i, j, g: the products of the columns of x, from 1, uncentred; one matrix of sums per task."""
    g = F.sum("c") + F.sum(F.col("n") * F.col("mx") * F.col("my"))
    return _moments(points.select(F.col("x").alias("a"), F.col("x").alias("b"))).groupBy((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")).agg(g.alias("g"))


#: Objects of a block of the object correlation: a task holds two blocks and their products.
OBJECT_BLOCK = 2048


def cross_corr_objects(views: DataFrame, by: tuple[str, ...] = (), block: int = OBJECT_BLOCK) -> DataFrame:
    """i, j, c between objects, over their features: rows of linear_ind, a and b of one frame, or of
    many with their columns by, which the result then has in front. Null where a view has no spread.

    A frame's objects are dealt into blocks; two blocks are one matrix product.
    """
    by = list(by)
    most = views.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = F.lit(max(1, -(-most // block)))
    own, other = F.pmod(F.xxhash64("linear_ind"), blocks), F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint")))
    side = lambda x, at, to, n: views.select(*by, "linear_ind", F.col(x).cast("array<double>").alias("x"), own.alias(at), F.lit(n).alias("side"), other.alias(to))
    cells = side("a", "_i", "_j", 0).unionByName(side("b", "_j", "_i", 1))

    def product(pdf):
        import numpy as np
        import pandas as pd

        def scaled(part):
            x = np.stack(part.x.to_list())
            x = x - x.mean(axis=1, keepdims=True)
            deviation = np.sqrt((x**2).sum(axis=1) / max(1, x.shape[1] - 1))
            return x / np.where(deviation > 0, deviation, np.nan)[:, None]

        one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(one) or not len(two):
            return pd.DataFrame({c: [] for c in (*by, "i", "j", "c")})
        left, right = scaled(one), scaled(two)
        c = left @ right.T / left.shape[1]
        out = {"i": np.repeat(one.linear_ind.to_numpy(), len(two)), "j": np.tile(two.linear_ind.to_numpy(), len(one)), "c": c.ravel()}
        return pd.DataFrame({k: pdf[k].iloc[0] for k in by} | out)

    kinds = ", ".join(f"{c} {views.schema[c].dataType.simpleString()}" for c in by)
    found = cells.groupBy(*by, "_i", "_j").applyInPandas(product, f"{kinds}{', ' if by else ''}i bigint, j bigint, c double")
    return found.withColumn("c", F.nanvl("c", F.lit(None).cast("double")))


def matrix_loss(c: DataFrame, off: float = LAMBDA) -> DataFrame:
    """One row: the mean over cells of (1 - diagonal)^2 and off times the squares beside it."""
    cell = F.when(F.col("i") == F.col("j"), (F.col("c") - 1) ** 2).otherwise(off * F.col("c") ** 2)
    return c.agg((F.sum(cell) / F.count(F.lit(1))).alias("loss"))


def barlow_loss(features: DataFrame, objects: DataFrame, weight: float = LAMBDA_OBJECTS) -> DataFrame:
    """loss_feat, loss_obj, loss of two matrices; a term of weight 0 counts as 0."""
    pair = matrix_loss(features).withColumnRenamed("loss", "loss_feat").crossJoin(F.broadcast(matrix_loss(objects).withColumnRenamed("loss", "loss_obj")))  # one row each
    feat = (1 - weight) * F.col("loss_feat") if weight < 1 else F.lit(0.0)
    obj = weight * F.col("loss_obj") if weight > 0 else F.lit(0.0)
    return pair.select("loss_feat", "loss_obj", (feat + obj).alias("loss"))


#: Triangles that a task reduces to one.
FAN = 16


def _triangles(batches):
    """The R factor of all rows of a task, batch after batch."""
    import numpy as np
    import pyarrow as pa

    r = None
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), dtype=float)
        if len(x):
            r = np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def svd_embed(points: DataFrame, components: int) -> DataFrame:
    """linear_ind and embedding, the rows of U times S of the truncated SVD of x, uncentred.

    By QR of a tall matrix: each task reduces its rows to a triangle of dimensions by dimensions, FAN
    triangles at a time become one, and the last one's SVD has the directions, whose
    condition is not squared on the way. Only that triangle goes through the driver (MOST_DIMENSIONS).
    Each direction has its greatest entry positive. Points are then projected batch by batch.
    """
    import numpy as np

    size = points.agg(F.max(F.size("x"))).first()[0] or 0
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions; the decomposition takes {MOST_DIMENSIONS}")

    def joined(batches):
        r = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                more = np.frombuffer(raw).reshape(-1, size)
                r = np.linalg.qr(more if r is None else np.concatenate([r, more]), mode="r")
        if r is not None:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    parts = cut(points.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(_triangles, "r binary"))
    while (n := parts.count()) > 1:
        parts = cut(parts.repartition(-(-n // FAN)).mapInArrow(joined, "r binary"))
    last = parts.first()
    v = np.linalg.svd(np.frombuffer(last["r"]).reshape(-1, size))[2].T[:, :components] if last else np.zeros((0, 0))
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1) if size else v

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(x @ v), pa.list_(pa.float64()))], names=["linear_ind", "embedding"])

    return points.select("linear_ind", "x").mapInArrow(project, "linear_ind bigint, embedding array<double>")
