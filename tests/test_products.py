"""Work in blocks, triangles and rounds against numpy on the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import corr, crops, evaluate


def table(spark, x, **more):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "linear_ind bigint, x array<double>").withColumns(more)


def test_selection_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(crops, "BINS", 4)
    monkeypatch.setattr(crops, "FEW", 3)
    rng = np.random.default_rng(2)
    stacks = {0: rng.normal(size=200), 1: np.exp(rng.normal(0, 20, 150)), 2: np.full(40, 7.0), 3: np.array([1.0]), 4: np.repeat([3.0, -3.0, 3.0000001], 30), 5: rng.integers(0, 3, 90).astype(float)}
    values = spark.createDataFrame([(s, float(v)) for s, some in stacks.items() for v in some], "_by int, v double")
    ranks = [(s, int(r)) for s, some in stacks.items() for r in {0, len(some) - 1, len(some) // 2, len(some) // 20}]
    found = {(r["_by"], r["r"]): r["v"] for r in crops.ranked_values(values, spark.createDataFrame(ranks, "_by int, r bigint")).collect()}
    assert found == {(s, r): np.sort(stacks[s])[r] for s, r in ranks}


def test_rescaling_of_odd_stacks(spark):
    rows = [(1, [5.0, None, 1.0, 9.0]), (2, [2.0, 2.0]), (3, []), (4, [None]), (5, [1.0])]
    df = spark.createDataFrame(rows, "linear_ind bigint, vals array<double>")
    found = {(r["linear_ind"], r["pos"]): r["val"] for r in crops.rescale_intensity(df, 0.25).collect()}
    lo = np.percentile([5, 1, 9], 25)
    assert found == {(1, 0): (5 - lo) / (9 - lo), (1, 1): None, (1, 2): 0.0, (1, 3): 1.0, (2, 0): 0.0, (2, 1): 0.0, (4, 0): None, (5, 0): 0.0}


def test_object_correlation_in_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 25, 6))
    x[4] = 2.0  # no spread
    views = table(spark, x).withColumnRenamed("x", "a").join(table(spark, y).withColumnRenamed("x", "b"), "linear_ind").withColumn("t", (F.col("linear_ind") % 2).cast("int"))
    z = [(v - v.mean(1, keepdims=True)) / np.where(v.std(1, ddof=1, keepdims=True) > 0, v.std(1, ddof=1, keepdims=True), np.nan) for v in (x, y)]
    c = z[0] @ z[1].T / 6
    for block in (3, 100):
        found = {(r["t"], r["i"], r["j"]): r["c"] for r in corr.cross_corr_objects(views, ("t",), block).collect()}
        assert len(found) == 13 * 13 + 12 * 12
        for (t, i, j), v in found.items():
            assert i % 2 == j % 2 == t and (v is None if i == 4 else v == pytest.approx(c[i, j]))


def test_decomposition_of_ill_conditioned_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * np.array([1e6, 1e3, 1, 1e-3, 1e-6])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    found = {r["linear_ind"]: r["embedding"] for r in corr.svd_embed(table(spark, x).repartition(40), 5).collect()}
    got = np.array([found[i] for i in range(300)])
    assert np.allclose(np.abs(got), np.abs(u * s), rtol=1e-4)  # the square of the condition number would lose the last
    one = corr.svd_embed(table(spark, x[:3]), 2).collect()  # fewer rows than dimensions
    assert len(one) == 3 and len(one[0]["embedding"]) == 2
    assert corr.svd_embed(table(spark, x).where("false"), 2).collect() == []


def test_template_in_blocks(spark):
    rng = np.random.default_rng(5)
    q, t = rng.normal(size=(20, 4)), rng.normal(size=(9, 4))
    t[7] = t[2]  # equals go to the smaller id
    queries, template = table(spark, q, label=(F.col("linear_ind") % 3 - 1).cast("int")), table(spark, t, label=(F.col("linear_ind") % 3 - 1).cast("int"))
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
    for block in (4, 100):
        for r in evaluate.template_match(queries, template, block).collect():
            i = r["linear_ind"]
            assert r["template_ind"] == d[i].argmin() and r["conf"] == pytest.approx(np.exp(-d[i].min()) / np.exp(-d[i]).sum())
            assert r["agree"] == (i % 3 == d[i].argmin() % 3 and i % 3 != 0)


def test_crops_of_chunks(spark):
    """Crops at every place, edges and far outside too, whatever the chunks."""
    shape, target = (5, 7, 6), (3, 4, 4)
    rng = np.random.default_rng(6)
    volume = rng.normal(size=shape).astype("float32")
    centres = [(i, 0, *(float(v) for v in rng.uniform(-3, 10, 3))) for i in range(40)]
    det = spark.createDataFrame(centres, "linear_ind bigint, t int, z double, x double, y double")
    bounds = crops.crop_bounds(det, shape, target).withColumn("t", F.lit(0))
    volumes = spark.createDataFrame([(0, volume.ravel().tolist())], "t int, voxels array<float>")
    wanted = {}
    for r in bounds.collect():
        part = volume[r["z0"] : r["z1"], r["x0"] : r["x1"], r["y0"] : r["y1"]]
        full = np.zeros([r[f"pad{a}"] + n for a, n in zip("zxy", part.shape, strict=True)], dtype="float32")
        full[r["padz"] :, r["padx"] :, r["pady"] :] = part
        assert full.shape == target
        wanted[r["linear_ind"]] = full.ravel().tolist()
    for chunk in ((2, 3, 4), (5, 7, 6)):
        found = {r["linear_ind"]: r["voxels"] for r in crops.crop_voxels(bounds, crops.chunked(volumes, shape, chunk), shape, chunk, target).collect()}
        assert found == wanted
