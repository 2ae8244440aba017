"""Fuzzy neighbour graphs, and coordinates of points by the leading directions of such a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.checkpoints import cut

#: Halvings of the range that holds a point's scale.
HALVINGS = 64


def _scale(far: Column, rho: Column, target: Column) -> Column:
    """sigma with sum exp(-max(d - rho, 0) / sigma) = target over an array of distances, by halving.

    Until the sum is over the target the range has no upper end, and the guess doubles.
    """
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))

    def step(s: Column, _: Column) -> Column:
        total = F.aggregate(far, F.lit(0.0), lambda acc, d: acc + F.exp(-F.greatest(d - rho, F.lit(0.0)) / s["mid"]))
        over = total > target
        lo, hi = F.when(over, s["lo"]).otherwise(s["mid"]), F.when(over, s["mid"]).otherwise(s["hi"])
        mid = F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step)["mid"]


def fuzzy_scales(neighbours: DataFrame) -> DataFrame:
    """src, rho, sigma of nearest neighbours (src, dst, dist, rk; each point its own first).

    rho is the distance to the nearest other point that is not the same; sigma the scale at which the
    weights of a point's k neighbours, itself not counted, add up to log2 k. A sigma is a thousandth of the
    mean distance at least. A point without others has rho and sigma 0.
    """
    # k distances of a point
    held = neighbours.where("src <> dst").groupBy("src").agg(F.sort_array(F.collect_list("dist")).alias("far"), F.avg("dist").alias("mean"))
    rho = F.coalesce(F.get(F.filter("far", lambda d: d > 0), 0), F.lit(0.0))
    held = held.withColumn("rho", rho).withColumn("sigma", _scale(F.col("far"), F.col("rho"), F.log2(F.size("far") + F.lit(1.0))))
    every = neighbours.select("src").distinct().join(held, "src", "left")
    return every.select("src", F.coalesce("rho", F.lit(0.0)).alias("rho"), F.coalesce(F.greatest("sigma", F.col("mean") / 1000), F.lit(0.0)).alias("sigma"))


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """src, dst, w of both directions of the union of all points' fuzzy neighbourhoods: a + b - a b of the weights that two
    points have for each other. Points that are the same weigh 1."""
    scales = fuzzy_scales(neighbours)
    one = neighbours.where("src <> dst").select("src", "dst", "dist").join(scales, "src")
    far = F.col("dist") - F.col("rho")
    w = F.when((far <= 0) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(F.exp(-far / F.col("sigma")))
    one = cut(one.select("src", "dst", w.alias("w")))
    both = one.withColumn("back", F.lit(0.0)).unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.col("w").alias("back")))
    a, b = F.max("w"), F.max("back")
    return both.groupBy("src", "dst").agg((a + b - a * b).alias("w"))


def spectral_layout(graph: DataFrame, dimensions: int, rounds: int = 40, every: int = 4, seed: int = 0) -> DataFrame:
    """node, x (array<double>): coordinates by the leading directions of the graph (src, dst, w) over the
    roots of its degrees, the first of which, equal for all but for degrees, is left out.

    Directions come from repeated products of the graph with a few columns, which are made orthonormal
    by their products with one another: only a matrix of dimensions by dimensions goes through the
    driver. Scaled so that a direction's mean square is 1; each has a positive first entry at the
    greatest one. Nodes without edges are left out.
    """
    import numpy as np

    width = dimensions + 1
    degree = cut(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")))
    of = lambda side: degree.select(F.col("node").alias(side), F.sqrt("degree").alias(f"root_{side}"))
    scaled = cut(graph.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", (F.col("w") / F.col("root_src") / F.col("root_dst")).alias("w")))
    n = degree.count()
    begin = [F.sqrt("degree"), *((F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(2001)) - 1000) / 1000.0 for i in range(1, width))]
    state = degree.select("node", F.array(*begin).alias("x"))

    def orthonormal(rows: DataFrame) -> DataFrame:
        pairs = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(width) for j in range(i + 1)]
        gram = np.zeros((width, width))
        gram[np.tril_indices(width)] = [v or 0.0 for v in rows.agg(*pairs).first()]
        gram = gram + np.tril(gram, -1).T
        turn = np.linalg.pinv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(width))).T
        return rows.select("node", F.array(*[sum((F.col("x")[j] * float(turn[j, i]) for j in range(width)), F.lit(0.0)) for i in range(width)]).alias("x"))

    for turn in range(rounds if n else 0):
        met = scaled.join(state, F.col("dst") == F.col("node")).groupBy("src").agg(*(F.sum(F.col("w") * F.col("x")[i]).alias(f"x{i}") for i in range(width)))
        # half of the columns themselves added, so that the most positive directions win over the most negative
        both = state.join(met, F.col("node") == F.col("src")).select("node", F.array(*((F.col("x")[i] + F.col(f"x{i}")) / 2 for i in range(width))).alias("x"))
        state = both if (turn + 1) % every else orthonormal(cut(both))
    if not n:
        return state.select("node", F.slice("x", 2, dimensions).alias("x"))
    state = cut(orthonormal(cut(state)))
    tops = state.agg(*(F.max_by(F.col("x")[i], F.abs(F.col("x")[i])) for i in range(1, width))).first()
    signs = [-1.0 if (v or 0) < 0 else 1.0 for v in tops]
    return state.select("node", F.array(*(F.col("x")[i] * signs[i - 1] * float(np.sqrt(n)) for i in range(1, width))).alias("x"))
