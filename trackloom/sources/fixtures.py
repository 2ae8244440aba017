"""Deterministic tracking tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUNS = 5


def _dim(i: int):
    return F.element_at("embedding", i).cast("double")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linear_ind, t and x, the embedding in doubles."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return raw.select(
        F.col("vec_id").alias("linear_ind"), F.floor(F.col("vec_id") / 10).cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("x")
    )


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        v.alias("linear_ind"),
        F.floor(v / 10).cast("int").alias("t"),
        (v % 10).cast("int").alias("raw_neuron_ind"),
        (v % 10 + 1).cast("int").alias("raw_seg_id"),
        (F.col("label") + 1).alias("gt_label"),
        ((1 + _dim(1)) / 2).alias("likelihood"),
        (8 + 8 * _dim(2)).alias("z"),
        (64 + 64 * _dim(3)).alias("x"),
        (64 + 64 * _dim(4)).alias("y"),
    )


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("gt_label", "t").orderBy(F.desc("likelihood"), "linear_ind")
    best = det(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select(F.col("gt_label").alias("name"), "t", "raw_neuron_ind", "raw_seg_id", "linear_ind", "likelihood", "z", "x", "y")


def renamed(name):
    """The name that pred gives to a name of gt."""
    return (1 + ((name - 1) * 3) % 10).cast("int")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("linear_ind") % 13 == 0, (F.col("raw_seg_id") % 10 + 1).cast("int")).otherwise(F.col("raw_seg_id"))
    return gt(spark, sf_dir).where("linear_ind % 11 <> 0").select(renamed(F.col("name")).alias("name"), "t", wrong.alias("raw_seg_id"), "likelihood")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gt_name to pred_name, as planted."""
    return gt(spark, sf_dir).select(F.col("name").alias("gt_name"), renamed(F.col("name")).alias("pred_name")).distinct()


def labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.explode(F.array(*[F.lit(r) for r in range(RUNS)]))
    rows = det(spark, sf_dir).select("*", runs.alias("run")).where((F.col("linear_ind") + F.col("run")) % 7 != 0)
    flipped = (F.col("linear_ind") * 3 + F.col("run")) % 17 == 0
    label = F.when(flipped, 1 + (F.col("gt_label") + F.col("run")) % 10).otherwise(1 + (F.col("gt_label") - 1 + F.col("run")) % 10)
    return rows.select("run", "linear_ind", "t", label.cast("int").alias("label"), (0.5 + 0.5 * F.col("likelihood")).alias("prob"))


def unrotated(label, run):
    return (1 + (label - 1 - run + 10) % 10).cast("int")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("trial"), (F.row_number().over(w) - 1).cast("int").alias("pos"), F.col("value").alias("loss")
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node and parent (null at the root) of a binary tree whose leaves, in order, are the points: of n
    points the nodes are 0 to 2 n - 2 and the leaves the last n."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    inner = ids.crossJoin(F.broadcast(n)).where("node < n - 1").select((F.col("node") + F.col("n")).alias("node"))  # one row
    parent = F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 2)).cast("int")
    return ids.union(inner).select(F.col("node").cast("int").alias("node"), parent.alias("parent"))
