"""Training trials: logs, grids of parameters, best results."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.rounding import long_count
from trackloom.sources.configs import trial_number

#: The objective of a trial that has none.
FAILED = 1e6


def second_last(stats: DataFrame, value: str = "loss") -> DataFrame:
    """trial and the value of the last record but one; null with fewer than two records.

    The two greatest positions of a trial are kept while aggregating, so its log is never sorted or collected.
    """
    last = stats.groupBy("trial").agg(F.max("pos").alias("top"))
    at = stats.join(last, "trial").groupBy("trial").agg(F.max(F.when(F.col("pos") == F.col("top") - 1, F.col(value))).alias("val_loss"))
    return at


def discover(paths: DataFrame, anchored: bool = False) -> DataFrame:
    """trial: the distinct numbers of trial_<n> in path, in order."""
    return paths.select(trial_number(F.col("path"), anchored).alias("trial")).where("trial is not null").distinct().orderBy("trial")


def training_finished(stats: DataFrame, expected: int, at: str = "pos") -> DataFrame:
    """trial and whether its last record is the expected one."""
    return stats.groupBy("trial").agg((F.max(at) == expected).alias("finished"))


def join_projects(trials: DataFrame, projects: DataFrame) -> DataFrame:
    """trial and project: the number after the last _ of a project's name is its trial; the rest are left out."""
    numbered = projects.select("project", F.element_at(F.split("project", "_"), -1).try_cast("bigint").alias("trial"))
    return trials.join(numbered, "trial").select("trial", "project")


def param_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Every combination, one column per parameter."""
    names = list(values)
    row = spark.range(1).select(*[F.array(*[F.lit(v) for v in values[n]]).alias(n) for n in names])
    for n in names:
        row = row.withColumn(n, F.explode(n))
    return row


def one_at_a_time(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """param and value (as text), each parameter varied alone."""
    pairs = [F.struct(F.lit(n).alias("param"), F.lit(str(v)).alias("value")) for n, vs in values.items() for v in vs]
    return spark.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def repeated(trials: DataFrame, repetitions: int) -> DataFrame:
    return trials.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))


def loss_by_epoch(stats: DataFrame, records: int = 10) -> DataFrame:
    """trial, epoch and the sum of losses."""
    return stats.groupBy("trial", F.floor(F.col("pos") / records).cast("int").alias("epoch")).agg(F.sum("loss").alias("loss"))


def best_trial(results: DataFrame, objective: str = "val_loss") -> DataFrame:
    """The trial of least objective; missing and NaN count as FAILED, the smallest trial of equals."""
    value = F.coalesce(F.nanvl(F.col(objective), F.lit(FAILED)), F.lit(FAILED))
    best = F.min(F.struct(value.alias("v"), F.col("trial"))).alias("b")
    return results.agg(best).select(F.col("b.trial").alias("trial"), F.col("b.v").alias(objective))


def summary(stats: DataFrame, configs: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """trial, k, val_loss, n: configuration, objective and number of records; with accuracy (trial,
    accuracy) of the trials that were tracked, that too, null for the others."""
    counts = stats.groupBy("trial").agg(long_count().alias("n"))
    rows = second_last(stats).join(configs, "trial", "left").join(counts, "trial", "left").select("trial", "k", "val_loss", "n")
    return rows if accuracy is None else rows.join(accuracy.select("trial", "accuracy"), "trial", "left")


def learning_rate(step: Column, warmup: int, total: int, base: float) -> Column:
    """Linear warm-up to base, then a cosine down to a thousandth of it."""
    q = 0.5 * (1 + F.cos(F.lit(pi) * (step - warmup) / (total - warmup)))
    return F.when(step < warmup, base * step / warmup).otherwise(base * q + base * 0.001 * (1 - q))


def split_model_name(names: DataFrame) -> DataFrame:
    """model, lab (the part after the last _) and prefix (all before it)."""
    parts = F.split("model", "_")
    return names.select("model", F.element_at(parts, -1).alias("lab"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_").alias("prefix"))
