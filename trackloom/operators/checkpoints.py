"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's spark.checkpoint.dir. Where none is named, a temporary
    one serves a session that runs in one process; on a cluster, whose machines would not see each
    other's, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "trackloom-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: each input row is computed once,
    and a lost executor loses nothing. The files go when the DataFrame does, if the cluster cleans checkpoints."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """cut, for what one round makes for the next. A checkpoint keeps the estimate of its plan's size, a join's being the
    product of its sides': over rounds its digits multiply until they fill the driver. Here it is begun anew."""
    spark, held = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.javaRDD(), held._jdf.schema()), spark)


def within(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, written and counted: what is to go to one task or to the driver. More than most rows are an error."""
    df = cut(df)
    if (n := df.count()) > most:
        raise ValueError(f"{n} {what}; {most} are taken")
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads; a missing one is passed over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
