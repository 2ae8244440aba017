"""Tables of a tracking project: scans, sinks and stage files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of embeddings, as many as a chunk of the array format that such projects use.
EMBEDDING_FILE_ROWS = 10_000


@dataclass(frozen=True)
class Catalog:
    """Parquet tables in one directory: detections, embeddings, tracks, trials."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str, frame: int | None = None) -> DataFrame:
        """A table; with frame, only that frame's partition is read where the table is partitioned by t."""
        df = self.spark.read.parquet(self.path(name))
        return df if frame is None else df.where(F.col("t") == frame)

    def exists(self, name: str) -> bool:
        return self._written(self.path(name))

    def write(self, name: str, df: DataFrame, by_frame: bool = False) -> DataFrame:
        """df written over the table of that name, in partitions by t if by_frame, and read again."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy("t") if by_frame else writer).parquet(self.path(name))
        return self.read(name)

    def write_embeddings(self, df: DataFrame, name: str = "embeddings") -> DataFrame:
        """Embeddings in order of linear_ind, so that ranges of it prune files."""
        df.repartitionByRange("linear_ind").sortWithinPartitions("linear_ind").write.mode("overwrite").option("maxRecordsPerFile", EMBEDDING_FILE_ROWS).parquet(self.path(name))
        return self.read(name)

    def _bucket_table(self, name: str, buckets: int) -> tuple[str, str]:
        """Name and folder of a table in so many buckets; the number is in both, as it fixes the layout."""
        path = f"{self.root}/{name}.by_t_{buckets}.parquet"
        return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}", path

    def write_bucketed(self, name: str, df: DataFrame, buckets: int) -> DataFrame:
        """df in buckets by t, each one file, in order of t, so that what is done by frame needs no shuffle. A table
        of that name and number of buckets is replaced; df must not read it."""
        table, path = self._bucket_table(name, buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        writer = df.repartition(buckets, "t").write.format("parquet").mode("overwrite")
        writer.bucketBy(buckets, "t").sortBy("t").option("path", path).saveAsTable(table)
        return self.spark.read.table(table)

    def read_bucketed(self, name: str, buckets: int) -> DataFrame:
        """A table of write_bucketed, also by a session whose catalogue does not know it: the files tell their buckets."""
        table, path = self._bucket_table(name, buckets)
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (t) SORTED BY (t) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.read.table(table)

    def stage_bucketed(self, name: str, make: Callable[[], DataFrame], buckets: int) -> DataFrame:
        """As stage, in buckets by t: a run that starts again finds what was written whole, and its layout."""
        _, path = self._bucket_table(name, buckets)
        return self.read_bucketed(name, buckets) if self._written(f"{path}/_SUCCESS") else self.write_bucketed(name, make(), buckets)

    def _written(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table if an earlier run has written it, else made, written and read."""
        return self.read(name) if self.exists(name) else self.write(name, make())


def clone(source: Catalog, target: Catalog, names: list[str]) -> list[str]:
    """The named tables of a project copied to another; those that are there already stay, and the
    copied ones are returned. A table that the source lacks is passed over."""
    new = [n for n in names if source.exists(n) and not target.exists(n)]
    for n in new:
        target.write(n, source.read(n))
    return new


def null_for_missing(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes null, as missing values come from outside as NaN."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})
