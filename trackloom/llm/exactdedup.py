"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest (map-side first) and meets the index in one sort-merge join, which reads the index once and
shuffles only the batch. The batch's side without a partner, the anti-join, is appended to the index;
the other digests bring the document that stays. Texts never shuffle.

Each append adds a file to every bucket, and Spark trusts the order of a bucket only while it is one
file; compact() makes it one again, so that a batch needs no sort of the index.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import cut, ensure_checkpoint_dir, keep_rows, text_digest
from trackloom.operators.checkpoints import remove

#: Lets Spark use the order of buckets that are one file each.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def ensure_shared_warehouse(master: str, warehouse: str, folder: str) -> None:
    """An index is of no use in a folder of one machine: on a cluster the warehouse must not be Spark's default
    one, under the driver's working folder."""
    clustered = master.startswith("local-cluster") or not master.startswith("local")
    if clustered and warehouse.removeprefix("file:").rstrip("/") == f"{folder.rstrip('/')}/spark-warehouse":
        raise RuntimeError("spark.sql.warehouse.dir must name a folder that the driver and all executors share")


def outside_folder(spark: SparkSession) -> str | None:
    """Where an index goes whose session has no warehouse that the cluster shares: the folder of checkpoints, which
    is shared. None where the warehouse will do; an error where no folder for checkpoints is named either."""
    try:
        ensure_shared_warehouse(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"), os.getcwd())
    except RuntimeError:
        return ensure_checkpoint_dir(spark)
    return None


@dataclass(frozen=True)
class DigestIndex:
    """A table of digests already seen: digest, keep_id (the document that stays for it), batch.

    buckets fixes the layout for good: take about one bucket per 50 million digests, 8 at least.
    id_type is the type of document ids, any that can be compared. The table belongs in a warehouse
    that the cluster shares; where there is none its files are in the folder of checkpoints and last as it does.
    """

    spark: SparkSession
    table: str
    buckets: int = 8
    id_type: str = "bigint"

    def create(self) -> "DigestIndex":
        """The table, made if it isn't there; a compaction that was broken off is brought to its end."""
        if not self.spark.catalog.tableExists(self.table):
            if self.spark.catalog.tableExists(self._next):
                self.spark.sql(f"ALTER TABLE {self._next} RENAME TO {self.table}")
            else:
                self._placed(self._writer(self.spark.createDataFrame([], f"digest string, keep_id {self.id_type}, batch string"))).saveAsTable(self.table)
        return self

    def rows(self) -> DataFrame:
        self.spark.conf.set(ORDERED, "true")
        return self.spark.read.table(self.table)

    def append(self, new: DataFrame) -> None:
        self._writer(new.select("digest", "keep_id", "batch")).mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self) -> None:
        """Each bucket as one sorted file; digests that batches run at once have both appended become one row."""
        kept = self.rows().groupBy("digest").agg(F.min(F.struct("keep_id", "batch")).alias("k")).select("digest", "k.*")
        self._drop(self._next)
        # dealt out as the buckets are, so that a bucket is one task's and one file
        self._placed(self._writer(kept.repartition(self.buckets, "digest"))).saveAsTable(self._next)
        self._drop(self.table)
        self.create()
        self.spark.catalog.refreshTable(self.table)

    def drop(self) -> None:
        for table in (self.table, self._next):
            self._drop(table)

    @property
    def _next(self) -> str:
        return f"{self.table}_next"

    def _placed(self, writer):
        """A new table's writer: outside the warehouse each has a folder of its own, as a renamed table keeps its."""
        folder = outside_folder(self.spark)
        return writer.option("path", f"{folder}/{self.table}-{uuid.uuid4().hex}") if folder else writer

    def _drop(self, table: str) -> None:
        """The table and its files, which Spark leaves where they are outside the warehouse."""
        if self.spark.catalog.tableExists(table):
            told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            self.spark.sql(f"DROP TABLE {table}")
            if told["Type"] == "EXTERNAL":
                remove(self.spark, told["Location"])

    def _writer(self, df: DataFrame):
        return df.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")


def dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the smallest id stays, unless an earlier batch holds the text:
    then none does and keep_id names the earlier document. group_size counts this batch's rows.
    Null text counts as empty. A null id loses to any other; rows equal in id and text are one
    document repeated, of which one row stays. An empty batch gives no rows and leaves the index alone.
    Other columns of docs are not read; long texts are hashed whole where they are read. Running a
    batch again under the same name gives the same rows: what that name appended still counts as its
    own. Batches under different names go one after the other; should two have run at once and both
    appended a digest, the row of the smaller id counts, here and in compact().
    """
    seen = cut(
        docs.select(F.col(id_col).cast(index.id_type).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # written, so that the join is not pushed below the aggregation, where all rows would shuffle
    groups = cut(seen.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.sum("copies").alias("group_size")))
    held = index.rows().select("digest", F.struct("keep_id", F.col("batch").alias("in_batch")).alias("held"))
    met = cut(
        groups.hint("merge").join(held, "digest", "left").groupBy("digest", "least_id", "group_size").agg(F.min("held").alias("held"))
    )
    new = F.col("held").isNull()  # the anti-join
    index.append(met.where(new).select("digest", F.col("least_id").alias("keep_id"), F.lit(batch).alias("batch")))
    decided = met.select(
        "digest",
        F.when(new, F.col("least_id")).otherwise(F.col("held.keep_id")).alias("keep_id"),
        "group_size",
        (new | (F.col("held.in_batch") == batch)).alias("fresh"),
    )
    # a digest of very many rows is split by AQE here: both sides are plain exchanges
    return seen.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"),
        F.col("digest").alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions keeps, with docs' own columns."""
    return keep_rows(docs, text_digest(F.col("text")), decisions.select("doc_id", F.col("text_sha256").alias("key"), "kept"))
