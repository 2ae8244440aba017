"""Shared column expressions and lineage helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.checkpoints import cut, ensure_checkpoint_dir

#: ASCII white space, as every contract here defines it: a run of it separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def text_digest(text: Column) -> Column:
    """Lowercase SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows up to which decisions are broadcast (about 100 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def keep_rows(docs: DataFrame, key: Column, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, key, kept) keeps, with docs' own columns.

    Rows are told by doc_id and key, an expression over docs; where several are the same in both and
    one is kept, one stays. Only keys that lose rows are looked up: broadcast if they are few, else
    in a shuffled join.
    """
    losing = cut(
        # dealt anew, as what comes from a join on the key would keep its partitions, and a hot key in one task
        decisions.repartition("doc_id", "key")
        .groupBy("doc_id", "key")
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
        .where(~F.col("stays") | (F.col("n") > 1))
        .select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "stays")
    )
    n, n_repeated = losing.agg(F.count(F.lit(1)), F.count_if("stays")).first()
    # docs' columns travel as one, so that their names can't clash with those here
    met = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key.alias("key")).join(
        F.broadcast(losing) if n <= BROADCAST_ROWS else losing.hint("merge"),
        F.col("key").eqNullSafe(F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id")),
        "left",
    )
    kept = met.where(F.col("stays").isNull())
    if n_repeated:
        kept = kept.unionByName(met.where("stays").dropDuplicates(["id", "key"]))
    return kept.select("row.*")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch of texts, at most (or a single row): Spark's own bound is 64 MB, for each task at once.
BATCH_BYTES = 4 * 1024 * 1024
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_BYTES at most; a smaller setting stays."""
    now = int(spark.conf.get(_BATCH).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_memory: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """What a worker process remembers under a name; a worker serves many operators in turn, so those
    of other names forget theirs."""
    for other in _memory:
        if other != name and _memory[other]:
            _memory[other].clear()
    return _memory.setdefault(name, {})


def map_texts(docs: DataFrame, rate, schema: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 4_000_000) -> DataFrame:
    """Arrow batches of (id, text) through rate, a function of a list of ids and a list of texts that
    returns one Python list per column of schema. The id column is called doc_id and keeps its type.

    Rows reach rate in slices of about slice_chars characters, so that memory follows the longest
    text rather than the batch. Null text is the empty text, unless rate tells them apart itself:
    it gets None for null. An empty table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    out = StructType([*StructType().add("doc_id", kind).fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            chars = [0]
            for n in batch.column(2).to_pylist():
                chars.append(chars[-1] + (n or 0))
            lo = 0
            while lo < len(ids):
                hi = lo + 1
                while hi < len(ids) and chars[hi + 1] - chars[lo] <= slice_chars:
                    hi += 1
                columns = rate(ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                lo = hi

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.length(text).alias("n")).mapInArrow(run, out)
