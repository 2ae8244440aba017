"""A corpus from raw documents to token ids, in stages written as Parquet.

A stage takes (spark, docs, sf_dir), where docs has the columns of documents and maybe more, and
returns a DataFrame with docs' own columns, whatever they are called; the last one returns doc_id,
n_tokens and ids. An empty table goes through as an empty table. Null and empty texts are documents
like any other until mixing, which has no words to take from them. Texts of any length are dealt
with whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, exactdedup, mixing, ngramjoin, quality
from trackloom.llm.common import documents, shared_path
from trackloom.operators.checkpoints import remove

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score LEAST_QUALITY or more.

    The model learns from labels.parquet; without labels of both kinds every document has one score.
    A null text scores as an empty one. Repeated rows score alike and stay or go together; a null id
    only keeps a document from being learnt from.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(model) >= LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with equal normalised text: that of the smallest id, a null id last, and one
    where rows repeat in id and text. Null texts count as empty, so one of all these stays."""
    index = exactdedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))).create()
    try:
        return exactdedup.keep(docs, exactdedup.dedup(docs, index, "corpus"))
    finally:
        index.drop()  # the decisions are in the shared folder by now


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of similarity 0.8 connect, that of the smallest id. Texts
    without words are copies of each other; all others that link to none stay."""
    return ngramjoin.keep(docs, ngramjoin.join(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is used, with the words taken then. Documents
    without words are in no mix; null is a source of its own. Rows equal in id and text were brought
    to one by the stages before."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text of the mix; a row for each row of docs, repeated ones too.
    A null or empty text has no ids."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Learned scores, MinHash and merges by rank have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents, each written to the shared folder and read again. What a stage
    wrote is deleted once the next one is written; the last one's rows are the result."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
