import os
import re

import public_tokenizers

import corpus_pipeline
from trackloom.llm import bpe, ngramjoin

SF = "/root/testdata/sf0.001"


def test_stages(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus.columns
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in seen.items()}
    assert len(ids["quality classifier"]) > len(ids["exact dedup"]) >= len(ids["n-gram Jaccard join"]) > 0
    norm = [re.sub(r"\s+", " ", r["text"]) for r in seen["exact dedup"].collect()]
    assert len(norm) == len(set(norm))
    assert ngramjoin.join(seen["n-gram Jaccard join"]).where("n_links > 0").count() == 0
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(ids["quality classifier"])) >= 0.95 * len(good)
    coder = bpe.encoder(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    decoded = sorted((r["doc_id"], coder.decode(r["ids"]).decode()) for r in docs.collect())
    assert decoded == sorted((r["doc_id"], r["text"]) for r in seen["source mixing"].collect())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"]


def laid_out(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


LABELS = "doc_id bigint, quality int, toxic int"


def test_odd_rows_through_every_stage(spark, odd, tmp_path):
    """Without labels of both kinds all score alike, so the other stages meet every odd row."""
    sf = laid_out(spark, tmp_path, odd, spark.createDataFrame([(3, 1, 0), (None, 1, None), (4, None, 0)], LABELS))
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(sorted({r["doc_id"] or 0 for r in docs.collect()}))
        assert {r["kept"] for r in docs.collect()} == {"mine"}  # columns of the table's own
    assert left[0] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert left[1] == [0, 1, 3, 4, 5, 6, 7, 8, 9]  # 1 and 2 are both empty
    assert left[2] == [0, 1, 3, 6, 7, 8, 9]  # 4 has the words of 3; 5 has none, as 1
    assert set(left[3]) <= set(left[2]) and 1 not in left[3]  # documents without words are in no mix
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    coder = bpe.encoder(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, coder.decode(r["ids"]).decode()) for r in out.collect()) == sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())


def test_empty_table(spark, none, tmp_path):
    out = corpus_pipeline.run(spark, laid_out(spark, tmp_path, none, spark.createDataFrame([], LABELS)))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == 0


def test_only_the_last_stage_is_left_in_the_shared_folder(spark, none, tmp_path):
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    corpus_pipeline.run(spark, laid_out(spark, tmp_path, none, spark.createDataFrame([], LABELS))).count()
    new = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) - before
    assert [n.rsplit("-", 1)[0] for n in new if not n.startswith("rdd-")] == ["byte-level-BPE"]
