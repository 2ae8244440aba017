import hashlib
import os
import pathlib
import re
import subprocess
import sys
import uuid
from collections import Counter, defaultdict

import pytest

from trackloom.llm import exactdedup
from trackloom.llm.queries import op4_exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    return {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.fixture
def index(spark):
    made = exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 3).create()
    yield made
    made.drop()


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, texts):
    rows = op4_exact_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in rows} == plain(texts.items()) and len(rows) == len(texts)


def test_batches_meet_the_index(spark, index):
    kind = "doc_id bigint, text string"
    first = exactdedup.dedup(spark.createDataFrame([(5, "a b"), (6, "c")], kind), index, "one")
    assert got(first) == [(5, 5, 1, True), (6, 6, 1, True)]
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], kind)
    want = [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert got(exactdedup.dedup(second, index, "two")) == want
    assert got(exactdedup.dedup(second, index, "two")) == want  # run again
    assert index.rows().count() == 3
    detail = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {index.table}").collect()}
    assert detail["Num Buckets"] == "3" and "digest" in detail["Bucket Columns"] and "digest" in detail["Sort Columns"]


def test_index_side_of_the_anti_join_is_not_shuffled(spark, index):
    new = spark.createDataFrame([("x",)], "digest string")
    plan = new.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def files_of_a_bucket(spark, index):
    names = [r[0].rsplit("_", 1)[1].split(".")[0] for r in index.rows().selectExpr("_metadata.file_name").distinct().collect()]
    return max(Counter(names).values())


def test_compaction_makes_one_file_of_a_bucket_and_spares_the_sort(spark, index):
    kind = "doc_id bigint, text string"
    for k in range(3):
        exactdedup.dedup(spark.createDataFrame([(i, f"text {i}") for i in range(40 * k, 40 * k + 60)], kind), index, f"b{k}")
    before = sorted(map(tuple, index.rows().select("digest", "keep_id", "batch").collect()))
    assert files_of_a_bucket(spark, index) > 1 and len(before) == 140
    index.compact()
    assert files_of_a_bucket(spark, index) == 1
    assert sorted(map(tuple, index.rows().select("digest", "keep_id", "batch").collect())) == before
    new = spark.createDataFrame([("x",)], "digest string").hint("merge")
    plan = new.join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort ") - plan.count("SortMergeJoin ") <= 1 and plan.count("Exchange hashpartitioning") == 1
    assert got(exactdedup.dedup(spark.createDataFrame([(7, "text 100"), (8, "new")], kind), index, "later")) == [(7, 100, 1, False), (8, 8, 1, True)]


def test_broken_off_compaction_is_ended(spark, index):
    exactdedup.dedup(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), index, "b")
    spark.sql(f"ALTER TABLE {index.table} RENAME TO {index.table}_next")  # the old table is gone, the new one not yet named
    assert [r["keep_id"] for r in index.create().rows().collect()] == [1]


def test_digests_appended_twice_do_not_multiply_rows(spark, index):
    docs = spark.createDataFrame([(4, "a"), (9, "a")], "doc_id bigint, text string")
    exactdedup.dedup(docs, index, "one")
    (row,) = index.rows().collect()
    index.append(spark.createDataFrame([(row["digest"], 2, "at once")], "digest string, keep_id bigint, batch string"))
    late = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id bigint, text string")
    assert got(exactdedup.dedup(late, index, "three")) == [(5, 2, 1, False), (6, 6, 1, True)]
    index.compact()
    assert sorted(r["keep_id"] for r in index.rows().collect()) == [2, 6]


def test_ids_that_are_no_numbers(spark):
    made = exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 2, "string").create()
    try:
        rows = exactdedup.dedup(spark.createDataFrame([("u/b", "x"), ("u/a", "x"), ("u/c", None)], "doc_id string, text string"), made, "b")
        assert got(rows) == [("u/a", "u/a", 2, True), ("u/b", "u/a", 2, False), ("u/c", "u/c", 1, True)]
    finally:
        made.drop()


def test_odd_rows(odd, none, index):
    decisions = exactdedup.dedup(odd, index, "b")
    rows = got(decisions)
    assert len(rows) == odd.count()
    assert [r for r in rows if r[0] == 3] == [(3, 3, 2, False), (3, 3, 2, True)]  # a trailing space sets 4 apart
    assert [(r[0], r[3]) for r in rows if r[2] == 2 and r[0] in (1, 2)] == [(1, True), (2, False)]
    assert (None, None, 1, True) in rows
    kept = exactdedup.keep(odd, decisions)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert exactdedup.dedup(none, index, "c").count() == 0


def test_an_index_needs_a_warehouse_that_is_shared():
    for master in ("local[4]", "local"):
        exactdedup.ensure_shared_warehouse(master, "file:/work/spark-warehouse", "/work")
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        exactdedup.ensure_shared_warehouse(master, "hdfs://host/warehouse", "/work")
        exactdedup.ensure_shared_warehouse(master, "file:/shared/spark-warehouse", "/work")
        with pytest.raises(RuntimeError):
            exactdedup.ensure_shared_warehouse(master, "file:/work/spark-warehouse/", "/work")


def test_an_index_goes_to_the_checkpoints_where_the_warehouse_is_not_shared(spark, monkeypatch):
    def refused(*_):
        raise RuntimeError

    monkeypatch.setattr(exactdedup, "ensure_shared_warehouse", refused)
    made = exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 3).create()
    try:
        kind = "doc_id bigint, text string"
        for k in range(3):
            exactdedup.dedup(spark.createDataFrame([(i, f"text {i}") for i in range(40 * k, 40 * k + 60)], kind), made, f"b{k}")
            made.compact()
        assert made.rows().count() == 140 and files_of_a_bucket(spark, made) == 1
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        folders = lambda: [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().startswith(made.table)]
        assert len(folders()) == 1  # of the tables before compaction nothing is left
    finally:
        made.drop()
    assert folders() == []


_CLUSTER = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
s = s.config("spark.checkpoint.dir", os.getcwd() + "/shared").getOrCreate()
print("rows", __spark_entry__.queries()["digest_index_batches"](s, "/root/testdata/sf0.001").count())
s.stop()
"""


def test_batches_run_on_a_cluster_with_a_default_warehouse(tmp_path):
    (tmp_path / "run.py").write_text(_CLUSTER)
    root = str(pathlib.Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
