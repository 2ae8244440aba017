"""Stages in buckets by frame: the same rows, no shuffle for what is done by frame, and resumption."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import evaluate, sync
from trackloom.operators.checkpoints import remove
from trackloom.plans import catalogue
from trackloom.sources import fixtures
from trackloom.sources.tables import Catalog

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def planned(spark):
    """Plans as they are made first, before any run."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_by_frame_without_a_shuffle(planned, tmp_path):
    project = Catalog(planned, str(tmp_path))
    labelings, aligned, det = fixtures.labelings(planned, SF), catalogue._aligned(planned, SF), fixtures.det(planned, SF)
    kept = {name: project.write_bucketed(name, df, 4) for name, df in (("labelings", labelings), ("aligned", aligned), ("det", det))}
    votes = sync.fuse_labels(kept["labelings"], 5)
    rated = evaluate.accuracy(kept["aligned"], "t")
    assert shuffles(votes) == 0 and shuffles(sync.fuse_labels(labelings, 5)) > 0
    assert shuffles(rated) == 0 and shuffles(evaluate.accuracy(aligned, "t")) > 0
    near = evaluate.nearest_distance(kept["det"])
    assert shuffles(near) < shuffles(evaluate.nearest_distance(det))  # pairs of blocks of a frame still are dealt out
    assert {tuple(r) for r in rated.collect()} == {tuple(r) for r in evaluate.accuracy(aligned, "t").collect()}
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in evaluate.nearest_distance(det).collect()}


def test_a_later_run_finds_the_stage(planned, tmp_path):
    project, made = Catalog(planned, str(tmp_path)), []

    def make(rows=((0, 1.5), (1, None), (None, 2.0), (1, None))):
        made.append(1)
        return planned.createDataFrame(list(rows), "t int, `a value` double")

    first = project.stage_bucketed("s", make, 3)
    wanted = sorted(map(str, first.collect()))
    table, path = project._bucket_table("s", 3)
    planned.sql(f"DROP TABLE {table}")  # as for a session that starts anew
    again = project.stage_bucketed("s", make, 3)
    assert len(made) == 1 and sorted(map(str, again.collect())) == wanted and again.count() == 4
    assert shuffles(again.groupBy("t").agg(F.count("*"))) == 0
    remove(planned, f"{path}/_SUCCESS")  # a write that was broken off is made anew
    planned.sql(f"DROP TABLE {table}")
    assert project.stage_bucketed("s", lambda: make([(7, 0.5)]), 3).collect() == [(7, 0.5)] and len(made) == 2
    assert project.stage_bucketed("s", make, 2).count() == 4 and project.read_bucketed("s", 3).count() == 1
    none = project.write_bucketed("none", make([]), 3)
    assert none.count() == 0 and none.columns == ["t", "a value"]
