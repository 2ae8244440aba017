"""Per-track state on a stream."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import cluster
from trackloom.streaming import tracks


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, folder):
    stream = spark.readStream.schema("label int, t int").parquet(f"{folder}/in")
    q = tracks.track_states(stream, 5).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(tracks.TRACK).parquet(f"{folder}/out").collect())


def test_state_survives_a_restart_and_tracks_are_lost(rocks, tmp_path):
    put = lambda rows: rocks.createDataFrame(rows, "label int, t int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, 0), (1, 1), (2, 0), (-1, 1), (None, 1)])
    assert run(rocks, tmp_path) == [(1, "seen", 0, 0, 1, 0), (1, "seen", 1, 0, 2, 1), (2, "seen", 0, 0, 1, 0)]
    put([(1, 3), (1, 12), (3, 20)])
    after = run(rocks, tmp_path)  # a new query over the same state
    assert (1, "seen", 3, 0, 3, 2) in after and (1, "lost", 3, 0, 3, None) in after and (1, "seen", 12, 12, 1, 0) in after
    put([(3, 21)])
    last = run(rocks, tmp_path)
    assert (2, "lost", 0, 0, 1, None) in last  # by its timer: it was never seen again
    assert (3, "seen", 21, 20, 2, 1) in last and not [r for r in last if r[0] == 3 and r[1] == "lost"]


def test_predicted_stream_equals_the_batch(spark, tmp_path):
    from test_density import blobs, table

    x = blobs(7)
    points = table(spark, x).withColumns({"t": (F.col("linear_ind") % 4).cast("int"), "raw_neuron_ind": F.lit(0), "likelihood": F.lit(0.5)})
    some = points.where("t < 3")
    model = cluster.fitted(some, 6, 3).join(some.select("linear_ind", "x"), "linear_ind").cache()
    points.where("t = 3").select("linear_ind", "t", "raw_neuron_ind", "likelihood", "x").repartition(3).write.parquet(str(tmp_path / "in"))
    tracks.assign_labels(tracks.detections(spark, str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination()
    batch = sorted(map(tuple, cluster.approximate_predict(points.where("t = 3"), model, 3).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("linear_ind", "label", "likelihood").collect())) == batch
    assert len({r[1] for r in batch}) > 2
