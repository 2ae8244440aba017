"""Detections as a stream: labels from fitted points, and the best detection of each cell so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.operators import cluster

DETECTION = "linear_ind bigint, t int, raw_neuron_ind int, likelihood double, x array<double>"


def detections(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(DETECTION).parquet(path)


def assign_labels(stream: DataFrame, fitted: DataFrame, table: str, checkpoint: str, min_samples: int | None = None) -> StreamingQuery:
    """Each batch's detections take a label and are written to table/batch=<n>; a batch that is run
    again overwrites what it wrote.

    With min_samples, fitted is cluster.fitted's result with x, and a label comes from
    cluster.approximate_predict: -1 where no cluster is dense enough; likelihood is then its
    probability. Without, it is the label of the nearest fitted point.
    """

    def write(batch: DataFrame, number: int) -> None:
        points = batch.select("linear_ind", "x")
        if min_samples is None:
            rows = batch.drop("x").join(cluster.nn_label_assign(points, fitted), "linear_ind")
        else:
            labels = cluster.approximate_predict(points, fitted, min_samples).withColumnRenamed("prob", "likelihood")
            rows = batch.drop("x", "likelihood").join(labels, "linear_ind")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Seconds of frame 0: the watermark begins at 0, and what is not after it is late.
START = 86_400
TRACK = "name int, event string, t int, first int, n bigint, gap int"


def _track_states(patience: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class TrackStates(StatefulProcessor):
        """first and last frame and detections of the track that is open under a name."""

        def init(self, handle):
            self.handle = handle
            self.open = handle.getValueState("open", "first int, last int, n bigint")

        def handleInputRows(self, key, rows, timerValues):
            frames = sorted(t for pdf in rows for t in pdf["t"].tolist())
            out = []
            for t in frames:
                held = tuple(self.open.get()) if self.open.exists() else None
                if held and t - held[1] > patience:
                    out.append((key[0], "lost", held[1], held[0], held[2], None))
                    held = None
                first, last, n = held or (t, t, 0)
                self.open.update((min(first, t), max(last, t), n + 1))
                out.append((key[0], "seen", t, min(first, t), n + 1, t - last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((self.open.get()[1] + patience + 1 + START) * 1000)
            yield self._frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            first, last, n = self.open.get()
            self.open.clear()
            yield self._frame([(key[0], "lost", last, first, n, None)])

        def _frame(self, rows):
            return pd.DataFrame(rows, columns=["name", "event", "t", "first", "n", "gap"]).astype({"name": "int32", "t": "int32", "first": "int32", "n": "int64", "gap": "Int32"})

        def close(self):
            pass

    return TrackStates()


def track_states(labelled: DataFrame, patience: int) -> DataFrame:
    """name, event, t, first, n, gap of a stream (or table) of label and t: an event `seen` for each
    detection, with the track's first frame, detections so far and frames since the one before, and an
    event `lost` for a track that had none for over `patience` frames; a later one opens a new track.

    A name's state is three numbers under its key, and a timer finds tracks that end without another
    detection. Frames are event times, a second each: detections over patience frames behind the
    latest batch's are late and left out. Noise and unlabelled detections open no track. Needs the RocksDB state store.
    """
    rows = labelled.where("label is not null and label <> -1").select(F.col("label").cast("int").alias("name"), "t", F.timestamp_seconds(F.col("t") + START).alias("at"))
    timed = rows.withWatermark("at", f"{patience} seconds").groupBy("name")
    return timed.transformWithStateInPandas(_track_states(patience), TRACK, "append", "eventTime")


def best_so_far(labelled: DataFrame) -> DataFrame:
    """name, t, raw_neuron_ind, likelihood of each cell's likeliest detection, the first of equals; for
    a stream in update mode, whose state has one row per cell. Frames are not event times: no cell is ever late."""
    best = F.min(F.struct((-F.col("likelihood")).alias("m"), "linear_ind", "raw_neuron_ind", "likelihood")).alias("b")
    return labelled.where("label <> -1").groupBy(F.col("label").alias("name"), "t").agg(best).select("name", "t", "b.raw_neuron_ind", "b.likelihood")
