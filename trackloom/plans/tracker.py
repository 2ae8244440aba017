"""From embeddings to tracks, in four ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.hdbscan import sizes_for
from trackloom.operators import assign, cluster, evaluate, frames, graph, layout, sync
from trackloom.operators.checkpoints import cut, within

#: Tracks of all windows that one task names, at most.
WINDOW_TRACKS = 4_000_000
MODES = ("global", "overlapping_windows", "streaming", "label_propagation")


@dataclass
class Tracker:
    """points: linear_ind, t, raw_neuron_ind, likelihood, x. Tracks are name, t, raw_neuron_ind."""

    points: DataFrame
    n_frames: int
    cluster_size: float = 0.5
    samples: float = 0.02
    neighbours: int = 20
    steps: int = 100
    seeds: int = 100
    window: int = 120
    fitted_frames: int = 120
    least_share: float = 0.1
    over_chance: float = 1.1
    #: Dimensions of a layout by the fuzzy neighbour graph that the global mode clusters, 0 for the points themselves.
    layout_dimensions: int = 0
    layout_neighbours: int = 10

    def track(self, mode: str) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode {mode!r}; known: {', '.join(MODES)}")
        return getattr(self, f"_{mode}")()

    def _tracks(self, labels: DataFrame) -> DataFrame:
        rows = self.points.drop("likelihood").join(labels.select("linear_ind", "label", "prob"), "linear_ind").withColumnRenamed("prob", "likelihood")
        return assign.best_per_cell(rows).withColumn("name", F.col("name") + 1)

    def _global(self) -> DataFrame:
        points = self.points
        if self.layout_dimensions:
            fuzzy = layout.fuzzy_graph(graph.knn(points, self.layout_neighbours))
            points = layout.spectral_layout(fuzzy, self.layout_dimensions).withColumnRenamed("node", "linear_ind")
        return self._tracks(cluster.hdbscan_labels(points, *sizes_for(self.n_frames, self.cluster_size, self.samples)))

    def _streaming(self) -> DataFrame:
        """Fitted on evenly spaced frames; the objects of other frames are predicted from that fit."""
        fitted_frames = min(self.fitted_frames, self.n_frames)
        chosen = frames.evenly_spaced(self.points, fitted_frames)
        some = self.points.join(chosen, "t", "left_semi")
        size, samples = sizes_for(fitted_frames, self.cluster_size, self.samples)
        model = cut(cluster.fitted(some, size, samples).join(some.select("linear_ind", "x"), "linear_ind"))
        rest = cluster.approximate_predict(self.points.join(chosen, "t", "left_anti"), model, samples)
        labels = model.select("linear_ind", "label", "prob").unionByName(rest)
        return self._tracks(labels.where("label >= 0"))

    def _label_propagation(self) -> DataFrame:
        """Labels of several seed frames spread over one neighbour graph, then synchronised. A label counts
        where its share is least_share or more and over_chance times that of chance among its frame's objects."""
        n = min(self.seeds, self.n_frames // 2)
        chosen = [r["t"] for r in frames.hashed_sample(self.points.select("t").distinct(), "t", n).collect()]
        edges = graph.knn(self.points, self.neighbours)
        seeds = cut(graph.seed_labels(self.points, chosen))
        least = seeds.groupBy("run").agg(F.greatest(F.lit(self.least_share), self.over_chance / F.count(F.lit(1))).alias("least"))
        sure = graph.seed_shares(edges, seeds, self.steps).join(F.broadcast(least), "run").where("p >= least")  # one row per run
        labelings = sure.select("run", F.col("node").alias("linear_ind"), "label", F.col("p").alias("prob")).join(self.points.select("linear_ind", "t"), "linear_ind")
        return self._tracks(sync.spectral_sync(labelings, self.points))

    def _overlapping_windows(self) -> DataFrame:
        """Each window is clustered alone. Windows that follow one another are matched by most cells in
        common, all in one job; a chain of matches that reaches the base, the window of most tracks, has
        the base's name, any other a new one. Each cell goes to the name of most windows."""
        window = min(self.window, self.n_frames)
        # a window of all frames is the only one and holds the last frame too
        dealt = frames.overlapping_windows(self.points, window) if window < self.n_frames else self.points.withColumn("start", F.lit(0))
        labels = cluster.hdbscan_labels(dealt, *sizes_for(window, self.cluster_size, self.samples), by="start").where("label >= 0")
        cells = cut(dealt.select("start", "linear_ind", "t").join(labels, ["start", "linear_ind"]))
        names = window_names(cells)
        votes = evaluate.mode_vote(cells.join(names, ["start", "label"]).select("linear_ind", F.col("name").alias("label")))
        return self._tracks(votes.select("linear_ind", (F.col("label") - 1).alias("label"), F.col("n").cast("double").alias("prob")))


def window_names(cells: DataFrame) -> DataFrame:
    """start, label, name of clustered windows: cells (start, label, linear_ind).

    Only the table of windows and labels, counted first, goes to one task. Names are numbered from 1,
    the base's labels first, then chains by their first window and label.
    """
    tracks = cells.groupBy("start", "label").agg(F.count(F.lit(1)).alias("size"))
    starts = cells.select("start").distinct()
    follow = starts.withColumn("next", F.lead("start").over(W.orderBy("start"))).where("next is not null")  # a row per window
    one = cells.select("start", F.col("label").alias("gt_name"), "linear_ind").join(follow, "start")
    two = cells.select(F.col("start").alias("next"), F.col("label").alias("pred_name"), "linear_ind")
    counts = one.join(two, ["next", "linear_ind"]).groupBy("start", "next", "gt_name", "pred_name").agg(F.count(F.lit(1)).alias("n"))
    met = evaluate.solve_matching(counts.drop("next"), by="start").join(follow, "start")
    rows = tracks.select("start", "label", F.lit(None).cast("int").alias("next"), F.lit(None).cast("int").alias("to")).unionByName(
        met.select("start", F.col("gt_name").alias("label"), "next", F.col("pred_name").alias("to"))
    )

    def solve(pdf):
        import pandas as pd

        nodes = sorted(pdf.loc[pdf.next.isna(), ["start", "label"]].itertuples(index=False, name=None))
        onward = {(s, a): (int(n), int(b)) for s, a, n, b in pdf[pdf.next.notna()].itertuples(index=False, name=None)}
        sizes = pd.Series([s for s, _ in nodes]).value_counts()
        base = min(sizes.index, key=lambda s: (-sizes[s], s)) if len(nodes) else None
        chain_of, chains = {}, []
        for node in nodes:  # the first node of a chain comes before the others
            if node not in chain_of:
                chains.append([])
                while node is not None:
                    chain_of[node] = len(chains) - 1
                    chains[-1].append(node)
                    node = onward.get(node)
        in_base = {c: label for (start, label), c in chain_of.items() if start == base}
        order = sorted(range(len(chains)), key=lambda c: (c not in in_base, in_base.get(c, 0), c))
        name = {c: i + 1 for i, c in enumerate(order)}
        return pd.DataFrame([(s, a, name[c]) for (s, a), c in chain_of.items()], columns=["start", "label", "name"])

    return within(rows, WINDOW_TRACKS, "tracks of windows").groupBy(F.lit(1).alias("all")).applyInPandas(solve, "start int, label int, name int")
