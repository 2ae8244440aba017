"""Agglomeration of a cluster tree by time purity, one independent piece of the tree at a time.

Only nodes of at most twice as many points as there are frames can become clusters. A cluster takes
points below its node, so seeds under different highest such nodes never meet: each subtree below one
is a piece, of bounded size, and the rule of one seed after the other runs in it alone. What does see
the whole tree, the stop after frames without a new cluster and the numbers, comes after, from the
accepted clusters: a later seed changes nothing of an earlier one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators import graph
from trackloom.operators.checkpoints import cut, cut_round
from trackloom.operators.components import components
from trackloom.operators.frames import hashed_order

#: A fitted cluster is where seeds start unless it is larger than this many times the frames, or less pure.
PRIOR_SIZE, PRIOR_PURITY = 1.2, 0.8

#: Rows of a tree that one task takes, but for a single piece that has more.
TASK_ROWS = 50_000

#: Rows of one piece. Pieces have fewer than five times as many rows as there are frames unless labels join them.
MOST_ROWS = 400_000


def _sized(tree: DataFrame) -> DataFrame:
    """node, parent (null at the root), point (null within), size (points at or below it) of every node."""
    rows = tree.select(F.col("child").alias("node"), "parent", "point")
    inner = rows.select(F.col("parent").alias("node")).distinct()
    if "size" in tree.columns:
        sizes = tree.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("size"))
    else:
        nodes = rows.unionByName(inner.join(rows, "node", "left_anti"), allowMissingColumns=True)
        leaves = rows.where("point is not null").select("node")
        sizes = graph.tree_closure(nodes).join(leaves, "node").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    every = inner.join(rows.where("point is null"), "node", "left").select("node", "parent", F.lit(None).cast("bigint").alias("point"))
    return every.join(sizes, "node").unionByName(rows.where("point is not null").withColumn("size", F.lit(1).cast("bigint")))


def pieces(tree: DataFrame, most: int) -> DataFrame:
    """node, parent, point, piece: the nodes of at most `most` points, each with the highest such node above it.

    Chains to the highest nodes are halved in each round: the rounds are the logarithm of a piece's depth.
    """
    small = cut(_sized(tree).where(F.col("size") <= most).drop("size"))
    inner = small.where("point is null")
    among = inner.select(F.col("node").alias("parent"), F.lit(True).alias("within"))
    top = cut_round(inner.join(among, "parent", "left").select("node", F.when(F.col("within"), F.col("parent")).otherwise(F.col("node")).alias("piece")))
    while True:
        on = top.select(F.col("node").alias("piece"), F.col("piece").alias("further"))
        step = cut_round(top.join(on, "piece").select("node", F.col("further").alias("piece"), (F.col("further") != F.col("piece")).alias("moved")))
        top = step.select("node", "piece")
        if step.where("moved").isEmpty():
            break
    above = top.select(F.col("node").alias("parent"), "piece")
    leaves = small.where("point is not null").join(above, "parent", "left").select("node", "parent", "point", F.coalesce("piece", "node").alias("piece"))
    return leaves.unionByName(inner.join(top, "node").select("node", "parent", "point", "piece"))


def _whole(tree: DataFrame) -> DataFrame:
    """node, parent, point, piece: all nodes as one piece."""
    rows = tree.select(F.col("child").alias("node"), "parent", "point")
    roots = rows.select(F.col("parent").alias("node")).distinct().join(rows, "node", "left_anti")
    return rows.unionByName(roots, allowMissingColumns=True).withColumn("piece", F.lit(0).cast("bigint"))


def _together(held: DataFrame, most: float) -> DataFrame:
    """held with the pieces that a fitted cluster of at most `most` points lies in made one."""
    shared = held.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("u"), F.max("piece").alias("v"))
    shared = cut(shared.where((F.col("n") <= most) & (F.col("u") < F.col("v"))).select("label", "u"))
    if shared.isEmpty():
        return held
    links = held.where("label > 0").join(shared, "label").select("u", F.col("piece").alias("v"))
    roots = components(links).select(F.col("node").alias("piece"), "root")
    return held.join(roots, "piece", "left").withColumn("piece", F.coalesce("root", "piece")).drop("root")


def _accept(pdf, n_frames: int, min_kept: int, min_goodness: float, alpha: float):
    """(seed, new, node, point, kept) of the clusters that a piece's seeds are given, in order.

    A node's points stand side by side in the order of the tree, so that memory grows with the piece and not with its
    depth. A node is blocked for good once all its points of a frame are taken: a point that is taken
    blocks nodes above it up to the first that holds a free one of its frame. Blocked nodes are passed over by jumps.
    """
    above = dict(zip(pdf.node.tolist(), pdf.parent.tolist(), strict=True))
    names = list(above)
    number = {node: i for i, node in enumerate(names)}
    up = [number.get(parent, -1) if parent != node else -1 for node, parent in above.items()]
    points = pdf[pdf.is_point]
    at, frame, score, fitted, clusters = {}, {}, {}, {}, {}
    children, held = [[] for _ in up], [[] for _ in up]
    for p, node, t, s, label in zip(*(points[c].tolist() for c in ("point", "node", "t", "score", "label")), strict=True):
        at[p], frame[p], score[p] = number[node], t, s
        held[number[node]].append(p)
        if label > 0:
            fitted[p] = label
            clusters.setdefault(label, []).append(p)
    roots = []
    for i, parent in enumerate(up):
        (children[parent] if parent >= 0 else roots).append(i)
    order, row, low, waiting = [], [], [0] * len(up), roots[::-1]
    while waiting:
        i = waiting.pop()
        low[i] = len(row)
        order.append(i)
        row += held[i]
        waiting += children[i]
    # frames of a node: the smaller set goes into the larger
    high, rated, seen = low[:], [0.0] * len(up), [{frame[p] for p in ps} for ps in held]
    goodness = lambda kept, total: (1 - alpha) * kept / total + alpha * kept / n_frames
    for i in reversed(order):
        high[i] = max(high[i], low[i] + len(held[i]))
        kept, total = len(seen[i]), high[i] - low[i]
        if min_kept <= total <= 2 * n_frames and kept >= min_kept:
            rated[i] = goodness(kept, total)
        if (parent := up[i]) >= 0:
            high[parent] = max(high[parent], high[i])
            one, two = sorted((seen[i], seen[parent]), key=len)
            two |= one
            seen[parent] = two
        seen[i] = None
    floor = min(min_goodness, 0.0) if fitted else min_goodness  # no bar is under it
    jump = [i if rated[i] > floor else up[i] for i in range(len(up))]

    def find(i):
        """The first node from i upwards that is neither blocked nor too bad."""
        passed = []
        while i >= 0 and jump[i] != i:
            passed.append(i)
            i = jump[i]
        for k in passed:
            jump[k] = i
        return i

    place = {p: k for k, p in enumerate(row)}
    before, after, last = {}, {}, {}  # the free points of a frame as a chain, by place
    for p, k in place.items():
        before[k], after[k] = last.get(frame[p], -1), len(row)
        if before[k] >= 0:
            after[before[k]] = k
        last[frame[p]] = k
    free: dict = {}
    for p, label in fitted.items():
        free[label, frame[p]] = free.get((label, frame[p]), 0) + 1
    wide = {label: len({frame[p] for p in members}) for label, members in clusters.items()}
    prior = {label for label, members in clusters.items() if len(members) <= PRIOR_SIZE * n_frames and wide[label] >= PRIOR_PURITY * len(members)}
    taken, used, blocked = set(), set(), set()

    def keep(members):
        best: dict = {}
        for p in members:
            key = (p not in taken, score[p], p)
            if frame[p] not in best or key > best[frame[p]]:
                best[frame[p]] = key
        return {key[2] for key in best.values()}

    def take(p):
        taken.add(p)
        lo, hi = before[place[p]], after[place[p]]
        if lo >= 0:
            after[lo] = hi
        if hi < len(row):
            before[hi] = lo
        i = find(at[p])
        while i >= 0 and lo < low[i] and high[i] <= hi:
            jump[i] = up[i]
            i = find(i)
        if label := fitted.get(p):
            free[label, frame[p]] -= 1
            if not free[label, frame[p]]:
                blocked.add(label)

    for seed in points.sort_values(["order", "t", "point"]).point.tolist():
        if seed in taken:
            continue
        label, name, best, changed = fitted.get(seed), None, None, -1
        start = above[names[at[seed]]] if label in prior else names[at[seed]]
        if label in prior and label not in used:
            name, best = label, goodness(wide[label], len(clusters[label]))
        i = find(number.get(start, -1))
        while i >= 0:
            if rated[i] > (min_goodness if best is None else best + 1e-6):
                best, changed = rated[i], i
            i = find(up[i])
        if best is not None and best > min_goodness and (changed >= 0 or label not in blocked):
            members = row[low[changed] : high[changed]] if changed >= 0 else clusters[label]
            kept = keep(members)
            used.add(name)
            for p in kept:
                take(p)
            yield from ((seed, changed >= 0, names[changed] if changed >= 0 else start, p, p in kept) for p in members)


def agglomerate(tree: DataFrame, detections: DataFrame, min_kept: int = 2, min_goodness: float = 0.5, patience: int = 5, alpha: float = 0.9, seed: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """cluster, node, linear_ind, kept: clusters accepted greedily from frames in hashed order.

    From each point of the frame that no cluster has yet, the node above it of greatest goodness whose
    kept points are free is accepted if its goodness is over min_goodness. A cluster keeps one point
    per frame, a free one first, then by score and index. Frames without a new cluster use up patience.

    detections has score, and may have label, of a fit (above 0: clustered; others are leaves). Such a
    fit is a prior: a point of a cluster that is small and pure enough and not yet used starts from
    the cluster, which is accepted as it is unless a node above it is better; only clusters that
    differ from the fit's count as new.

    tree has parent, child, point and may have size, its children's numbers of points, which saves the
    count of them. Points that have no detection are left out, and a null score is the least. Pieces of the tree
    are dealt to tasks of about task_rows rows, and a tree of fewer rows is one piece; labels that cross the
    tree's pieces join them, up to MOST_ROWS rows. An empty tree gives no rows.
    """
    import pandas as pd

    label = F.coalesce(F.col("label").cast("bigint"), F.lit(0)) if "label" in detections.columns else F.lit(0).cast("bigint")
    score = F.coalesce(F.col("score").cast("double"), F.lit(-math.inf))
    seen = detections.select(F.col("linear_ind").alias("point"), "t", score.alias("score"), hashed_order(detections, "t", seed).alias("order"), label.alias("label"))
    frames = cut(seen.select("t", "order").distinct())
    n_frames = frames.count()
    tree = cut(tree)
    small = (n_rows := tree.count()) <= task_rows
    split = _whole(tree) if small else pieces(tree, 2 * n_frames)
    held = split.join(seen, "point", "left").withColumn("is_point", F.col("point").isNotNull()).where("not is_point or t is not null")
    if not small:
        held = cut(_together(cut(held), PRIOR_SIZE * n_frames))
        if min_kept > 1:  # a point alone is no cluster unless a fit says so
            held = held.where("piece <> node or not is_point or label > 0")
        sizes = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        n_rows, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if largest > MOST_ROWS:
            raise ValueError(f"{largest} rows of a tree are one piece, as labels join them; {MOST_ROWS} are taken")
    task = F.pmod(F.xxhash64("piece"), F.lit(max(1, math.ceil(n_rows / task_rows))))
    filled = held.select(
        task.alias("task"), "piece", "node", F.coalesce("parent", "node").alias("parent"), "is_point",
        *[F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c) for c, kind in (("point", "bigint"), ("t", "int"), ("score", "double"), ("order", "bigint"), ("label", "bigint"))],
    )

    def solve(pdf):
        out = [row for _, piece in pdf.groupby("piece", sort=False) for row in _accept(piece, n_frames, min_kept, min_goodness, alpha)]
        return pd.DataFrame(out, columns=["seed", "new", "node", "linear_ind", "kept"])

    rows = filled.groupBy("task").applyInPandas(solve, "seed bigint, new boolean, node bigint, linear_ind bigint, kept boolean")
    at = seen.select(F.col("point").alias("seed"), "t", "order")
    rows = cut(rows.join(at, "seed"))
    idle = frames.join(rows.where("new").select("t").distinct(), "t", "left_anti").orderBy("order", "t").limit(patience + 1).collect()
    if len(idle) > patience:
        last = idle[-1]
        rows = rows.where((F.col("order") < last["order"]) | ((F.col("order") == last["order"]) & (F.col("t") <= last["t"])))
    accepted = rows.select("order", "t", "seed").distinct()
    counts = accepted.groupBy("order", "t").agg(F.count(F.lit(1)).alias("n"))  # a row per frame
    before = F.coalesce(F.sum("n").over(W.orderBy("order", "t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("t").orderBy("seed"))
    numbers = accepted.withColumn("inside", inside).join(counts.select("t", before.alias("before")), "t")
    numbers = numbers.select("seed", (F.col("before") + F.col("inside")).cast("int").alias("cluster"))
    return rows.join(numbers, "seed").select("cluster", "node", "linear_ind", "kept")
