"""Hierarchical density clustering of any number of points: spanning tree, condensed tree, leaf clusters.

The minimum spanning tree under mutual reachability grows in rounds (Boruvka): each component takes
its least edge to another one, in the order of (weight, ends), so that ties close no circle. A
point's nearest neighbours settle most rounds: what is not among them is farther than the last of
them. Only points whose neighbours can't settle the round meet all others, block by block; those of the
largest component need not, as each other one is joined by its own edge.

The tree's edges, by weight, make the condensed tree in levels. A level is the lightest part of the
edges: the pieces that it joins are tasks of their own, as merges under a weight do not meet between
them, and become single nodes of the next level. A level whose largest piece is beyond a task takes
fewer edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.distances import _measured, squares_about
from trackloom.operators import graph
from trackloom.operators.checkpoints import cut, cut_round
from trackloom.operators.components import components

#: Nodes of a piece of a level, which is one task's work, at most.
TASK_NODES = 200_000
#: Neighbours of a point that are asked first, at least.
NEAR = 16


#: Columns of a tile of distances, and pairs that may wait to be measured.
TILE, WAITING = 4096, 1 << 20


def _bests(a, b):
    """(comp, w, lo, hi): arrays of the least edge from each component of a to points of b in other components.

    a: ids, x, core, comp and a weight that the component has an edge of already, infinite if it has none: heavier edges
    may be left out. Products give squares but for rounding; what may be the least is measured coordinate by coordinate.
    """
    import numpy as np

    ids_a, xa, core_a, comp_a, most_a = (v[np.argsort(a[3], kind="stable")] for v in a)
    ids_b, xb, core_b, comp_b = (v[np.argsort(b[3], kind="stable")] for v in b)
    left, a2, right, b2, unit, least = squares_about(xa, xb, np.median(xb[:: -(-len(xb) // 1024)], axis=0), max(core_a.max(), core_b.max()))
    kind = left.dtype.type
    off, own2 = unit * (2 * a2 + 2 * b2.max() + core_b.max() ** 2) + least, core_a**2
    a2, core2 = a2.astype(kind)[:, None], (core_b**2).astype(kind)
    names, first, at = np.unique(comp_a, return_index=True, return_inverse=True)
    begin, end = np.searchsorted(comp_b, names), np.searchsorted(comp_b, names, side="right")  # same component: a span
    up = most_a[first] ** 2 * (1 + 1e-12)  # at least the least edge's square
    best = np.full(len(names), np.inf), np.full(len(names), -1), np.full(len(names), -1)

    def settle(waiting):
        i, j, d = (np.concatenate(column) for column in zip(*waiting, strict=True))
        some = d <= up[at[i]] + off[i]
        i, j = i[some], j[some]
        exact = np.maximum(np.maximum(_measured(xa, xb, i, j), core_a[i]), core_b[j])
        low, high, c = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j]), at[i]
        met = np.unique(c)
        c, exact, low, high = (np.concatenate(column) for column in zip((c, exact, low, high), (met, *(v[met] for v in best)), strict=True))
        order = np.lexsort((high, low, exact, c))
        order = order[np.unique(c[order], return_index=True)[1]]
        for v, of in zip(best, (exact, low, high), strict=True):
            v[c[order]] = of[order]
        up[c[order]] = np.minimum(up[c[order]], exact[order] ** 2 * (1 + 1e-12))

    for lo in range(0, len(ids_a), 256):
        rows = lo + np.flatnonzero(own2[lo : lo + 256] <= up[at[lo : lo + 256]])
        if not len(rows):
            continue
        comps, starts = np.unique(at[rows], return_index=True)
        spans = list(zip(starts, np.append(starts[1:], len(rows)), begin[comps], end[comps]))
        waiting, n = [], 0
        for to in range(0, len(ids_b), TILE):
            d = left[rows] @ right[to : to + TILE].T
            d += a2[rows]
            np.maximum(d, core2[to : to + TILE], out=d)
            for r0, r1, c0, c1 in spans:
                if c0 < to + TILE and c1 > to:
                    d[r0:r1, max(c0 - to, 0) : c1 - to] = np.inf
            np.minimum.at(up, at[rows], np.maximum(d.min(axis=1) + off[rows], own2[rows]))
            bound = up[at[rows]] + off[rows]
            bound[np.isinf(bound)] = -1
            i, j = np.divmod(np.flatnonzero(d <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None]), d.shape[1])
            waiting.append((rows[i], to + j, d[i, j].astype(float)))
            if (n := n + len(i)) > WAITING:
                settle(waiting)
                waiting, n = [], 0
        if n:
            settle(waiting)
    found = np.isfinite(best[0])
    return names[found], *(v[found] for v in best)


def _searched(asking: DataFrame, points: DataFrame, n: int, block: int) -> DataFrame:
    """comp, w, a, b: the least edge of each component, by block, from asking points (linear_ind, x, core, comp, most) to all
    points (the same without most)."""
    few, many = graph.blocks_of(asking.count(), block), graph.blocks_of(n, block)
    kept, place = ("linear_ind", "x", "core", "comp"), lambda blocks: F.pmod(F.xxhash64("linear_ind"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    one = asking.select(*kept, "most", place(few).alias("i"), every(many).alias("j"))
    two = points.select(*kept, F.lit(None).cast("double").alias("most"), every(few).alias("i"), place(many).alias("j"))

    def nearest(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        other = pc.is_null(table.column("most"))
        sides = [table.filter(pc.invert(other)), table.filter(other)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"comp": pa.array([], pa.int64()), "w": pa.array([], pa.float64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = ((*graph._vectors(side), *(side.column(c).to_numpy() for c in ("core", "comp"))) for side in sides)
        return pa.table(dict(zip(("comp", "w", "a", "b"), _bests((*a, sides[0].column("most").to_numpy()), b))))

    return one.unionByName(two).groupBy("i", "j").applyInArrow(nearest, "comp bigint, w double, a bigint, b bigint")


def cores(points: DataFrame, min_samples: int, block: int = graph.BLOCK) -> DataFrame:
    """linear_ind, core, near (array of dst, dist) of each point: see spanning_edges; near are its NEAR nearest at least.

    Many min_samples, a share of the frames, would make rows in the square of the points: then only NEAR of them are kept.
    """
    min_samples = max(1, min_samples)
    if max(min_samples, NEAR) > graph.MOST_ROWS:
        return cut(graph.kth_distances(points, min_samples, NEAR, block))
    near = graph.knn(points, max(min_samples, NEAR), block=block)
    core = F.max(F.when(F.col("rk") <= min_samples, F.col("dist"))).alias("core")
    return cut(near.groupBy(F.col("src").alias("linear_ind")).agg(core, F.collect_list(F.struct("dst", "dist")).alias("near")))


def spanning_edges(points: DataFrame, min_samples: int, block: int = graph.BLOCK, held: DataFrame | None = None) -> DataFrame:
    """a, b, w: the n - 1 edges (a < b) of the minimum spanning tree under mutual reachability.

    points: linear_ind, x. The core distance of a point is that to its min_samples-th neighbour, itself
    being the first (the farthest point, if there are fewer). Of trees of equal weight it is the
    one of least edges by (weight, ends). Equal points count each; fewer than two give no edges. held: cores' rows, if they are there.

    The component of most points does not search in its round: the others' edges lead on to it.
    """
    points = cut(points.select(F.col("linear_ind").cast("bigint").alias("linear_ind"), "x"))
    n = points.count()
    held = cores(points, min_samples, block) if held is None else held
    # what is not among its neighbours is at least so far from a point
    least = F.greatest("core", F.array_max(F.col("near.dist"))).alias("least")
    points = cut(points.join(held.select("linear_ind", "core", least), "linear_ind"))
    of = lambda side: points.select(F.col("linear_ind").alias(side), F.col("core").alias(f"core_{side}"))
    near = held.select(F.col("linear_ind").alias("src"), F.explode("near").alias("e")).select("src", "e.dst", "e.dist")
    edges = near.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst")
    w = F.greatest("dist", "core_src", "core_dst").alias("w")
    edges = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w).distinct())
    comps = points.select("linear_ind", F.col("linear_ind").alias("comp"))
    tree, left, largest = None, n, None
    while left > 1:
        to = lambda side: comps.select(F.col("linear_ind").alias(side), F.col("comp").alias(f"comp_{side}"))
        # edges within a component never come back
        edges = cut_round(edges.drop("comp_a", "comp_b").join(to("a"), "a").join(to("b"), "b").where("comp_a <> comp_b"))
        edge = F.struct("w", "a", "b").alias("e")
        known = edges.select(F.col("comp_a").alias("comp"), edge).unionByName(edges.select(F.col("comp_b").alias("comp"), edge))
        best = cut_round(known.where(F.col("comp") != F.lit(largest)).groupBy("comp").agg(F.min("e").alias("e")) if largest is not None else known.groupBy("comp").agg(F.min("e").alias("e")))
        now = points.join(comps, "linear_ind")
        most = F.coalesce("e.w", F.lit(float("inf")))
        asks = F.col("least") <= most if largest is None else (F.col("comp") != F.lit(largest)) & (F.col("least") <= most)
        asking = cut(now.join(best, "comp", "left").withColumn("most", most).where(asks).select(*now.columns, "most"))
        reach = asking.agg(F.max("most")).first()[0]
        chosen = best
        if reach is not None:  # an edge to a point weighs its core distance at least
            more = _searched(asking, now.where(F.col("core") <= F.lit(reach)), n, block).select("comp", edge)
            chosen = best.unionByName(more)
        chosen = cut_round(chosen.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*"))
        fresh = chosen.select("a", "b", "w").distinct()
        tree = fresh if tree is None else tree.unionByName(fresh)
        met = chosen.select("a", "b").distinct().join(to("a"), "a").join(to("b"), "b")
        roots = components(met.select(F.col("comp_a").alias("u"), F.col("comp_b").alias("v"))).withColumnRenamed("node", "comp")
        # the one that did not search may be met by none
        comps = cut_round(comps.join(roots, "comp", "left").select("linear_ind", F.coalesce("root", "comp").alias("comp")))
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        left, largest = (lambda r: (r["left"], r["top"]["comp"]))(sizes.agg(F.count(F.lit(1)).alias("left"), F.max(F.struct("n", "comp")).alias("top")).first())
    return tree if tree is not None else points.select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.0).alias("w")).where("false")


_NODE = "node bigint, size bigint, cluster bigint"
_EVENT = "kind int, node bigint, into bigint, cluster bigint, w double, size bigint"


def _merged(least: int):
    """A piece of a level merged in the order of its edges: a function of its rows for applyInPandas.

    Kinds of rows that come out: 0, what a node is part of from here on, and that one's size and
    cluster; 1, a small node whose points fall into a cluster at weight w; 2, a cluster that
    becomes part of another at weight w with its size then.
    """

    def solve(pdf):
        import pandas as pd

        nodes, edges = pdf[pdf.w.isna()], pdf[pdf.w.notna()].sort_values(["w", "a", "b"])
        above, size, cluster, small = {}, {}, {}, {}
        for v, s, c in zip(nodes.node.tolist(), nodes["size"].tolist(), nodes.cluster.tolist(), strict=True):
            above[v], size[v], cluster[v] = v, s, None if pd.isna(c) else int(c)
            small[v] = [v] if cluster[v] is None else []

        def top(v):
            while above[v] != v:
                above[v] = above[above[v]]
                v = above[v]
            return v

        out = []
        for number, u, v, w in zip(edges.number.tolist(), edges.u.tolist(), edges.v.tolist(), edges.w.tolist(), strict=True):
            u, v = top(u), top(v)
            if size[u] < size[v]:
                u, v = v, u
            one, two = cluster[u], cluster[v]
            above[v] = u
            if one is not None and two is not None:
                number = int(number)
                out += [(2, -1, number, one, w, size[u]), (2, -1, number, two, w, size[v])]
                cluster[u] = number
            elif one is not None or two is not None:
                cluster[u] = one if one is not None else two
            elif size[u] + size[v] >= least:
                cluster[u] = int(number)
            size[u] += size[v]
            small[u] += small.pop(v)
            if cluster[u] is not None:
                out += [(1, p, -1, cluster[u], w, size[u]) for p in small[u]]
                small[u] = []
        out += [(0, v, top(v), cluster[top(v)], None, size[top(v)]) for v in above]
        found = pd.DataFrame(out, columns=["kind", "node", "into", "cluster", "w", "size"])
        return found.astype({"cluster": "Int64", "w": "float64"})

    return solve


def condensed_tree(points: DataFrame, edges: DataFrame, min_cluster_size: int, task_nodes: int | None = None) -> DataFrame:
    """parent, child, lambda, size, point: the condensed tree of a spanning tree (a, b, w) over points (linear_ind).

    Splits into two parts of at least min_cluster_size points make two clusters; all other points fall
    out of theirs at the density 1 / w. Clusters have numbers from 0, the root's the greatest; of a point
    that falls out, point is its linear_ind and child, under 0, a number of its own.
    """
    task_nodes, least = task_nodes or TASK_NODES, max(2, min_cluster_size)
    # numbered in the order of weights, so that a cluster's number is that of the edge that made it
    ordered = edges.select("a", "b", "w").orderBy("w", "a", "b").withColumn("number", F.monotonically_increasing_id())
    edges = cut(ordered.withColumns({"u": F.col("a"), "v": F.col("b")}))
    nodes = points.select(F.col("linear_ind").cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("cluster"))
    at = nodes.select(F.col("node").alias("linear_ind"), "node")  # where the points are that have not fallen out
    rows, share = None, 0.5
    while n := edges.count():
        share, taken = (1.0 if n <= task_nodes else min(0.5, 4 * share)), None  # about what the level before took
        while taken is None:
            most = edges.agg(F.max("number")).first()[0] if share == 1.0 else edges.approxQuantile("number", [share], 0.0)[0]
            part = edges.where(F.col("number") <= int(most))
            roots = cut_round(components(part.select("u", "v")))
            largest = roots.groupBy("root").count().agg(F.max("count")).first()[0]
            if largest <= task_nodes + 1 or part.count() <= task_nodes:
                taken = part
            else:
                share /= 2
        empty = {c: F.lit(None).cast(t) for c, t in (("number", "bigint"), ("u", "bigint"), ("v", "bigint"), ("a", "bigint"), ("b", "bigint"), ("w", "double"))}
        held = nodes.join(roots, "node").withColumns(empty)
        joins = taken.join(roots.withColumnRenamed("node", "u"), "u").withColumns({"node": F.lit(None).cast("bigint"), "size": F.lit(None).cast("bigint"), "cluster": F.lit(None).cast("bigint")})
        events = cut_round(held.unionByName(joins).groupBy("root").applyInPandas(_merged(least), _EVENT))
        fallen = events.where("kind = 1").select("node", F.col("cluster").alias("parent"), "w")
        single = at.join(fallen, "node").select("parent", (-1 - F.col("linear_ind")).alias("child"), "w", F.lit(1).cast("bigint").alias("size"), F.col("linear_ind").alias("point"))
        split = events.where("kind = 2").select(F.col("into").alias("parent"), F.col("cluster").alias("child"), "w", "size", F.lit(None).cast("bigint").alias("point"))
        rows = cut_round(single.unionByName(split) if rows is None else rows.unionByName(single).unionByName(split))
        moved = events.where("kind = 0").select("node", "into", "size", "cluster")
        into = moved.select("node", "into")
        at = cut_round(at.join(fallen.select("node"), "node", "left_anti").join(into, "node", "left").select("linear_ind", F.coalesce("into", "node").alias("node")))
        fresh = moved.select(F.col("into").alias("node"), "size", "cluster").distinct()
        nodes = cut_round(nodes.join(into, "node", "left_anti").unionByName(fresh))
        rest = edges.where(F.col("number") > int(most))
        for side in "uv":
            rest = rest.join(into.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("into", side)).drop("into")
        edges = cut_round(rest)
    if rows is None:
        return points.select(*(F.lit(None).cast("bigint").alias(c) for c in ("parent", "child")), F.lit(0.0).alias("lambda"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("point")).where("false")
    density = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(float("inf")))
    return rows.select("parent", "child", density.alias("lambda"), "size", "point")


def leaf_clusters(tree: DataFrame) -> DataFrame:
    """linear_ind, label, prob, birth, top of the points in clusters that have no cluster below; the others are noise.

    Labels count from 0 in the order of each cluster's first point. prob is a point's density over its
    cluster's greatest finite one; birth is the density at which the cluster begins.
    """
    split = tree.where("point is null")
    leaves = split.select(F.col("child").alias("parent"), F.col("lambda").alias("birth")).join(split.select("parent").distinct(), "parent", "left_anti")
    members = tree.where("point is not null").join(leaves, "parent").select("parent", F.col("point").alias("linear_ind"), "lambda", "birth")
    finite = F.when(F.col("lambda") < float("inf"), F.col("lambda"))
    # a row for each cluster
    of = members.groupBy("parent").agg(F.min("linear_ind").alias("first"), F.coalesce(F.max(finite), F.lit(0.0)).alias("top"))
    of = of.withColumn("label", (F.row_number().over(W.orderBy("first")) - 1).cast("int"))
    share = F.when((F.col("top") == 0) | (F.col("lambda") == float("inf")), F.lit(1.0)).otherwise(F.least("lambda", "top") / F.col("top"))
    return members.join(of, "parent").select("linear_ind", "label", share.alias("prob"), "birth", "top")
