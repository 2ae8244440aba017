"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.checkpoints import cut, cut_round

#: Edges that one task joins in memory, about 200 bytes each; more are contracted in rounds first.
TASK_EDGES = 200_000


def _joined(batches):
    import pyarrow as pa

    above: dict = {}

    def root(n):
        while (m := above.setdefault(n, n)) != n:
            above[n] = above[m]
            n = m
        return n

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = sorted((root(u), root(v)))
            above[b] = a
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array(map(root, above), pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (u, v), numbers both.

    While there are more than TASK_EDGES edges, each node is replaced by the end of the chain that leads
    from it to its least neighbour and so on, which leaves at most half of them; the rest goes to one task.
    """
    now = cut(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v").distinct())
    steps = []
    while now.count() > TASK_EDGES:
        both = now.union(now.select("v", "u"))
        least = cut_round(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        while True:  # along chains of ever lesser neighbours to their ends
            on = least.select(F.col("u").alias("m"), F.col("m").alias("end"))
            further = cut_round(least.join(on, "m", "left").select("u", F.coalesce("end", "m").alias("m"), (F.coalesce("end", "m") < F.col("m")).alias("moved")))
            least = further.select("u", "m")
            if further.where("moved").isEmpty():
                break
        steps.append(least)
        of = lambda side: least.select(F.col("u").alias(side), F.col("m").alias(f"m_{side}"))
        moved = now.join(of("u"), "u").join(of("v"), "v").where("m_u <> m_v")
        now = cut_round(moved.select(F.least("m_u", "m_v").alias("u"), F.greatest("m_u", "m_v").alias("v")).distinct())
    found = now.coalesce(1).mapInArrow(_joined, "node bigint, root bigint")
    for least in reversed(steps):
        later = found.select(F.col("node").alias("m"), "root")
        found = cut_round(least.join(later, "m", "left").select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root")))
    return found
