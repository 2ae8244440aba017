"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut

#: Edges of a task that makes a spanning forest in memory, about 200 bytes each.
TASK_EDGES = 200_000


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step of the alternating-star algorithm over edges (u, v): each u's neighbours are joined to
    the least of u and its neighbours; the greater ones only, or for a small star the lesser ones and u.

    The least neighbour comes from an aggregation and a join, not from a group's rows at one place,
    so a node with very many neighbours is split like any skewed join.
    """
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    seen = both.where("v < u") if small else both
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    moved = met.where("v <> m").select("v", "m") if small else met.where("v > u").select("v", "m")
    if small:
        moved = moved.union(least.select("u", "m"))
    return moved.toDF("u", "v").where("u <> v").distinct()


def _forest(batches):
    """Edges (u, v) of a partition to one edge for each node but its local root."""
    import pyarrow as pa

    above: dict = {}

    def top(n):
        while (m := above.get(n, n)) != n:
            above[n] = above.get(m, m)
            n = m
        return n

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a := top(u)) != (b := top(v)):
                above[max(a, b)] = min(a, b)
    if above:
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(top, nodes), kind)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of an edge (u, v); loops are passed over.

    Null ends are dropped and repeated edges count once. Edges are first reduced to spanning forests
    in tasks of about TASK_EDGES edges; where that took several tasks, alternating stars join their
    forests. Each round is written to the shared checkpoint folder, and the rounds grow with the
    logarithm of a component's size.
    """
    kind = edges.schema[0].dataType.simpleString()
    now = cut(edges.toDF("u", "v").where("u <> v").distinct())
    tasks = -(-now.count() // TASK_EDGES)
    # dealt anew, as a forest's edges all come from one task
    now = cut(now.repartition(max(1, tasks)).mapInArrow(_forest, f"u {kind}, v {kind}").repartition("u"))
    state = None
    while tasks > 1:
        now = cut(_stars(_stars(now, small=False), small=True))
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
