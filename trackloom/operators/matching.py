"""One-to-one matching of most weight over a sparse table of pairs.

Pairs fall into connected components, which are matched apart. A component of few cells is one task's
dense assignment; one of up to TASK_PAIRS pairs a task's auction, whose memory follows the pairs;
a larger one is an auction in rounds of joins, in which every bidder without a partner bids at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import auction
from trackloom.functions.hungarian import assign
from trackloom.operators.checkpoints import cut, cut_round
from trackloom.operators.components import components

#: Rows times columns of a dense assignment, about three seconds' work, and pairs of a task's auction.
CELLS, TASK_PAIRS = 250_000, 2_000_000


def matched(pairs: DataFrame) -> DataFrame:
    """grp, gt, pred, n of the matching with the greatest sum of n in each group of pairs (grp, gt, pred, n).

    n: whole numbers; pairs of n under 1 are not matched. In dense components, equals go in order of the names.
    """
    pairs = cut(pairs.where("n > 0"))
    sizes = pairs.groupBy("grp").agg((F.count_distinct("gt") * F.count_distinct("pred")).alias("cells"))
    if (sizes.agg(F.max("cells")).first()[0] or 0) <= CELLS:
        return _in_tasks(pairs.withColumn("comp", F.lit(0).cast("bigint")))
    # nodes of both sides by number
    name = lambda side: pairs.select("grp", F.col(side).cast("string").alias("name"), F.lit(side).alias("side"))
    nodes = cut(name("gt").union(name("pred")).distinct().withColumn("node", F.monotonically_increasing_id()))
    of = lambda side, u: nodes.where(F.col("side") == side).select("grp", F.col("name").alias(f"_{side}"), F.col("node").alias(u))
    placed = pairs.withColumns({"_gt": F.col("gt").cast("string"), "_pred": F.col("pred").cast("string")})
    placed = cut(placed.join(of("gt", "u"), ["grp", "_gt"]).join(of("pred", "v"), ["grp", "_pred"]).select("grp", "gt", "pred", "n", "u", "v"))
    roots = components(placed.select("u", "v"))
    placed = cut(placed.join(roots.select(F.col("node").alias("u"), F.col("root").alias("comp")), "u"))
    large = [r["comp"] for r in placed.groupBy("comp").count().where(F.col("count") > TASK_PAIRS).collect()]  # a row for each TASK_PAIRS pairs at most
    found = _in_tasks(placed.where(~F.col("comp").isin(large)) if large else placed)
    for comp in large:
        one = placed.where(F.col("comp") == comp)
        found = found.unionByName(one.join(auction_rounds(one.select("u", "v", "n")), ["u", "v"]).select("grp", "gt", "pred", "n"))
    return found


def _in_tasks(pairs: DataFrame) -> DataFrame:
    kind = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("grp", "gt", "pred")]

    def solve(pdf):
        import numpy as np
        import pandas as pd

        rows, columns = np.unique(pdf["gt"]), np.unique(pdf["pred"])
        if len(rows) * len(columns) <= CELLS:
            table = np.zeros((len(rows), len(columns)))
            table[np.searchsorted(rows, pdf["gt"]), np.searchsorted(columns, pdf["pred"])] = pdf["n"]
            found = [(rows[r], columns[c]) for r, c in assign(-table) if table[r, c] > 0]
        else:
            found = auction.match(pdf["gt"].tolist(), pdf["pred"].tolist(), pdf["n"].tolist())
        kept = pd.DataFrame(found, columns=["gt", "pred"]).merge(pdf, on=["gt", "pred"])
        return kept[["grp", "gt", "pred", "n"]]

    return pairs.groupBy("grp", "comp").applyInPandas(solve, f"{', '.join(kind)}, n bigint")


def auction_rounds(pairs: DataFrame) -> DataFrame:
    """u, v of a matching of greatest total n over pairs (u, v, n), by rounds of bids.

    The auction of functions.auction with all bids of a round at once. Bidders and goods are joined
    with their pairs only; a bidder's two best goods and a good's best bid are aggregates, combined before they
    shuffle. Prices and owners are written each round.
    """
    node = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    u, v = F.col("u"), F.col("v")
    n_nodes = pairs.select(u).distinct().count() + pairs.select(v).distinct().count()
    w = (F.col("n") * (n_nodes + 1)).cast("bigint").alias("w")
    mirrored = pairs.select(node("v", v).alias("p"), node("u", u).alias("o"), w)
    free = [pairs.select(node(k, c).alias("p"), node(k, c).alias("o"), F.lit(0).cast("bigint").alias("w")).distinct() for k, c in (("u", u), ("v", v))]
    # goods v of bidders u, and the mirror; each node may keep to itself
    wants = cut(pairs.select(node("u", u).alias("p"), node("v", v).alias("o"), w).unionByName(mirrored).unionByName(free[0]).unionByName(free[1]))
    bidders = cut(wants.select("p").distinct())
    goods = cut(wants.select("o").distinct().withColumns({"price": F.lit(0).cast("bigint"), "owner": F.lit(None).cast("string")}))
    step = max(1, (wants.agg(F.max("w")).first()[0] or 0) // 4)
    while True:
        goods = goods.withColumn("owner", F.lit(None).cast("string"))
        while True:
            waiting = bidders.join(goods.where("owner is not null").select(F.col("owner").alias("p")), "p", "left_anti")
            values = waiting.join(wants, "p").join(goods.select("o", "price"), "o").select("p", "o", "price", (F.col("w") - F.col("price")).alias("value"))
            best = values.withColumn("rk", F.row_number().over(W.partitionBy("p").orderBy(F.desc("value"), "o"))).where("rk <= 2")
            two = best.groupBy("p").agg(F.max(F.when(F.col("rk") == 1, F.struct("o", "price", "value"))).alias("a"), F.max(F.when(F.col("rk") == 2, F.col("value"))).alias("second"))
            bid = F.col("a.price") + step + F.coalesce(F.col("a.value") - F.col("second"), F.lit(0))
            bids = two.groupBy(F.col("a.o").alias("o")).agg(F.max(F.struct(bid.alias("bid"), "p")).alias("b"))
            after = cut_round(goods.join(bids, "o", "left").select("o", F.coalesce("b.bid", "price").alias("price"), F.coalesce("b.p", "owner").alias("owner"), F.col("b").isNotNull().alias("sold")))
            goods = after.drop("sold")
            if after.where("sold").isEmpty():
                break
        if step == 1:
            break
        step = max(1, step // 5)
    pair = goods.where(F.col("owner").startswith("u") & F.col("o").startswith("v"))
    return pair.select(F.substring("owner", 2, 20).cast("bigint").alias("u"), F.substring("o", 2, 20).cast("bigint").alias("v"))
