"""Quantile summaries against sorted rows."""

import bisect
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import quantiles, queries

SF = "/root/testdata/sf0.001"
KIND = "stream string, grp string, batch int, money double, c bigint"


def held_against(rows, values, parts=4, least=20):
    """rows of summarised() against values: (stream, grp) -> [(batch, x)]."""
    xs = defaultdict(list)
    for key, some in values.items():
        for b, x in some:
            xs[(*key, b)].append(x)
            xs[(*key, -1)].append(x)
    for some in xs.values():
        some.sort()
    assert {(r.stream, r.grp, r.batch, r.i) for r in rows} == {(*k, i) for k, v in xs.items() if len(v) >= least for i in range(1, parts)}
    last = {}
    for r in sorted(rows, key=lambda r: (r.stream, r.grp, r.batch, r.i)):
        x = xs[r.stream, r.grp, r.batch]
        assert r.n == len(x) and r.target == -(-r.i * r.n // parts) and r.exact_x == x[r.target - 1]
        assert r.n_below == bisect.bisect_left(x, r.answer) and r.n_upto == bisect.bisect_right(x, r.answer)
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto)
        assert r.within == (1000 * r.rank_error <= 20 * r.n) and r.within
        assert min(10, len(set(x))) <= r.points <= min(r.n, 1000) and x[0] <= r.answer <= x[-1]
        assert r.answer >= last.get((r.stream, r.grp, r.batch), r.answer)
        last[r.stream, r.grp, r.batch] = r.answer


def test_query_against_sorted_rows(spark):
    found = queries.queries()["op12_quantiles"](spark, SF)
    names = "stream grp batch i n target exact_x points answer n_below n_upto rank_error within"
    assert found.columns == names.split()
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    values = defaultdict(list)
    put = lambda s, g, i, m: g is not None and m is not None and values[s, str(g)].append((zlib.crc32(str(i).encode()) % 4, math.floor(100 * m + 0.5) + 1000 * (zlib.crc32(str(i).encode()) % 4)))
    for r in read("clicks").dropDuplicates(["click_id"]).collect():
        put("value", r.client_id, r.click_id, r.value)
    for r in read("sale_lines").join(read("items"), "item_id").collect():
        put("price", r.brand, r.vendor_id, r.price)
    held_against(found.collect(), values)


def test_hot_group_of_wide_values_in_many_pieces(spark):
    """Values over many blocks (and blocks of blocks), negative ones too, and one value with half of all rows."""
    rng = np.random.default_rng(5)
    money = [*(rng.lognormal(9, 3, 4000) - 500).tolist(), *[12.34] * 4000, 9e12, -9e12]
    rows = [("s", "hot", i % 4, float(m), 1) for i, m in enumerate(money)] + [("s", "cold", 0, 1.0, 19), ("s", "just", 1, 2.5, 20)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    values = defaultdict(list)
    for s, g, b, m, c in rows:
        values[s, g] += [(b, math.floor(100 * m + 0.5) + 1000 * b)] * c
    held_against(quantiles.summarised(df, 4, 20).collect(), values)


def test_same_whatever_the_layout(spark):
    rng = np.random.default_rng(6)
    rows = [("s", f"g{i % 3}", i % 4, float(v), 1) for i, v in enumerate(rng.normal(1000, 300, 6000))]
    one, two = (sorted(map(tuple, quantiles.summarised(spark.createDataFrame(rows, KIND).repartition(n), 4, 20).collect())) for n in (1, 7))
    assert one == two


def test_merging_in_rounds(spark):
    """More pieces than FAN of one summary."""
    n = 70 * quantiles.FAN
    counts = spark.range(n).select(F.lit("s").alias("stream"), F.lit("g").alias("grp"), F.lit(0).alias("batch"), (F.col("id") * (1 << quantiles.BITS)).alias("x"), F.lit(3).cast("bigint").alias("c"))
    counts = counts.withColumn("block", F.shiftright("x", quantiles.BITS))
    found = {r["batch"]: r for r in quantiles.merged(quantiles.pieces(counts)).collect()}
    assert set(found) == {0, -1}
    for r in found.values():
        assert r["n"] == 3 * n and sum(1 << h for h in r["levels"]) == r["n"] and len(r["xs"]) <= 1000
        got = quantiles.estimates(np.array(r["xs"]), np.array(r["levels"]), [3 * n // 2])[0] >> quantiles.BITS
        assert abs(got - n // 2) < 0.02 * n


def test_odd_rows(spark):
    rows = [("s", None, 0, 1.0, 50), ("s", "g", 0, None, 50), ("s", "g", 0, float("nan"), 50), ("s", "g", 1, float("inf"), 50), (None, "g", 0, 1.0, 30)]
    df = spark.createDataFrame(rows, KIND).withColumns({"block": F.lit("mine"), "x": F.lit("mine"), "n": F.lit(1)})
    found = quantiles.summarised(df, 4, 20).collect()
    assert {(r.stream, r.grp, r.batch, r.n) for r in found} == {(None, "g", 0, 30), (None, "g", -1, 30)}
    assert quantiles.summarised(df.limit(0), 4, 20).collect() == []


@pytest.mark.parametrize("kind", ["uniform", "heavy", "few"])
def test_compactors_keep_weights_and_ranks(kind):
    rng = np.random.default_rng(7)
    for trial in range(20):
        n = int(rng.integers(1000, 60_000))
        x = {"uniform": rng.integers(0, 10**6, n), "heavy": np.where(rng.random(n) < 0.4, 777, rng.integers(0, 10**5, n)), "few": rng.integers(0, 30, n)}[kind]
        values, counts = np.unique(x, return_counts=True)
        at, level = quantiles.points_of(values, counts)
        xs, levels = quantiles.compress(values[at], level.astype(np.int8), n, trial)
        assert (1 << levels.astype(np.int64)).sum() == n and min(10, len(values)) <= len(xs) <= min(n, 1000)
        targets = [-(-i * n // 10) for i in range(1, 10)]
        s = np.sort(x)
        for t, a in zip(targets, quantiles.estimates(xs, levels, targets), strict=True):
            lo, hi = np.searchsorted(s, a), np.searchsorted(s, a, "right")
            assert max(0, lo + 1 - t, t - hi) <= 0.01 * n
