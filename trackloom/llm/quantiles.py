"""Mergeable quantile summaries by compactors (KLL), checked against exact ranks.

A summary is points of levels: a point of level h stands for 2^h rows. With n rows and
H = ceil(log2(n / k)) + 1, level h < H has room for k (2/3)^(H - 1 - h) points, 2 at least. While there
are more points than all that room, the lowest level that is too full is sorted and every other point of
it, the even or the odd ones by a seeded coin, goes up a level; the others go. Summaries merge level
by level. Values that come with a count go in at the levels of its binary digits. At k = 270 a rank is
off by a standard deviation of under 0.4 % of the rows, so that 2 % is over five of them.

Rows are counted by value first. Values are dealt in blocks of a range, so that a task's piece of a
group is bounded however many rows the group has; pieces merge in rounds of at most FAN a task.
The exact check uses the same blocks: windows over the counts of a block, begun with the
rows before it.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import cut

#: Points of the top level. A summary has 3 K + H + K / 2 points at most: under 1000 up to 2^50 rows.
K = 270
#: A block is a range of 2^BITS values; a task's windows hold a block's distinct values.
BITS = 13
#: Pieces that a task merges into one, per summary.
FAN = 64
WHOLE = -1
_KEY = ["stream", "grp", "batch"]
_SUMMARY = "stream string, grp string, batch int, block bigint, n bigint, xs array<bigint>, levels array<tinyint>"


def rooms(n: int, k: int = K) -> list[int]:
    """Points that each level under H has room for."""
    height = max(1, math.ceil(math.log2(max(1, n / k))) + 1)
    return [max(2, math.ceil(k * (2 / 3) ** (height - 1 - h))) for h in range(height)]


def compress(xs, levels, n: int, seed: int, k: int = K):
    """(xs, levels) of a summary of n rows with compactors run until its points fit."""
    import numpy as np

    room = rooms(n, k)
    most = sum(room)
    if len(xs) <= most:
        return xs, levels
    chance = np.random.default_rng(seed)
    by = [np.sort(xs[levels == h]) for h in range(max(int(levels.max()) + 1, len(room)) + 1)]
    odd = [None] * len(by)  # the second compaction of a level takes the half that the first left
    while sum(map(len, by)) > most:
        h = next((h for h, cap in enumerate(room) if len(by[h]) > cap), None)
        if h is None:
            break
        points, rest = by[h], by[h][:0]
        if len(points) % 2:
            at = 0 if chance.integers(2) else len(points) - 1
            rest, points = points[at : at + 1], np.delete(points, at)
        if odd[h] is None:
            side = odd[h] = int(chance.integers(2))
        else:
            side, odd[h] = 1 - odd[h], None
        by[h], by[h + 1] = rest, np.sort(np.concatenate([by[h + 1], points[side::2]]))
    out = np.concatenate(by)
    return out, np.repeat(np.arange(len(by)), [len(b) for b in by]).astype(np.int8)


def points_of(xs, counts):
    """(position, level) of the points that stand for values with counts."""
    import numpy as np

    bits = int(counts.max()).bit_length() if len(counts) else 0
    return np.nonzero((counts[:, None] >> np.arange(bits)) & 1)


def _seed(*parts) -> int:
    return zlib.crc32(repr(parts).encode())


def estimates(xs, levels, targets) -> list[int]:
    """The least point at which so many rows are reached, for each target."""
    import numpy as np

    order = np.argsort(xs, kind="stable")
    reached = np.cumsum(np.int64(1) << levels[order].astype(np.int64))
    return xs[order][np.searchsorted(reached, targets)].tolist()


def batch_of(number: Column, batches: int) -> Column:
    """crc32 of a number in decimal, modulo batches; null counts as empty text."""
    return (F.crc32(F.coalesce(number.cast("string"), F.lit(""))) % batches).cast("int")


def value_counts(rows: DataFrame) -> DataFrame:
    """stream, grp, batch, block, x, c of rows (stream, grp, batch, money, c): the rows of each value.

    x is money in hundredths, rounded, plus 1000 times the batch. Rows without grp or money are left
    out, NaN and infinite money too. c: how many rows a row stands for.
    """
    money = F.col("money")
    there = F.col("grp").isNotNull() & money.isNotNull() & ~F.isnan(money) & (F.abs(money) < 1e15)
    x = F.floor(100 * money + 0.5) + 1000 * F.col("batch")
    counts = rows.where(there).select(*_KEY, x.alias("x"), "c").groupBy(*_KEY, "x").agg(F.sum("c").alias("c"))
    return counts.withColumn("block", F.shiftright("x", BITS))


def _slices(batches, n_key: int):
    """Whole runs of rows with equal first n_key columns, as Arrow batches of many runs."""
    import pyarrow as pa

    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(held):
            held = None
            continue
        last = [held.column(i)[len(held) - 1] for i in range(n_key)]
        lo = len(held) - 1
        while lo > 0 and all(held.column(i)[lo - 1] == last[i] for i in range(n_key)):
            lo -= 1
        if lo:
            yield held.slice(0, lo)
            held = pa.Table.from_batches([held.slice(lo)]).combine_chunks().to_batches()[0]
    if held is not None:
        yield held


def _starts(batch, n_key: int):
    """Where runs of equal first n_key columns begin, and the end."""
    import numpy as np

    new = np.zeros(len(batch), dtype=bool)
    new[0] = True
    for i in range(n_key):
        codes = batch.column(i)
        codes = codes.dictionary_encode().indices.to_numpy(zero_copy_only=False) if str(codes.type) in ("string", "large_string") else codes.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), len(batch))


def _lists(parts, kind):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _batch(rows, xs, levels):
    """Rows (stream, grp, batch, block, n) with their points as an Arrow batch."""
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    names = ["stream", "grp", "batch", "block", "n", "xs", "levels"]
    return pa.RecordBatch.from_arrays([*columns, _lists(xs, pa.int64()), _lists(levels, pa.int8())], names=names)


def pieces(counts: DataFrame, seed: int = 0, k: int = K) -> DataFrame:
    """stream, grp, batch, block, n, xs, levels: a summary of each block of value_counts."""

    def run(batches):
        import numpy as np

        for batch in _slices(batches, 4):
            at = _starts(batch, 4)
            x, c = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            where, level = points_of(x, c)
            points, level = x[where], level.astype(np.int8)
            cuts = np.searchsorted(where, at)
            n = np.add.reduceat(c, at[:-1])
            first = batch.take(at[:-1].tolist()).to_pydict()
            rows = list(zip(first["stream"], first["grp"], first["batch"], first["block"], n.tolist()))
            xs, levels = [], []
            for row, lo, hi in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist()):
                some = points[lo:hi], level[lo:hi]
                some = compress(*some, row[4], _seed(seed, *row[:4]), k) if hi - lo > k else some
                xs.append(some[0])
                levels.append(some[1])
            yield _batch(rows, xs, levels)

    dealt = counts.select(*_KEY, "block", "x", "c").repartition(*_KEY, "block").sortWithinPartitions(*_KEY, "block", "x")
    return dealt.mapInArrow(run, _SUMMARY)


def _merge(rows, seed: int, k: int):
    """(n, xs, levels) of summaries of rows with n, xs and levels."""
    import numpy as np

    n = sum(r[0] for r in rows)
    if len(rows) == 1:
        return rows[0]
    xs, levels = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    return n, *compress(xs, levels, n, seed, k)


def _parsed(batch):
    """Keys and (n, xs, levels) of an Arrow batch of summaries."""
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
    ends = batch.column(5).offsets.to_numpy()
    x, h = batch.column(5).values.to_numpy(), batch.column(6).values.to_numpy()
    return keys, [(n, x[a:b], h[a:b]) for n, a, b in zip(batch.column(4).to_pylist(), ends[:-1], ends[1:])]


def merged(parts: DataFrame, seed: int = 0, k: int = K) -> DataFrame:
    """stream, grp, batch, block (0), n, xs, levels: the summary of every batch, and of all batches
    of a group (batch WHOLE), merged from the batches' summaries only."""

    def up(batches):
        for batch in _slices(batches, 4):
            keys, held = _parsed(batch)
            at = _starts(batch, 4).tolist()
            out = [_merge(held[a:b], _seed(seed, "up", *keys[a]), k) for a, b in zip(at, at[1:])]
            rows = [(*keys[a], o[0]) for a, o in zip(at, out)]
            yield _batch(rows, [o[1] for o in out], [o[2] for o in out])

    def close(batches):
        for batch in _slices(batches, 2):
            keys, held = _parsed(batch)
            groups, rows = _starts(batch, 2).tolist(), []
            for a, b in zip(groups, groups[1:]):
                of: dict = {}
                for i in range(a, b):
                    of.setdefault(keys[i][2], []).append(held[i])
                each = {j: _merge(some, _seed(seed, "batch", *keys[a][:2], j), k) for j, some in of.items()}
                each[WHOLE] = _merge([each[j] for j in sorted(each)], _seed(seed, "whole", *keys[a][:2]), k)
                rows += [(*keys[a][:2], j, 0, *s) for j, s in each.items()]
            yield _batch([r[:5] for r in rows], [r[5] for r in rows], [r[6] for r in rows])

    parts = cut(parts)
    while (parts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("pieces")).agg(F.max("pieces")).first()[0] or 0) > FAN:
        # numbers of blocks: neighbours merge, FAN at a time
        block = F.floor(F.col("block") / FAN)
        parts = cut(parts.withColumn("block", block).repartition(*_KEY, "block").sortWithinPartitions(*_KEY, "block", "n", "xs").mapInArrow(up, _SUMMARY))
    return parts.repartition("stream", "grp").sortWithinPartitions("stream", "grp", "batch", "block", "n", "xs").mapInArrow(close, _SUMMARY)


def quantiles(summaries: DataFrame, parts: int, least: int) -> DataFrame:
    """stream, grp, batch, i, n, target, points, answer for i from 1 to parts - 1: the point at which
    ceil(i n / parts) rows are reached; summaries of fewer than `least` rows are left out."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keys, held = _parsed(batch)
            rows = []
            for key, (n, xs, levels) in zip(keys, held):
                if n >= least:
                    targets = [-(-i * n // parts) for i in range(1, parts)]
                    rows += [(*key[:3], i + 1, n, t, len(xs), a) for i, (t, a) in enumerate(zip(targets, estimates(xs, levels, targets)))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
            names = [*_KEY, "i", "n", "target", "points", "answer"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return summaries.mapInArrow(run, "stream string, grp string, batch int, i int, n bigint, target bigint, points bigint, answer bigint")


def _begun(counts: DataFrame, at: str, least: int, levels: int) -> DataFrame:
    """stream, grp, batch, up, before, n: the rows of a summary before each block `up` = at >> BITS of its
    counts (stream, grp, batch, at, c), and its rows, where these are at least `least`.

    Blocks of blocks bound the windows: a level of them takes BITS bits of a value.
    """
    up = counts.withColumn("up", F.shiftright(at, BITS)).groupBy(*_KEY, "up").agg(F.sum("c").alias("c"))
    if not levels:
        w = W.partitionBy(*_KEY)
        before = F.coalesce(F.sum("c").over(w.orderBy("up").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return up.select(*_KEY, "up", before.alias("before"), F.sum("c").over(w).alias("n")).where(F.col("n") >= least)
    above = _begun(up, "up", least, levels - 1)
    marks = above.select(*_KEY, F.col("up").alias("top"), (F.col("up") * (1 << BITS) - 1).alias("up"), F.col("before").alias("c"), "n")
    rows = up.select(*_KEY, F.shiftright("up", BITS).alias("top"), "up", "c", F.lit(None).cast("bigint").alias("n")).unionByName(marks)
    w = W.partitionBy(*_KEY, "top").orderBy("up")
    told = rows.withColumns({"before": F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), "all": F.sum("n").over(w)})
    return told.where("n is null and all is not null").select(*_KEY, "up", "before", F.col("all").alias("n"))


def checked(counts: DataFrame, answers: DataFrame, parts: int, least: int, error: tuple[int, int]) -> DataFrame:
    """answers with exact_x, n_below, n_upto, rank_error and within, by windows of cumulative counts.

    A window holds the distinct values of one block. It begins with a mark that carries the rows before
    the block; answers stand in it as rows of no count, so nothing is joined.
    """
    whole = counts.groupBy("stream", "grp", "x").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(WHOLE))
    both = counts.select(*_KEY, "x", "c").unionByName(whole.select(*_KEY, "x", "c"))
    blocks = counts.groupBy(*_KEY, "block").agg(F.sum("c").alias("c"))
    blocks = blocks.unionByName(blocks.groupBy("stream", "grp", "block").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(WHOLE)))
    begun = _begun(blocks.withColumn("x", F.col("block") * (1 << BITS)), "x", least, 2)
    empty = {c: F.lit(None).cast(t) for c, t in (("n", "bigint"), ("i", "int"), ("target", "bigint"), ("points", "bigint"))}
    rows = both.withColumns(empty | {"block": F.shiftright("x", BITS)})
    marks = begun.select(*_KEY, F.col("up").alias("block"), (F.col("up") * (1 << BITS) - 1).alias("x"), F.col("before").alias("c"), "n").withColumns({c: v for c, v in empty.items() if c != "n"})
    asked = answers.select(*_KEY, F.col("answer").alias("x"), F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("n"), "i", "target", "points").withColumn("block", F.shiftright("x", BITS))
    # a value's own row comes before the answers that are equal to it, so that one running frame gives both ranks
    w = W.partitionBy(*_KEY, "block").orderBy("x", F.asc_nulls_first("i")).rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(F.col("i").isNull(), F.col("c")), ignorenulls=True).over(w)
    upto = F.sum("c").over(w)
    seen = rows.unionByName(marks).unionByName(asked).withColumns({"n_upto": upto, "n_below": upto - own, "all": F.sum("n").over(w)}).where("n is null and all is not null")
    # ceil(i n / parts) <= r for the first floor(r parts / n) of i
    ended = lambda c: F.call_function("div", F.col(c) * parts, F.col("all"))
    first, last = ended("n_below") + 1, F.least(ended("n_upto"), F.lit(parts - 1))
    hit = seen.where("i is null").where(first <= last).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    told = hit.select(*_KEY, F.col("k").alias("i"), F.col("x").alias("exact_x"), *(F.lit(None).cast("bigint").alias(c) for c in ("n", "target", "points", "answer", "n_below", "n_upto")))
    found = seen.where("i is not null").select(*_KEY, "i", F.lit(None).cast("bigint").alias("exact_x"), F.col("all").alias("n"), "target", "points", F.col("x").alias("answer"), "n_below", "n_upto")
    one = told.unionByName(found).groupBy(*_KEY, "i").agg(*(F.max(c).alias(c) for c in ("n", "target", "exact_x", "points", "answer", "n_below", "n_upto")))
    off = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return one.withColumn("rank_error", off.cast("bigint")).withColumn("within", error[1] * F.col("rank_error") <= error[0] * F.col("n"))


def summarised(rows: DataFrame, parts: int, least: int, error: tuple[int, int] = (20, 1000), seed: int = 0) -> DataFrame:
    """Quantiles of rows (stream, grp, batch, money, c) by batch and whole, with their exact ranks.

    stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within; see
    value_counts for the rows that count, quantiles for those that are returned. Repeated rows count as
    often as they come; groups of fewer than `least` rows and empty tables give nothing.
    """
    counts = cut(value_counts(rows))
    answers = cut(quantiles(merged(pieces(counts, seed), seed), parts, least))
    return checked(counts, answers, parts, least, error)
