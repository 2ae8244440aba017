"""Divergence of the sources of a language by exact term counts behind a sketch of document frequencies.

A first pass adds the documents of every term of a language to count-min sketches, one a task, which
are merged chunk by chunk. A cell never holds less than any of its terms, so that a term with a cell
under the least document frequency can't be kept: the second pass discards such terms before anything
shuffles. Those that are left are counted exactly, checked exactly, and meet in sparse joins of the
pairs of sources that share a term; what a source alone has, and what neither has, is added up
from histograms of its counts.

With n counted terms of a group and v kept terms of its language, a term of count c has
p = 1 + floor(10^9 (c + 1) / (n + v)); p of a term against q diverges by floor((p - q)^2 / q). All
numbers are 64-bit integers: exact up to 9 * 10^15 terms of a group and 2 * 10^9 kept terms.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import BROADCAST_ROWS, cut, small_batches
from trackloom.llm.shingles import mixed

#: Cells of a row of the sketch, and its rows. Fixed, so that a task holds 12 MB and what is broadcast
#: 1.5 MB; with far more terms than cells more impossible ones pass, and are left out when counted.
CELLS, ROWS = 1 << 22, 3
#: Cells of a chunk, the unit of merging.
CHUNK = 1 << 16
#: Terms with a count that a task holds before it hands them on.
HELD = 600_000
SCALE = 1_000_000_000

#: Bytes of terms to themselves, A to Z to lower case, all others to a space.
_TERM = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A to Z and of all that isn't ASCII, the letters in lower case."""
    return text.translate(_TERM).split()


def _tallies(batches, by: int, counting: bool):
    """(key, documents of each term, occurrences of each) of the first `by` columns, in bounded parts."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(by))))
        for key, text in zip(keys, batch.column(by)):
            words = terms(text.as_py() or b"")
            docs, counts = held.setdefault(key, (Counter(), Counter()))
            size -= len(docs)
            docs.update(set(words))
            if counting:
                counts.update(words)
            size += len(docs)
            if size > HELD:
                yield from ((k, *v) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, *v) for k, v in held.items())


def _hashes(lang: str, words):
    """A 64-bit hash of each term of a language."""
    import numpy as np
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _cells(hashes, row: int, cells: int):
    import numpy as np

    return (mixed(hashes + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(cells)).astype(np.int64)


def possible(texts: DataFrame, least: int, cells: int = CELLS, rows: int = ROWS) -> dict[tuple[int, int], bytes]:
    """The cells that may hold a term of at least `least` documents, as bits by (row, chunk). texts: lang, text (binary).

    Cells count up to least, in bytes where it is under 256. A chunk of all tasks' sketches is merged
    as they stream by. rows * cells bits go to the driver, whatever the table's size.
    """
    import numpy as np
    import pyarrow as pa

    kind = np.min_scalar_type(2 * least)
    size = min(CHUNK, cells)

    def sketch(batches):
        table = np.zeros((rows, cells), dtype=kind)
        for (lang,), docs, _ in _tallies(batches, 1, False):
            hashes, n = _hashes(lang, docs), np.minimum(np.fromiter(docs.values(), dtype=np.int64, count=len(docs)), least)
            for row in range(rows):
                at, inverse = np.unique(_cells(hashes, row, cells), return_inverse=True)
                table[row, at] = np.minimum(table[row, at] + np.bincount(inverse, n), least)
        for row in range(rows):
            for chunk in range(0, -(-cells // size)):
                part = table[row, chunk * size : (chunk + 1) * size]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["row", "chunk", "part"])

    def merge(batches):
        sums: dict = {}
        for batch in batches:
            for row, chunk, part in zip(*(c.to_pylist() for c in batch.columns)):
                more = np.frombuffer(zlib.decompress(part), dtype=kind)
                sums[row, chunk] = np.minimum(sums[row, chunk] + more, least).astype(kind) if (row, chunk) in sums else more
        for (row, chunk), part in sums.items():
            bits = np.packbits(part >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], names=["row", "chunk", "bits"])

    parts = texts.mapInArrow(sketch, "row int, chunk int, part binary")
    merged = parts.repartition("row", "chunk").mapInArrow(merge, "row int, chunk int, bits binary")
    return {(r["row"], r["chunk"]): bytes(r["bits"]) for r in merged.toLocalIterator()}


def counted(texts: DataFrame, bits: dict[tuple[int, int], bytes], cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """lang, source, term, docs, n of the terms that bits lets pass, added up within tasks. texts: lang, source, text (binary)."""
    import numpy as np
    import pyarrow as pa

    size = min(CHUNK, cells)

    def count(batches):
        table = np.zeros((rows, cells), dtype=bool)
        for (row, chunk), part in bits.items():
            table[row, chunk * size : (chunk + 1) * size] = np.unpackbits(np.frombuffer(part, dtype=np.uint8), count=min(size, cells - chunk * size)).astype(bool)
        for (lang, source), docs, counts in _tallies(batches, 2, True):
            hashes = _hashes(lang, docs)
            passes = np.ones(len(docs), dtype=bool)
            for row in range(rows):
                passes &= table[row, _cells(hashes, row, cells)]
            words = [w for w, p in zip(docs, passes.tolist()) if p]
            for lo in range(0, len(words), 50_000):
                some = words[lo : lo + 50_000]
                n = len(some)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                columns += [pa.array(list(map(of.__getitem__, some)), pa.int64()) for of in (docs, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])

    return texts.mapInArrow(count, "lang string, source string, term string, docs bigint, n bigint")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) by long division in three digits of a thousand, exact in 64 bits."""
    rest, out = count + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = 3, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """lang, source, term, n, lang_n, first: how often each kept term occurs in each source that has it;
    lang_n: in its language; first: true in one row of each term of a language."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    read = docs.select(_name("lang"), _name("source"), text)
    found = counted(read, possible(read.select("lang", "text"), least, cells, rows), cells, rows)
    exact = found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    w = W.partitionBy("lang", "term").orderBy("source")  # a row for each source that has the term
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    exact = exact.withColumns({"in_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "first": F.row_number().over(w) == 1})
    return exact.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first")


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _with(rows: DataFrame, groups: DataFrame, few: bool, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups.hint("merge"), on)


def audit(docs: DataFrame, least: int = 3, top: int = 200, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; nulls count as '').

    Kept are the terms in at least `least` documents of a language; a repeated row is a document more.
    Part `pair`: item is another source of the language, value how far the source's shares diverge
    from that one's, over all kept terms, 0 if there are none. Part `term`: the `top` kept terms that
    the source has in a greater share than its language, by divergence from it. Equals rank by item.
    A source without a term has its pairs; an empty table no rows. Other columns are not read.
    """
    held = cut(kept_terms(docs, least, cells, rows))
    of_lang = held.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    of_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    every = docs.select(_name("lang"), _name("source")).distinct()
    groups = every.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "size"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.greatest(F.col("total") + F.col("v"), F.lit(1))))))
    few = groups.count() <= BROADCAST_ROWS
    shares = _with(held, groups, few, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("v")))

    q = share(F.col("lang_n"), F.col("lang_total") + F.col("v"))
    over = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_term = over.withColumn("rank", ranked).where(F.col("rank") <= top)

    # pairs: what a source has against the other's share of nothing, and nothing against what the other has
    names = ("source", "p0", "size", "total")
    other = groups.select("lang", *(F.col(c).alias(f"o_{c}") for c in names))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    alone = _with(histogram, other, few, ["lang"]).where("source <> o_source").select(
        "lang", "source", "o_source", (F.col("k") * gap(F.col("p"), F.col("o_p0"))).alias("out"), (F.col("k") * gap(F.col("o_p0"), F.col("p"))).alias("back"), F.lit(0).alias("both")
    )
    mine, theirs = (shares.select("lang", "term", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "p", "p0"))) for side in "ab")
    met = mine.join(theirs.hint("merge"), ["lang", "term"]).where("a_source < b_source")
    a, b, a0, b0 = map(F.col, ("a_p", "b_p", "a_p0", "b_p0"))
    joint = met.select(
        "lang", F.col("a_source").alias("source"), F.col("b_source").alias("o_source"),
        (gap(a, b) - gap(a, b0) - gap(a0, b)).alias("out"), (gap(b, a) - gap(b, a0) - gap(b0, a)).alias("back"), F.lit(1).alias("both"),
    )
    sums = [F.sum(c).alias(c) for c in ("out", "back", "both")]
    one_way = alone.groupBy("lang", "source", "o_source").agg(*sums).unionByName(joint.groupBy("lang", "source", "o_source").agg(*sums))
    ways = one_way.select("lang", F.explode(F.array(
        F.struct("source", "o_source", F.col("out").alias("value"), "both"),
        F.struct(F.col("o_source").alias("source"), F.col("source").alias("o_source"), F.col("back").alias("value"), "both"),
    )).alias("w")).select("lang", "w.*").groupBy("lang", "source", "o_source").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    pairs = _with(groups, other, few, ["lang"]).where("source <> o_source").join(ways, ["lang", "source", "o_source"], "left")
    neither = F.col("v") - F.col("size") - F.col("o_size") + F.coalesce("both", F.lit(0))
    value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + neither * gap(F.col("p0"), F.col("o_p0"))).otherwise(F.lit(0)).cast("bigint")
    by_pair = pairs.select("lang", "source", F.col("o_source").alias("item"), value.alias("value")).withColumn("rank", ranked)
    found = by_pair.withColumn("part", F.lit("pair")).unionByName(by_term.withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
