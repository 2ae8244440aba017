"""Mixing sources to target weights, in DataFrame expressions only.

Each source's words are laid end to end, in a pseudorandom order of its documents, and packed into
blocks of a fixed number of words. The mix takes a number of blocks from each source that meets its
target, the source's slots. Every output shard draws how many slots of each source it has: the
counts are multinomial, given that a source's slots add up to what meets its target. A slot's place
in its source goes through a pseudorandom permutation of the source's block indexes, another one for
each time that the source is gone through. Blocks then join slots by (source, index).

The permutation is a swap-or-not network (Hoang, Morris and Rogaway, 2012): in each round an index x
and its partner (k - x mod n) change places or not, as a keyed bit of the greater of the two says (a universal hash modulo a prime, its upper half).
It is a bijection of 0..n-1 for any n, so no index has to be walked back into range.

A source of any size is dealt over many chunks of hashes: the place of a document is the chunk's
offset (a running sum over small chunk totals) plus its place within the chunk. All hashes are of
MD5, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import WORD, cut, text_digest, text_or_empty

BLOCK_WORDS = 64
#: Chunks are a power of two, so that they cut the order of the hashes into stretches.
CHUNK_ROWS, LEAST_CHUNK_BITS = 10_000, 8
OUTPUT_SHARDS = 64
MAX_REPEATS = 3
SEED = 20240229
HASH_BITS = 60
#: Rounds of the index permutation, and the prime of their bits.
ROUNDS, PRIME = 16, 2**31 - 1
#: Slots of a run, slots that a task makes from its runs, about, and tasks at most.
RUN, TASK_SLOTS, MOST_TASKS = 4096, 50_000, 20_000


def hashed(*parts: Column | str | int) -> Column:
    """HASH_BITS of the MD5 of the parts, joined by colons; null parts are passed over."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def permutation(n: Column, *key: Column | str | int) -> Column:
    """The rounds of a permutation of 0..n-1 under a key: each with its k and the factors of its bits."""
    drawn = lambda i, name, below: (hashed(*key, f"{name}{i}") % below).alias(name)
    return F.array(*[F.struct(drawn(i, "k", n), *[drawn(i, name, PRIME) for name in "abc"]) for i in range(ROUNDS)])


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """Where the permutation puts x, a long of 0..n-1. n may have HASH_BITS."""

    def swap(now: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - now, n)
        top = F.greatest(now, other)
        # two halves of 30 bits times factors of 31 and their sum fit in a long
        bit = (F.shiftright(top, 30) * r["a"] + top.bitwiseAND(F.lit(2**30 - 1)) * r["b"] + r["c"]) % PRIME < 2**30
        return F.when(bit, other).otherwise(now)

    return F.aggregate(rounds, x.cast("bigint"), swap)


def words_in(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """totals (sk, source_size) with target: weights by order of sk, stopped at MAX_REPEATS times the size.

    Sorted by cap over weight, the stopped sources are a prefix; the rest share what remains by
    weight. The windows run over one row per source.
    """
    by_name = W.orderBy("sk")
    by_cap = W.orderBy("ratio", "sk")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    cycle = F.array(*[F.lit(x) for x in weights])
    rated = totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))).withColumn(
        "ratio", MAX_REPEATS * F.col("source_size") / F.col("weight")
    )
    level = (
        F.sum("source_size").over(whole) - MAX_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        rated.withColumn("level", level)
        .withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sk", "level"))).over(whole)["level"])
        .select(
            "sk",
            "source_size",
            F.least((MAX_REPEATS * F.col("source_size")).cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.lit(0.0))).alias("target"),
        )
    )


def _slots_of(block_words: int) -> list[Column]:
    """Blocks of a source, and the slots whose words come nearest to its target."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    rounds = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("bigint")
    rest = F.coalesce(
        F.round(F.try_divide((F.col("target") - rounds * F.col("source_size")) * blocks, F.col("source_size"))), F.lit(0)
    ).cast("bigint")
    return [blocks.alias("blocks"), F.least(rounds * blocks + rest, MAX_REPEATS * blocks).alias("slots")]


def plan(docs: DataFrame, keys: dict[str, Column] | None = None, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, uses).

    rows: one per row of docs, with doc_id, the given keys, sk, chunk, place, size, source_size,
    target and start (its first word in its source). spans: rows dealt into blocks, with block and
    span_from, span_to (words of the document). uses: how often the mix takes each block, by shard.

    Null text has size 0 and is taken 0 times; a null source is a source of its own, last in order.
    Rows equal in every column are told apart by their place. A table without words has no slots.
    """
    keys = keys or {}
    sized = cut(
        docs.select(
            F.col("doc_id"),
            *[c.alias(k) for k, c in keys.items()],
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("sk"),
            words_in(F.col("text")).alias("size"),
            # the text counts too: rows without an id, or of one id, are not one chunk's
            hashed(seed, F.col("doc_id"), F.md5(text_or_empty(F.col("text")))).alias("_h"),
        )
    )
    bits = max(LEAST_CHUNK_BITS, (sized.count() // CHUNK_ROWS).bit_length())
    sized = sized.withColumn("chunk", F.shiftright("_h", HASH_BITS - bits))
    parts = cut(sized.groupBy("sk", "chunk").agg(F.sum("size").alias("words")))
    sources = cut(source_targets(parts.groupBy("sk").agg(F.sum("words").alias("source_size"))).select("*", *_slots_of(block_words)))
    before = W.partitionBy("sk").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).join(
        sources.select("sk", "source_size", "target"), "sk"
    )
    inside = W.partitionBy("sk", "chunk").orderBy("_h", "doc_id", "size", *keys)
    rows = (
        # merged: the sizes that Spark derives for what is exploded or read from checkpoints are no proof of a small side
        sized.join(offsets.drop("words").hint("merge"), ["sk", "chunk"])
        .withColumn("place", F.row_number().over(inside))
        .withColumn("start", F.col("offset") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .drop("_h", "offset")
    )
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    spans = (
        rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        .withColumn("span_from", F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)))
        .withColumn("span_to", F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size")))
    )
    return rows, spans, _uses(sources, shards, seed)


def _uses(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """sk, block, shard, n.

    Slots come in runs of at most RUN of one pass over a source, dealt out over a number of tasks that
    follows the slots, so one large source is generated by many tasks. The rounds of a pass's
    permutation come with its runs.
    """
    run = RUN
    tasks = min(MOST_TASKS, 1 + (sources.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS)
    passes = sources.where("slots > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / F.col("blocks")))))
    passes = passes.withColumn("count", F.least(F.col("blocks"), F.col("slots") - F.col("pass") * F.col("blocks")))
    # written, so that the rounds are made once for a pass, not again for each slot
    passes = cut(passes.select("sk", "pass", "blocks", "count", permutation(F.col("blocks"), seed, F.col("sk"), F.col("pass")).alias("rounds")))
    runs = passes.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / run)))).repartition(tasks, "sk", "pass", "run")
    slots = runs.withColumn("at", F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("count")) - 1)))
    block = permuted(F.col("at"), F.col("blocks"), F.col("rounds"))
    shard = hashed(seed, F.col("sk"), F.col("pass") * F.col("blocks") + F.col("at"), "shard") % shards
    return slots.select("sk", block.alias("block"), shard.alias("shard")).groupBy("sk", "block", "shard").agg(F.count(F.lit(1)).alias("n"))


def shard_counts(uses: DataFrame) -> DataFrame:
    """The drawn counts: blocks that each output shard has of each source."""
    return uses.groupBy("shard", "sk").agg(F.sum("n").alias("blocks"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted) and
    shard_words, the output shards that drew some of its words and how many (shard:words by shard,
    comma-joined, empty where none did); see plan."""
    _, spans, uses = plan(docs, None, block_words, shards, seed)
    row = ["sk", "chunk", "place", "doc_id", "size", "source_size", "target"]
    words = F.coalesce(F.sum((F.col("span_to") - F.col("span_from")) * F.col("n")), F.lit(0)).cast("bigint")
    by_shard = spans.join(uses.hint("merge"), ["sk", "block"], "left").groupBy(*row, "shard").agg(words.alias("words"))
    drawn = F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "words"))))  # a row per shard at most
    return (
        by_shard.groupBy(*row)
        .agg(F.sum("words").alias("taken"), drawn.alias("drawn"))
        .select(
            "doc_id", "size", "source_size", "target", "taken",
            F.array_join(F.transform("drawn", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string"))), ",").alias("shard_words"),
        )
    )


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself, in docs' columns: a row for each round in which a document is used, with its words taken then.

    A round that takes all blocks of a document keeps its text as it is; otherwise the text is the
    taken words with the white space after them. n_chars, where there is one, is the new length. Rows
    equal in id and text must have been brought to one before, as deduplication does.
    """
    # docs' columns travel as one, so that their names can't clash with those here
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest"))
    _, spans, uses = plan(docs, {"of_digest": text_digest(F.col("text"))}, block_words, shards, seed)
    taken = uses.groupBy("sk", "block").agg(F.sum("n").alias("n"))
    used = (
        spans.where("size > 0")
        .join(taken.hint("merge"), ["sk", "block"], "left")
        .groupBy("doc_id", "of_digest", "sk", "chunk", "place", "start")
        .agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).alias("n")))).alias("blocks"))
        .select(F.col("doc_id").alias("of_id"), "of_digest", (F.col("start") % block_words).alias("into"), F.transform("blocks", lambda b: b["n"]).alias("uses"))
        .where(F.array_max("uses") > 0)
    )
    rounds = keyed.join(used.hint("merge"), F.col("digest").eqNullSafe(F.col("of_digest")) & F.col("id").eqNullSafe(F.col("of_id"))).withColumn(
        "round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max("uses")))
    )
    whole = F.col("row.text").cast("string")  # taken from the row here, so that texts shuffle once
    pieces = F.regexp_extract_all(whole, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    block_of = lambda i: F.floor((i + F.col("into")) / block_words).cast("int")
    words = F.array_join(F.filter(pieces, lambda _, i: F.get("uses", block_of(i)) >= F.col("round")), "")
    one = rounds.withColumn("taken", F.when(F.array_min("uses") >= F.col("round"), whole).otherwise(words))
    out = {"text": F.col("taken")} | ({"n_chars": F.length("taken").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return one.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
