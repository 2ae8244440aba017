"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of five-word shingles. Texts with the same words are one node. A node has BANDS
values, each the hash of ROWS least hashes; nodes that share a value (a bucket) are candidates, and
candidates are verified on their full shingle sets. With 48 bands of 7 rows a pair of similarity
0.8 is missed with a chance of 1.2e-5, one of 0.9 with 1e-13; a pair of 0.2 is a candidate with 6e-4.

Buckets shuffle as (value, node); texts never shuffle: only candidates' sets of shingle hashes do.
Buckets of at most SMALL nodes give candidate pairs, bounded per node by BANDS * SMALL. Larger
buckets never give pairs of rows: the nodes they connect are dealt by the size of their sets, as sets
that differ in size by more than the similarity allows can't link, and then into blocks of about
BLOCK nodes and BLOCK_SHINGLES shingles. A task verifies all pairs of two blocks by a matrix product,
giving only each node's count of links and a spanning forest of them. So a group of any size is
verified in full in tasks of bounded size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, keep_rows, map_texts, normalised, small_batches
from trackloom.llm.components import components
from trackloom.llm.shingles import WORDS, shingle_set

SHINGLE = 5
#: Similarity at which two texts link, as a fraction.
LINK = (4, 5)
BANDS, ROWS = 48, 7
SMALL = 32
#: Nodes and shingles of a block, about; a larger set is a block with few others.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Sizes of sets in one class are within this factor, so sets that link are in one class or two neighbours (5/4, and a little for rounding).
CLASS = 1.26
#: Nodes up to which the set of nodes to verify is broadcast (about 100 bytes each); beyond, it is shuffled.
BROADCAST_NODES = 200_000


def _functions():
    import numpy as np

    rng = np.random.default_rng(31)
    n = BANDS * ROWS
    return (rng.integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles, functions, buffer):
    """The least value of each function over the shingles."""
    import numpy as np

    a, b = functions
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), len(buffer)):
        part = x[i : i + len(buffer)]
        out = buffer[: len(part)]
        np.multiply(part[:, None], a, out=out)
        out += b
        np.minimum(least, out.min(axis=0), out=least)
    return least


def band_values(signatures):
    """One 64-bit value per band: signatures (documents x functions) to documents x bands."""
    import numpy as np

    from trackloom.llm.shingles import mixed

    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return h.view(np.int64)


def node_of(words: list[str]) -> bytes:
    """16 bytes that stand for a sequence of words; the same as node_column's."""
    return hashlib.sha256(" ".join(words).encode()).digest()[:16]


def node_column(text):
    return F.unhex(F.substring(F.sha2(F.trim(normalised(text)), 256), 1, 32))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, bands and n_shingles of each text; a text without words has no bands."""

    def rate(ids, texts):
        import numpy as np

        functions, buffer = _functions(), np.empty((1024, BANDS * ROWS), dtype=np.uint32)
        nodes, sizes, signatures = [], [], []
        for text in texts:
            words = WORDS.findall(text or "")
            shingles = shingle_set(words, SHINGLE)
            nodes.append(node_of(words))
            sizes.append(len(shingles))
            signatures.append(signature(shingles, functions, buffer))
        bands = band_values(np.stack(signatures))
        return [ids, nodes, [b if n else [] for b, n in zip(bands, sizes, strict=True)], sizes]

    return map_texts(docs, rate, "node binary, bands array<bigint>, n_shingles int", id_col, text_col)


def links(x: int, y: int, common: int) -> bool:
    """Whether sets of x and y shingles with so many in common have a similarity of LINK at least."""
    return common * LINK[1] >= (x + y - common) * LINK[0]


def _groups(batches, keys: int):
    """(key, rows) of sorted batches; the rows of a key are adjacent, over any number of batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _verify_pairs(batches):
    """Rows (a, own, b, shingles) sorted by a with a's own set first, to links (a, b). Holds one pair at a time."""
    import numpy as np
    import pyarrow as pa

    last = of = None
    for batch in batches:
        left, right = [], []
        for a, own, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shingles = np.frombuffer(raw, dtype=np.uint64)
            if own == 0:
                last, of = a, shingles
            elif a == last and links(len(of), len(shingles), len(np.intersect1d(of, shingles, assume_unique=True))):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def common_shingles(first: list, second: list):
    """Shingles in common of each of first with each of second, by products of incidence matrices."""
    import numpy as np

    every, place = np.unique(np.concatenate([*first, *second]), return_inverse=True)
    count = np.bincount(place, minlength=len(every))
    shared = np.cumsum(count > 1) - 1  # a shingle of one text alone is in common with none
    use = (count > 1)[place]
    owner = np.repeat(np.arange(len(first) + len(second)), [len(s) for s in [*first, *second]])[use]
    column = shared[place[use]]
    total = np.zeros((len(first), len(second)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(first) + len(second), 4096), dtype=np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        total += m[: len(first)] @ m[len(first) :].T
    return total.astype(np.int64)


def _verify_blocks(batches):
    """Rows (root, i, j, block, node, shingles) sorted by root, i, j to (node, other, links): per node
    and pair of blocks the links it has there, and the edges of a spanning forest with 0."""
    import numpy as np
    import pyarrow as pa

    for (_, i, j), rows in _groups(batches, 3):
        sides = [[(n, np.frombuffer(raw, dtype=np.uint64)) for k, n, raw in rows if k == side] for side in dict.fromkeys((i, j))]
        first, second = sides[0], sides[-1]
        if not first or not second:
            continue
        x, y = (np.array([len(s) for _, s in side])[:, None] for side in (first, second))
        common = common_shingles([s for _, s in first], [s for _, s in second])
        linked = common * LINK[1] >= (x + y.T - common) * LINK[0]
        if i == j:
            np.fill_diagonal(linked, False)
        counts = [*zip((n for n, _ in first), linked.sum(1).tolist(), strict=True)]
        if i != j:
            counts += zip((n for n, _ in second), linked.sum(0).tolist(), strict=True)
        out = [(n, None, k) for n, k in counts if k]
        above: dict[bytes, bytes] = {}

        def top(n):
            while (m := above.get(n, n)) != n:
                above[n] = above.get(m, m)
                n = m
            return n

        for p, q in zip(*np.nonzero(linked), strict=True):
            if (u := top(first[p][0])) != (v := top(second[q][0])):
                above[max(u, v)] = min(u, v)
        out += [(n, top(n), 0) for n in above if top(n) != n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())],
            names=["node", "other", "links"],
        )


def _lookup(df: DataFrame) -> DataFrame:
    """df as the side of a join that has each key once: broadcast if it is small when counted, else
    shuffled. It is written first, so that the join is not tied to the partitions that made it and
    AQE can split a key of very many rows on the other side."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df.hint("merge")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b from small buckets, hot nodes with their n_shingles and the root of what large buckets connect)."""
    entries = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # most values are of one node alone, so this drops most entries, without a shuffle where the rest are few
    members = cut(entries.join(_lookup(buckets), "bucket"))
    crowded = members.where(F.col("n") > SMALL).select("bucket", "node")
    leads = crowded.groupBy("bucket").agg(F.min("node").alias("lead"))
    hot = components(crowded.join(_lookup(leads), "bucket").select("node", "lead"))
    hot = cut(nodes.select("node", "n_shingles").join(_lookup(hot), "node"))
    small = members.where(F.col("n") <= SMALL).select("bucket", "node", "n_shingles")
    other = small.withColumnsRenamed({"node": "b", "n_shingles": "n_b"})
    pairs = (
        small.withColumnsRenamed({"node": "a", "n_shingles": "n_a"})
        .join(other, "bucket")
        # sets this different in size can't reach the similarity
        .where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * LINK[1] >= F.greatest("n_a", "n_b") * LINK[0]))
        .select("a", "b")
        .distinct()
    )
    of = lambda side: hot.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)))
    return cut(apart.select("a", "b")), hot


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and shingles, the bytes of its sorted 64-bit hashes, for each of nodes (node, least_id).
    Only the row of a node's least id is read, so copies do no work."""
    wanted = _lookup(nodes.select(F.col("node").alias("_node"), F.col("least_id").alias("_id")))
    rows = docs.select(node_column(F.col(text_col)).alias("node"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def rate(ids, texts):
        return [ids, [shingle_set(WORDS.findall(t or ""), SHINGLE).tobytes() for t in texts]]

    sets = map_texts(chosen, rate, "shingles binary", "node").withColumnRenamed("doc_id", "node")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _dealt(hot: DataFrame) -> DataFrame:
    """root, i, j, block, node: each node once for every pair of blocks that its own block is in.

    Groups that fill no block are one; in others a block is of one class of sizes and meets its own
    class and both neighbours. A block is called by class and number.
    """
    whole = hot.groupBy("root").agg(((F.count(F.lit(1)) <= BLOCK) & (F.sum("n_shingles") <= BLOCK_SHINGLES)).alias("one"))
    of = F.floor(F.log(CLASS, F.col("n_shingles").cast("double"))).cast("int")
    classed = cut(hot.join(_lookup(whole), "root").select("root", "node", "n_shingles", F.when(F.col("one"), F.lit(0)).otherwise(of).alias("cls")))
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(classed.groupBy("root", "cls").agg(n.alias("blocks")))
    near = sizes.select("root", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), F.col("cls").alias("with_cls"), F.col("blocks").alias("with_blocks"))
    meets = sizes.join(near.hint("merge"), ["root", "cls"]).groupBy("root", "cls", "blocks").agg(F.collect_list(F.struct("with_cls", "with_blocks")).alias("meets"))  # three at most
    named = lambda cls, block: F.struct(cls.alias("c"), block.alias("b"))
    others = F.flatten(F.transform("meets", lambda m: F.transform(F.sequence(F.lit(0), m["with_blocks"] - 1), lambda k: named(m["with_cls"], k))))
    rows = classed.join(_lookup(meets), ["root", "cls"]).withColumn("own", named(F.col("cls"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    pairs = rows.select("root", "node", "own", F.explode(others).alias("with"))
    name = lambda x: F.concat_ws(".", x["c"].cast("string"), x["b"].cast("string"))
    return pairs.select("root", name(F.least("own", "with")).alias("i"), name(F.greatest("own", "with")).alias("j"), name(F.col("own")).alias("block"), "node")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, class_size, group_size, kept.

    class_id: the smallest doc_id among the texts that links connect. n_links: the different texts
    that this one links to; copies are not counted. group_size: rows with the same words.
    class_size: rows of the class. kept: true for one row of each class, that of the smallest doc_id.
    Null text counts as empty; texts without words are copies of each other and link to no other. A
    null id loses to any other. Rows equal in id and words are one document repeated, of which one
    row at most is kept. Other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = cut(signed(docs, id_col, text_col))
    nodes = cut(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("group_size"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")
        )
    )
    pairs, hot = _candidates(nodes)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    sets = cut(_sets(docs, nodes.select("node", "least_id").join(_lookup(wanted), "node"), id_col, text_col))

    own = pairs.select("a").distinct().join(sets, F.col("a") == F.col("node")).select("a", F.lit(0).alias("own"), F.col("a").alias("b"), "shingles")
    met = pairs.join(sets, F.col("b") == F.col("node")).select("a", F.lit(1).alias("own"), "b", "shingles")
    linked = cut(
        own.union(met).repartition("a").sortWithinPartitions("a", "own").mapInArrow(_verify_pairs, "a binary, b binary")
    )
    blocks = cut(
        _dealt(hot)
        .join(sets, "node")
        .select("root", "i", "j", "block", "node", "shingles")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
        .mapInArrow(_verify_blocks, "node binary, other binary, links bigint")
    )
    classes = components(linked.union(blocks.where(F.col("other").isNotNull()).select("node", "other")))
    ends = linked.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("links"))
    counts = ends.union(blocks.where(F.col("other").isNull()).select("node", "links")).groupBy("node").agg(F.sum("links").alias("n_links"))
    rooted = (
        nodes.select("node", "least_id", "group_size")
        .join(classes, "node", "left")
        .join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("bigint")))
    )
    rooted = cut(rooted)
    roots = rooted.groupBy("root").agg(
        F.min("least_id").alias("class_id"),
        F.min(F.struct(F.col("least_id").isNull(), "least_id", "node"))["node"].alias("first_node"),
        F.sum("group_size").alias("class_size"),
    )
    decided = cut(rooted.join(_lookup(roots), "root").select("node", "least_id", "group_size", "n_links", "class_id", "class_size", (F.col("node") == F.col("first_node")).alias("leads")))
    # a node of very many rows is split by AQE: both sides are plain exchanges
    per_row = rows.select("doc_id", "node").groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    return (
        cut(per_row)
        .join(decided, "node")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(
            "doc_id", "class_id", "n_links", "class_size", "group_size",
            (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("node"),
        )
    )


def keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions keeps, with docs' own columns."""
    return keep_rows(docs, node_column(F.col("text")), decisions.select("doc_id", F.col("node").alias("key"), "kept"))
