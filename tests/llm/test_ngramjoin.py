import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import components, ngramjoin
from trackloom.llm.queries import op8_ngram_join
from trackloom.llm.shingles import WORDS


def plain(rows):
    """doc_id to (class_id, n_links, class_size, group_size) by comparing every pair of texts with a shingle in common."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[tuple(WORDS.findall(text or ""))].append(i)
    sets = {w: {w[j : j + 5] for j in range(max(1, len(w) - 4))} if w else set() for w in groups}
    holders = defaultdict(set)
    for w, s in sets.items():
        for x in s:
            holders[x].add(w)
    above, links = {w: w for w in groups}, Counter()

    def top(w):
        while above[w] != w:
            w = above[w]
        return w

    for w, s in sets.items():
        for o, n in Counter(o for x in s for o in holders[x] if o != w).items():
            if 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                links[w] += 1
                above[top(w)] = top(o)
    classes = defaultdict(list)
    for w, own in groups.items():
        classes[top(w)] += own
    return {i: (min(classes[top(w)]), links[w], len(classes[top(w)]), len(own)) for w, own in groups.items() for i in own}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["class_size"], r["group_size"]) for r in df.collect()}


def test_query_equals_brute_force(spark, texts):
    rows = op8_ngram_join(spark, "/root/testdata/sf0.001")
    assert got(rows) == plain(texts.items())
    assert rows.where("kept").count() == rows.select("class_id").distinct().count()


def copies(n_groups, size, seed=1):
    """Groups of near copies of various distance, and documents that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    passage = [word() for _ in range(30)]
    for _ in range(n_groups):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join([word() for _ in range(90)] + passage) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small, block, task", [(32, 192, 200_000), (3, 7, 200_000), (2, 5, 20)])
def test_small_and_large_buckets_agree(spark, monkeypatch, small, block, task):
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(components, "TASK_EDGES", task)
    rows = copies(3, 40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngramjoin.join(docs)) == plain(rows)


def test_shuffled_lookup_agrees(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BROADCAST_NODES", 0)
    rows = copies(2, 12, seed=5)
    assert got(ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_blocks_of_many_sizes_agree(spark, monkeypatch):
    """One large group whose texts differ in length by up to double: links cross the classes of sizes."""
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    monkeypatch.setattr(ngramjoin, "BLOCK", 6)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 900)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: rng.randint(100, 200)] if i % 2 else base[: 100 + 4 * i])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngramjoin.join(docs)) == plain(rows)


def test_measured_recall(spark):
    """Links found among pairs that differ at places all over the text, against all pairs: 0.9 at least, near 0.8 too."""
    rng = random.Random(4)
    rows = []
    for g in range(120):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(6):
            own = list(base)
            for k in range(rng.randint(0, 3)):
                own[rng.randrange(150)] = f"x{rng.random()}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    want = plain(rows)
    found = got(ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sum(x[1] for x in found.values()) >= 0.999 * sum(x[1] for x in want.values()) > 1_000
    assert all(found[i][1] <= want[i][1] for i in want)


def test_recall_of_the_bands():
    s = 0.8
    assert (1 - s**ngramjoin.ROWS) ** ngramjoin.BANDS < 2e-5


def test_nodes_agree(spark):
    for text in ("a  b\tc ", " a b c", "", "\n", "é ß\u0085x"):
        df = spark.createDataFrame([(text,)], "text string").select(ngramjoin.node_column(F.col("text")).alias("n"))
        assert bytes(df.first()["n"]) == ngramjoin.node_of(WORDS.findall(text))


def test_common_shingles():
    a = [np.array([1, 2, 3], dtype=np.uint64), np.array([], dtype=np.uint64)]
    b = [np.array([2, 3, 9], dtype=np.uint64), np.array([7], dtype=np.uint64), np.array([1], dtype=np.uint64)]
    assert ngramjoin.common_shingles(a, b).tolist() == [[2, 0, 1], [0, 0, 0]]


@pytest.mark.parametrize("task", [5, 1000])
def test_components(spark, monkeypatch, task):
    monkeypatch.setattr(components, "TASK_EDGES", task)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, rng.randrange(101, 140)) for _ in range(60)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(6)).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{v: 100 for _, v in edges[30:90]}, 100: 100, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_rows(odd, none):
    decisions = ngramjoin.join(odd)
    rows = decisions.collect()
    assert len(rows) == odd.count() and {r["n_links"] for r in rows} == {0}
    assert {(r["class_id"], r["class_size"]) for r in rows if r["doc_id"] in (1, 2, 5)} == {(1, 3)}
    assert sorted(r["kept"] for r in rows if r["doc_id"] in (3, 4)) == [False, False, True]
    kept = ngramjoin.keep(odd, decisions)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert ngramjoin.join(none).count() == 0
