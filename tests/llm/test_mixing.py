import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """The contract's rule, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, stopped = {s: 0.0 for s in names}, set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(stopped) < len(names):
        share = left / sum(weight[s] for s in names if s not in stopped)
        left = 0.0
        for s in names:
            if s not in stopped:
                target[s] += share * weight[s]
                if target[s] >= 3 * sizes[s]:
                    left += target[s] - 3 * sizes[s]
                    target[s] = 3.0 * sizes[s]
                    stopped.add(s)
    return target


def by_source(docs, mixed):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    out = defaultdict(Counter)
    for r in mixed.collect():
        out[source[r["doc_id"]]].update(size=r["size"], taken=r["taken"])
        out[source[r["doc_id"]]]["target"] = r["target"]
    return out


def test_mix_of_the_corpus(corpus, texts):
    mixed = mixing.mix(corpus).cache()
    assert {r["doc_id"]: r["size"] for r in mixed.collect()} == {i: n_words(t) for i, t in texts.items()}
    found = by_source(corpus, mixed)
    want = targets({s: c["size"] for s, c in found.items()})
    for s, c in found.items():
        assert c["target"] == pytest.approx(want[s])
        assert abs(c["taken"] - c["target"]) <= mixing.BLOCK_WORDS * 2
    assert mixed.where("taken > 3 * size or taken < 0").count() == 0
    again = mixing.mix(corpus.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_scarce_sources_stop_at_three_times(spark):
    rows = [(i, "w " * 500, "a") for i in range(40)] + [(100 + i, "w " * 30, "b") for i in range(4)] + [(200, "w " * 10, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs)
    found = by_source(docs, mixed)
    want = targets({"a": 20_000, "b": 120, None: 10})
    assert {s: c["target"] for s, c in found.items()} == pytest.approx(want) and want["b"] == 360 and want[None] == 30
    assert found["b"]["taken"] == 360 and found[None]["taken"] == 30
    assert mixed.where("taken > 3 * size").count() == 0


def test_permutations_and_shards(corpus):
    rows, spans, uses = mixing.plan(corpus, block_words=16, shards=8)
    per = uses.groupBy("sk", "block").agg(F.sum("n").alias("n")).groupBy("sk").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("m"))
    blocks = {r["sk"]: r["m"] for r in spans.where("size > 0").groupBy("sk").agg(F.count_distinct("block").alias("m")).collect()}
    for r in per.collect():
        assert r["hi"] - (r["lo"] if r["m"] == blocks[r["sk"]] else 0) <= 1 and r["hi"] <= 3
    total = {r["sk"]: r["n"] for r in uses.groupBy("sk").agg(F.sum("n").alias("n")).collect()}
    drawn = mixing.shard_counts(uses).collect()
    assert sum(r["blocks"] for r in drawn) == sum(total.values()) and len({r["shard"] for r in drawn}) == 8
    for r in drawn:  # five deviations of the binomial
        mean = total[r["sk"]] / 8
        assert abs(r["blocks"] - mean) <= 5 * mean**0.5 + 5
    assert rows.count() == corpus.count()


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        rows = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        at = mixing.permuted(F.col("id"), F.col("n"), mixing.permutation(F.col("n"), 1, "s", F.lit(0)))
        assert sorted(r[0] for r in rows.select(at).collect()) == list(range(n))


def test_permutation_of_very_many_blocks(spark):
    """Beyond 2^32 blocks: rounds taken backwards give the index again, and images are spread evenly."""
    n = 5 * 2**33 + 17
    rows = spark.range(0, n, n // 2_000).withColumn("n", F.lit(n).cast("bigint"))
    rounds = mixing.permutation(F.col("n"), 9, "s", F.lit(2))
    there = rows.select("id", "n", rounds.alias("r"), mixing.permuted(F.col("id"), F.col("n"), rounds).alias("y"))
    back = there.select("id", "n", "y", mixing.permuted(F.col("y"), F.col("n"), F.reverse("r")).alias("x")).collect()
    assert all(r["x"] == r["id"] and 0 <= r["y"] < n for r in back) and len({r["y"] for r in back}) == len(back)
    per_tenth = Counter(r["y"] * 10 // n for r in back)
    assert all(abs(per_tenth[i] - 200) < 75 for i in range(10))


def test_taken_equals_brute_force(corpus, texts):
    """The words of each document laid out in order, block by block, from the drawn uses."""
    block = 16
    rows, _, uses = mixing.plan(corpus, block_words=block, shards=8)
    times, of_shard = Counter(), defaultdict(Counter)
    for r in uses.collect():
        times[r["sk"], r["block"]] += r["n"]
        of_shard[r["sk"], r["block"]][r["shard"]] += r["n"]
    ends = defaultdict(int)
    for r in rows.collect():
        assert r["size"] == n_words(texts[r["doc_id"]])
        ends[r["sk"]] = max(ends[r["sk"]], r["start"] + r["size"])
    want = {}
    for r in rows.collect():
        spread = Counter()
        for w in range(r["start"], r["start"] + r["size"]):
            spread.update(of_shard[r["sk"], w // block])
        want[r["doc_id"]] = (sum(times[r["sk"], w // block] for w in range(r["start"], r["start"] + r["size"])), ",".join(f"{s}:{n}" for s, n in sorted(spread.items())))
    got = {r["doc_id"]: (r["taken"], r["shard_words"]) for r in mixing.mix(corpus, block_words=block, shards=8).collect()}
    assert got == want
    # every source's words are one stretch without gaps
    sizes = Counter()
    for r in rows.collect():
        sizes[r["sk"]] += r["size"]
    assert sizes == ends


def test_no_python_in_the_plan(corpus):
    plan = mixing.mix(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_mixed_documents_hold_the_words_taken(corpus, texts):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(corpus).collect()}
    mixed = mixing.mixed_documents(corpus)
    assert mixed.columns == corpus.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += n_words(r["text"])
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(texts[r["doc_id"]].split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_odd_rows(odd, none):
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert sorted(r["size"] for r in mixed if r["doc_id"] in (1, 2, 5)) == [0, 0, 0]
    out = mixing.mixed_documents(odd.dropDuplicates(["doc_id", "text"]))
    assert out.columns == odd.columns and {r["score"] for r in out.collect()} == {"mine"}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    wordless = mixing.mix(odd.where("doc_id in (1, 2, 5)")).collect()
    assert [(r["taken"], r["target"]) for r in wordless] == [(0, 0.0)] * 3
