"""Term counts behind the sketch, against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    """The contract, word for word. rows: text, lang, source."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if seen[t] >= least)
                counts[None].update(t for t in d[2] if seen[t] >= least)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in list(counts.items())}
        f = lambda a, b: (a - b) ** 2 // b
        for s in (s for s in counts if s is not None):
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o not in (None, s)]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def test_against_brute_force(corpus):
    rows = [tuple(r) for r in corpus.select("text", "lang", "source").collect()]
    found = divergence.audit(corpus)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_a_small_sketch_passes_more_but_changes_nothing(corpus):
    some = corpus.limit(60)
    rows = [tuple(r) for r in some.select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in divergence.audit(some, cells=257, rows=2).collect()) == brute(rows)


def test_sketch_never_underestimates(corpus):
    texts = corpus.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("binary").alias("text"))
    bits = divergence.possible(texts, 3, cells=1 << 16)
    passed = divergence.counted(texts.select("lang", F.lit("s").alias("source"), "text"), bits, cells=1 << 16)
    kept = {(r["lang"], r["term"]) for r in passed.groupBy("lang", "term").agg(F.sum("docs").alias("d")).collect()}
    every = Counter((r["lang"], t) for r in texts.collect() for t in set(divergence.terms(bytes(r["text"] or b""))))
    often = {k for k, n in every.items() if n >= 3}
    assert often <= {(lang, t.encode()) for lang, t in kept}
    assert len(kept) < len(every)  # and most that can't be kept are discarded


def test_odd_rows_repeats_and_ties(odd, spark):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    twice = odd.unionByName(odd).unionByName(odd)
    for least in (1, 3):
        assert sorted(tuple(r) for r in divergence.audit(twice, least).collect()) == brute(rows * 3, least)


def test_no_kept_terms_and_none(spark, none):
    rows = [("a b", "en", "s"), ("c", "en", None), (None, None, "t"), ("", None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert found == brute(rows) and {r[4] for r in found} == {0}
    assert divergence.audit(none).collect() == []


@pytest.mark.parametrize("count,total", [(0, 1), (0, 7), (3, 11), (10**12, 10**14), (10**14 - 1, 10**14), (9 * 10**14, 9 * 10**15)])
def test_shares_are_exact(spark, count, total):
    row = spark.createDataFrame([(count, total)], "c bigint, t bigint").select(divergence.share(F.col("c"), F.col("t"))).first()
    assert row[0] == 1 + 10**9 * (count + 1) // total
