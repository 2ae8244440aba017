import math
import zlib

import numpy as np

from trackloom.llm import quality
from trackloom.llm.queries import op10_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit(x, y)
    test = rng.uniform(size=(2000, 3))
    want = (test[:, 0] > 0.5) ^ (test[:, 1] > 0.5)
    assert ((model.score(test) > 0.5) == want).mean() > 0.93
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500)
    model = quality.fit(x, y)
    for row, got in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.intercept
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[sum(e <= row[j] for e in edges)]
        at = [sum(e <= row[j] for e in edges) for j, edges in enumerate(model.pair_edges)]
        total += sum(table[at[i], at[j]] for i, j, table in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_few_labels():
    for y in ([], [1], [1, 1], [0, 1]):
        score = quality.fit(np.zeros((len(y), len(quality.FEATURES))), y).score(np.zeros((2, len(quality.FEATURES))))
        assert ((score > 0) & (score < 1)).all()


def test_features_of_any_text():
    for text in ("", " ", "\n\n", "a", "\U0001f600" * 3, "x" * 100_000, "A!! B!! ퟿"):
        f = quality.features(text)
        assert len(f) == len(quality.FEATURES) and np.isfinite(f).all()


def plain_features(text):
    """The features, counted one character or word at a time."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    chars = max(1, sum(not c.isspace() for c in text))
    kinds = {"upper": str.isupper, "digits": str.isdigit}
    marks = quality.MARKS
    share = {k: sum(of(c) and not c.islower() and c not in marks for c in text) / chars for k, of in kinds.items()}
    other = sum(not (c.islower() or c.isupper() or c.isdigit() or c.isspace() or c in marks) for c in text) / chars
    w, m = max(1, len(words)), max(1, len(lines))
    per = lambda some: sum(c in some for c in text) / w
    counts = [words.count(x) for x in set(words)]
    return [
        math.log(1 + len(words)), chars / w if words else 0.0, share["upper"], share["digits"], other, per(marks), per("."), per(","), per("!"), per("|"), per("#*$%&<>"),
        len(set(words)) / w, math.log(1 + len(lines)), len(words) / m, (len(lines) - len(set(lines))) / m, max(counts, default=0) / w,
        math.log(1 + max(map(len, words), default=0)), sum(x.istitle() for x in words) / w,
    ]


def test_query_equals_brute_force(spark, texts):
    """Features by hand, one fit in memory over the labelled rows that are not held out, scores from it."""
    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    x = {i: plain_features(t or "") for i, t in texts.items()}
    for i, t in texts.items():
        assert np.allclose(x[i], quality.features(t or ""), rtol=1e-12, atol=1e-12)
    learnt = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    exact = {i: quality.features(t or "") for i, t in texts.items()}  # binning is sensitive to the last bit
    model = quality.fit(np.array([exact[i] for i in learnt]), [labels[i] for i in learnt])
    want = dict(zip(exact, model.score(np.array(list(exact.values()))), strict=True))
    got = {r["doc_id"]: r["score"] for r in op10_quality(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_ties_are_decided_by_order(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40 + 1)) for i in range(200)] + [(5, "AAA BBB"), (5, "zz")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1 - i % 2) for i in range(0, 200, 7)], "doc_id bigint, quality int")
    first, again = quality.learn(docs, labels), quality.learn(docs.repartition(7), labels.repartition(5).orderBy("quality"))
    x = np.array([quality.features(t) for t in ("word " * 9, "AAA", "")])
    assert (first.score(x) == again.score(x)).all()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (4, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.learn(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    kept = odd.where(quality.score_column(model) >= 0.0)
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert quality.score(none, quality.learn(none, labels)).count() == 0
