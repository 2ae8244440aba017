import re
from collections import Counter

from pyspark.sql import functions as F

from trackloom.llm import rules
from trackloom.llm.queries import op3_rules


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {j for i, x in enumerate(windows) if x in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for x in w for c in x),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_measurements_equal_brute_force(corpus, texts):
    for r in rules.measurements(corpus).collect():
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_query(spark, texts):
    for r in op3_rules(spark, "/root/testdata/sf0.001").collect():
        m = plain(texts[r["doc_id"]])
        assert r["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = op3_rules(spark, sf).join(labels, "doc_id").where("not base_failed")
    share = {r["quality"]: r["s"] for r in rated.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.2


def test_ledger_and_policies(corpus):
    rated = rules.ledger(corpus).cache()
    for i, (name, condition) in enumerate(rules.RULES.items()):
        assert rated.where(f"(fail_bits & {1 << i} <> 0) <> ({condition})").count() == 0, name
    for policy in rules.POLICIES:
        m = rules.mask(policy)
        bits = [r["fail_bits"] for r in rated.collect()]
        assert rules.apply_policy(rated, policy).where("kept").count() == sum(not b & m for b in bits)
        for r in rules.ablation(rated, policy).collect():
            assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
            assert r["n_only"] == sum(b & m == r["bit"] for b in bits)
            assert r["n_kept_without"] == sum(not b & m & ~r["bit"] for b in bits)


def test_no_python_in_the_plan(corpus):
    plan = rules.ledger(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in rules.ledger(odd).collect()}
    want = {(r["doc_id"], plain(r["text"])["n_words"], plain(r["text"])["n_repeat_words"]) for r in odd.collect()}
    assert got == want
    assert rules.ledger(none).count() == 0 and rules.ablation(rules.ledger(none), "v1").count() == 0
