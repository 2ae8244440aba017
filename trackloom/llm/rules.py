"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document; its failure is one bit of fail_bits, beside the
measurements. A policy is a versioned mask over those bits, so a new policy, or the effect of
leaving a rule out, reads the ledger alone and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE, text_or_empty

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"

#: Rule name to SQL condition of failure over the measurements. A rule's place is its bit: append, never reorder.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "exclamations": "100 * n_exclaims > 10 * n_words",
    "capitals": "100 * n_upper > 30 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
#: Policy version to the rules it applies.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": list(RULES),
    "v2_lenient": ["few_words", "repeated_windows", "symbols", "exclamations", "capitals"],
}


def mask(policy: str) -> int:
    bits = {name: 1 << i for i, name in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def _count_of(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), chars, ""))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each whole text.

    Repeated three-word windows are found by sorting (window hash, position) within the row: equal
    neighbours repeat. The hash has 64 bits, so that a text of 20,000 words has a false repeat with
    a chance near 1e-11.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("_t"))
    split = base.select(
        "doc_id",
        "_t",
        F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
    )
    windows = split.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("bigint").alias("word_chars"),
        _count_of("_t", SYMBOLS).cast("bigint").alias("n_symbols"),
        _count_of("_t", "!").cast("bigint").alias("n_exclaims"),
        _count_of("_t", UPPER).cast("bigint").alias("n_upper"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(
            F.when(
                F.size("_w") >= 3,
                F.transform(
                    F.slice("_w", 1, F.size("_w") - 2),
                    lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")),
                ),
            ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
        ).alias("_s"),
    )
    repeats = windows.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(
                    "_s",
                    lambda e, i: ((i > 0) & (F.get("_s", F.greatest(i - 1, F.lit(0)))["h"] == e["h"]))
                    | F.coalesce(F.get("_s", i + 1)["h"] == e["h"], F.lit(False)),
                ),
                lambda e: e["p"],
            )
        ),
    ).drop("_s")
    # a window covers 3 words, or as many as there are before the next repeated window
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    measured = repeats.withColumn("n_repeat_words", covered).drop("_p")
    # a generator holds back filters on the results, which would be pushed down as copies of all this inside its own lambdas
    return measured.select("doc_id", F.inline(F.array(F.struct(*[c for c in measured.columns if c != "doc_id"]))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, measurements and fail_bits.

    Null text has no words and fails few_words; a text without lines or words fails no ratio rule.
    Repeated rows are rated one by one. Other columns of docs are not read.
    """
    bits = None
    for i, condition in enumerate(RULES.values()):
        bit = F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(rated: DataFrame, policy: str) -> DataFrame:
    """rated with kept: whether no rule of the policy failed."""
    return rated.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablation(rated: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: n_failed, n_only (fails nothing else), n_kept and n_kept_without the rule.

    The ledger is first counted by failure bits, so what follows has at most 2^rules rows.
    """
    m = mask(policy)
    counted = rated.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, name in enumerate(RULES) if m >> i & 1]
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return (
        counted.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            total(F.col("bits") == F.col("r.bit")).alias("n_only"),
            total(F.col("bits") == 0).alias("n_kept"),
            total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        )
    )
