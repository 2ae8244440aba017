"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, divergence, exactdedup, langid, licenses, mixing, ngramjoin, packing, quality, quantiles, rules, secrets, tokencounts
from trackloom.llm.common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rules.apply_policy(rules.ledger(documents(spark, sf_dir)), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base")).cast("bigint")) != 0
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exactdedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))).create()
    try:
        return exactdedup.dedup(documents(spark, sf_dir), index, "documents")
    finally:
        index.drop()  # the decisions are in the shared folder by now


def digest_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in three batches that follow one another into one index, which is compacted before
    the last: batch, doc_id, keep_id, group_size (within the batch), kept."""
    at = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 1)
    docs = documents(spark, sf_dir).withColumn("_batch", F.when(at < "5", 0).when(at < "a", 1).otherwise(2))
    index = exactdedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))).create()
    try:
        found = []
        for k in range(3):
            found.append(exactdedup.dedup(docs.where(F.col("_batch") == k), index, f"batch {k}").select(F.lit(k).alias("batch"), "doc_id", "keep_id", "group_size", "kept"))
            if k == 1:
                index.compact()
        return found[0].unionByName(found[1]).unionByName(found[2])
    finally:
        index.drop()  # the decisions are in the shared folder by now


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_sections(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN)


def token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a document by its fields, source and text; a token of both is shared by its characters."""
    counted = tokencounts.count_fields(documents(spark, sf_dir), ["source", "text"], VOCABULARY, public_tokenizers.PATTERN, "share")
    of = lambda i: F.round(F.col("field_tokens")[i], 6)
    return counted.select("doc_id", "doc_tokens", of(0).alias("source_tokens"), of(1).alias("text_tokens"))


def _fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(docs.where(_fold(3) != 1))
    return langid.predict(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels.where(_fold(5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(documents(spark, sf_dir)).drop("node")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of click values by client and of the prices of sold items by brand."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    one = read("clicks").groupBy("click_id").agg(F.max(F.struct("client_id", "value")).alias("k"))
    kinds = lambda stream, grp, batch, money: (F.lit(stream).alias("stream"), grp.cast("string").alias("grp"), batch.alias("batch"), money.alias("money"))
    values = one.select(*kinds("value", F.col("k.client_id"), quantiles.batch_of(F.col("click_id"), 4), F.col("k.value")), F.lit(1).cast("bigint").alias("c"))
    # lines of an item in a batch are counted before they meet the item; neither side is broadcast, as both grow
    sold = read("sale_lines").where("item_id is not null").groupBy("item_id", quantiles.batch_of(F.col("vendor_id"), 4).alias("batch")).agg(F.count(F.lit(1)).alias("c"))
    items = read("items").select("item_id", "brand", "price")
    prices = sold.hint("merge").join(items, "item_id").select(*kinds("price", F.col("brand"), F.col("batch"), F.col("price")), "c")
    return quantiles.summarised(values.unionByName(prices), parts=4, least=20)


#: The id that ends a document in a packed sequence, and a sequence's tokens.
END_ID, SEQUENCE = 1, 4096


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        pieces = packing.encoded_pieces(documents(spark, sf_dir), f.read(), END_ID, SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository, outside this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    """Queries by name: the operators, the pipeline, operator 4 in batches and operator 6 by fields."""
    ten = (op1_secrets, op2_licenses, op3_rules, op4_exact_dedup, op5_bpe, op6_token_counts, op7_language, op8_ngram_join, op9_mix, op10_quality)
    return {f.__name__: f for f in (pipeline, *ten, op11_divergence, op12_quantiles, op13_packing, digest_index_batches, token_fields)}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_EXACT = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

_BATCHES = r"""
WITH d AS (SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '5' THEN 0 WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < 'a' THEN 1 ELSE 2 END AS batch,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents),
f AS (SELECT t, min(batch) AS batch FROM d GROUP BY t),
k AS (SELECT t, min(doc_id) AS keep_id FROM d JOIN f USING (t, batch) GROUP BY t)
SELECT CAST(batch AS INT) AS batch, doc_id, keep_id, count(*) OVER (PARTITION BY batch, t) AS group_size, doc_id = keep_id AS kept FROM d JOIN k USING (t)"""

_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM
    (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d) a) b),
rep AS (SELECT doc_id, sum(least(3, coalesce(next - p, 3))) AS n FROM
    (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM win WHERE n > 1) c GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_exclaims,
    CAST(length(t) - length(translate(t, '{rules.UPPER}', '')) AS BIGINT) AS n_upper,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(rules.RULES.values()))} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {rules.mask("base")} <> 0 AS base_failed,
    fail_bits & {rules.mask("v1")} = 0 AS kept, fail_bits FROM b"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT w, min(doc_id) AS id, count(*) AS group_size FROM d GROUP BY w),
s AS (SELECT DISTINCT id, array_to_string(w[p:p + 4], ' ') AS s FROM
    (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM n WHERE len(w) > 0) a),
c AS (SELECT id, count(*) AS k FROM s GROUP BY id),
pairs AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS (SELECT u, v FROM pairs JOIN c cu ON cu.id = u JOIN c cv ON cv.id = v WHERE shared * 5 >= 4 * (cu.k + cv.k - shared)),
e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(u, v) AS (SELECT id, id FROM n UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
cls AS (SELECT u AS id, min(v) AS class_id FROM reach GROUP BY u),
sized AS (SELECT class_id, sum(group_size) AS class_size FROM n JOIN cls USING (id) GROUP BY class_id),
deg AS (SELECT u AS id, count(*) AS n_links FROM e GROUP BY u)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(class_size AS BIGINT) AS class_size, n.group_size, d.doc_id = class_id AS kept
FROM d JOIN n ON n.w = d.w JOIN cls ON cls.id = n.id JOIN sized USING (class_id) LEFT JOIN deg ON deg.id = n.id"""


def _hash(parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 15) AS BIGINT)"


def _round(i: int) -> str:
    """A round of the index permutation: x{i} to x{i + 1}."""
    f = f"k[{i + 1}]"
    bit = f"((greatest(x, o) >> 30) * {f}.a + (greatest(x, o) & {2**30 - 1}) * {f}.b + {f}.c) % {mixing.PRIME} < {2**30}"
    return f"x{i + 1} AS MATERIALIZED (SELECT sk, n, pass, i, k, CASE WHEN {bit} THEN o ELSE x END AS x FROM (SELECT *, (({f}.k - x) % n + n) % n AS o FROM x{i}) a)"


def _factors(i: int) -> str:
    each = (f"'{name}': " + _hash(f"'{mixing.SEED}', sk, pass, '{name}{i}'") + f" % {below}" for name, below in (("k", "n"), *((x, mixing.PRIME) for x in "abc")))
    return "{" + ", ".join(each) + "}"


_MIX = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
    CAST(len({_WORDS}) AS BIGINT) AS size, {_hash(f"'{mixing.SEED}', doc_id, md5(coalesce(text, ''))")} AS h FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM (SELECT *, 1 + (row_number() OVER (ORDER BY sk) - 1) % 3 AS weight FROM s) a),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM r WINDOW b AS (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sk, source_size, CAST(ceil(source_size / {mixing.BLOCK_WORDS}) AS BIGINT) AS n, least(CAST(3 * source_size AS DOUBLE),
    coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, sk LIMIT 1) * weight, 0)) AS target FROM l),
q AS (SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS whole FROM t),
c AS (SELECT sk, n, least(whole * n + coalesce(CAST(round((target - whole * source_size) * n / nullif(source_size, 0)) AS BIGINT), 0), 3 * n) AS slots FROM q),
slot AS (SELECT sk, n, i // n AS pass, i, i % n AS x FROM (SELECT sk, n, unnest(range(slots)) AS i FROM c) a),
k AS MATERIALIZED (SELECT sk, n, pass, [{", ".join(map(_factors, range(mixing.ROUNDS)))}] AS k
    FROM (SELECT DISTINCT sk, n, pass FROM slot) a),
x0 AS (SELECT slot.*, k.k FROM slot JOIN k USING (sk, n, pass)),
{", ".join(map(_round, range(mixing.ROUNDS)))},
u AS (SELECT sk, x AS block, {_hash(f"'{mixing.SEED}', sk, i, 'shard'")} % {mixing.OUTPUT_SHARDS} AS shard, count(*) AS uses FROM x{mixing.ROUNDS} GROUP BY ALL),
o AS (SELECT *, sum(size) OVER (PARTITION BY sk ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
p AS (SELECT rid, sk, size, start, unnest(range(CAST(start // {mixing.BLOCK_WORDS} AS BIGINT), CAST((start + size - 1) // {mixing.BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM o WHERE size > 0),
w AS (SELECT rid, shard, CAST(sum(uses * (least((block + 1) * {mixing.BLOCK_WORDS} - start, size) - greatest(block * {mixing.BLOCK_WORDS} - start, 0))) AS BIGINT) AS words
    FROM p JOIN u USING (sk, block) GROUP BY rid, shard),
m AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shard_words FROM w GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(shard_words, '') AS shard_words
FROM d JOIN t USING (sk) LEFT JOIN m USING (rid)"""


_DIVERGENCE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, id, term, count(*) AS n FROM (SELECT lang, source, id, unnest(w) AS term FROM d) a GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) a
    LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) b USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) e USING (lang, source)),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (total + v) AS p
    FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) a
    JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) b USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tops AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM
    (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM tops) r
WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express: not lexing, merges by rank, compression or fitted scores."""
    return {"op3_rules": _RULES, "op4_exact_dedup": _EXACT, "op8_ngram_join": _JACCARD, "op9_mix": _MIX, "op11_divergence": _DIVERGENCE, "digest_index_batches": _BATCHES}
