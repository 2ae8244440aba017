import math
import re
import zlib

import zstandard
from pyspark.sql import functions as F

from trackloom.llm import langid
from trackloom.llm.queries import op7_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in held]
    assert sum(right) / len(right) > 0.97
    sure = [ok for r, ok in zip(held, right, strict=True) if not r["rejected"]]
    assert sum(sure) / len(sure) >= sum(right) / len(right)


def test_smallest_wins_and_close_calls_are_rejected():
    model = langid.Model({"aa": b"the quick brown fox jumps over the lazy dog again and again " * 20, "bb": b"le renard brun saute par dessus le chien paresseux encore " * 20})
    lang, score, rejected = langid.classify("The LAZY dog jumps over the quick brown fox again", model)
    assert (lang, rejected) == ("aa", False) and score > 0.5
    assert langid.classify("zq", model)[2]
    assert langid.classify("zq", langid.Model({"x": b"", "w": b""}))[0] == "w"


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50, "en" if i % 2 else "de") for i in range(300)], "doc_id bigint, text string, lang string")
    model = langid.learn(docs, excerpts=10)
    assert sorted(model.dictionaries) == ["de", "en"]
    assert all(0 < len(d) <= 10 * (langid.EXCERPT_CHARS + 1) for d in model.dictionaries.values())
    assert langid.learn(docs.repartition(5), excerpts=10) == model


def plain_sizes(text, model):
    """Sizes from a compressor made anew for each text and language."""
    raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    out = {}
    for lang, data in model.dictionaries.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        packed = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        assert plain.decompress(packed, max_output_size=len(raw) + 1) == raw
        out[lang] = len(packed)
    return out


def test_query_equals_brute_force(spark, corpus, texts):
    """The sample and the dictionaries by hand, every text compressed under each, the smallest named."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    place = F.pmod(F.xxhash64(F.lit(langid.SEED + 1), "text"), F.greatest(F.length("text") - 512, F.lit(0)) + 1).alias("place")
    rows = [r for r in corpus.select("doc_id", "lang", "text", F.xxhash64(F.lit(langid.SEED), "text").alias("h"), place).collect() if fold(r["doc_id"]) != 1 and r["lang"] and r["text"]]
    dictionaries = {}
    for lang in sorted({r["lang"] for r in rows}):
        own = sorted({(r["h"], r["text"][r["place"] : r["place"] + 512]) for r in rows if r["lang"] == lang})
        data = b""
        for _, excerpt in own[:448]:
            if len(data) < 112 * 1024:
                data += (b"\n" if data else b"") + re.sub(r"[\W\d_]+", " ", excerpt.lower()).encode()
        dictionaries[lang] = data[: 112 * 1024]
    model = langid.Model(dictionaries)
    got = {r["doc_id"]: r for r in op7_language(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        sizes = plain_sizes(text, model)
        assert got[i]["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k))
        best = min(sizes.values())
        scale = langid.NARROW_BYTES + langid.NARROW_SHARE * best
        assert abs(got[i]["score"] - 1 / sum(math.exp((best - s) / scale) for s in sizes.values())) < 1e-9


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "ALL_BYTES", 64 * 1024)
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 100)
    # three letters of each language's own, so that 300 languages differ
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.translate(F.conv((F.col("l") * 977 + k * 13).cast("string"), 10, 26), "0123456789", "qrstuvwxyz")))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 300).alias("l")).select("doc_id", F.concat(F.lit("l"), F.col("l").cast("string")).alias("lang"), text.alias("text"))
    model = langid.learn(docs)
    assert len(model.dictionaries) == 300 and sum(map(len, model.dictionaries.values())) <= 300 * langid.EXCERPT_CHARS
    assert langid.classify(docs.where("doc_id = 7").first()["text"], model)[0] == "l7"


def test_odd_rows(spark, odd, none):
    model = langid.learn(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 5, 6)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (7, 8)} <= {"en", "de", "fr"}
    assert langid.predict(none, langid.learn(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}
