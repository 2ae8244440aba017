"""Language identification by compression.

Per language, a bounded sample of labelled texts makes a raw-content dictionary for zstandard. A
text has the language whose dictionary compresses it smallest; case and all but letters are left
out of both, so that capitals, symbols and numbers don't hide the words. Where the runner-up is close the
prediction is marked as rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import cut, map_texts

#: Bounds of the sample: characters of an excerpt, bytes of a dictionary, and bytes of all dictionaries
#: together, which many languages share evenly.
EXCERPT_CHARS = 512
DICTIONARY_BYTES = 112 * 1024
ALL_BYTES = 32 * 1024 * 1024
#: Languages up to which their counts are broadcast (under 100 bytes each).
BROADCAST_LANGUAGES = 100_000
LEVEL = 9
#: A margin under this many bytes and this share of the smallest size is narrow.
NARROW_BYTES, NARROW_SHARE = 4, 0.01
SEED = 11
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language."""

    dictionaries: dict[str, bytes]


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", excerpts: int | None = None) -> Model:
    """A model from labelled rows; null languages and texts are passed over.

    A dictionary is filled with the letters of excerpts, taken by hash, up to DICTIONARY_BYTES, or to
    its share of ALL_BYTES where languages are many; excerpts bounds their number instead. One pass
    counts the rows of each language; a second takes the rows whose hash is under a threshold that
    the count sets, about twice as many as needed, and of each only an excerpt at a hashed place. Only
    these reach the driver. Any number of languages is learnt; a text is compressed once for each.
    Rows repeated in language and text count once; ties go by hash, then by excerpt.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n_langs = counts.count()
    if not n_langs:
        return Model({})
    room = min(DICTIONARY_BYTES, max(EXCERPT_CHARS, ALL_BYTES // n_langs))
    # letters may be fewer than an excerpt's characters, as marks and numbers are left out
    wanted = excerpts or 2 * -(-room // EXCERPT_CHARS)
    spare = F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(F.lit(SEED + 1), "text"), spare) + 1
    cuts = rows.select("lang", F.xxhash64(F.lit(SEED), "text").alias("h"), F.substring(F.col("text"), place.cast("int"), F.lit(EXCERPT_CHARS)).alias("excerpt"))
    reach = counts.select("lang", F.least(F.lit(2.0**62), F.lit(2.0**62) * (2 * wanted + 20) / F.col("n")).cast("bigint").alias("reach"))
    near = cuts.join(F.broadcast(reach) if n_langs <= BROADCAST_LANGUAGES else reach.hint("merge"), "lang")
    own = W.partitionBy("lang").orderBy("h", "excerpt")
    taken = (
        near.where(F.col("h").bitwiseAND(F.lit(2**62 - 1)) <= F.col("reach"))
        .select("lang", "h", "excerpt")
        .distinct()
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= wanted)
        .orderBy("lang", "rank")
        .collect()
    )
    found: dict[str, bytes] = {}
    for r in taken:
        held = found.get(r["lang"], b"")
        if len(held) < room:
            found[r["lang"]] = (held + b"\n" if held else b"") + letters(r["excerpt"]).encode()
    return Model({lang: data[:room] for lang, data in found.items()})


def letters(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower())


_compressors: dict[int, list] = {}


def _ready(model: Model) -> list:
    import zstandard

    key = hash(tuple(model.dictionaries.items()))
    if key not in _compressors:
        _compressors.clear()
        made = []
        for lang, data in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _compressors[key] = made
    return _compressors[key]


def sizes(text: str, model: Model) -> list[tuple[int, str]]:
    raw = letters(text).encode()
    return sorted((len(c.compress(raw)), lang) for lang, c in _ready(model))


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, rejected). Equal sizes go to the language first in order."""
    import math

    if not text or not model.dictionaries or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    ranked = sizes(text, model)
    best = ranked[0][0]
    scale = NARROW_BYTES + NARROW_SHARE * best
    score = 1.0 / sum(math.exp((best - s) / scale) for s, _ in ranked)
    margin = ranked[1][0] - best if len(ranked) > 1 else math.inf
    return ranked[0][1], score, margin < max(NARROW_BYTES, NARROW_SHARE * best)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1) and rejected (margin narrow).

    A null text, a text without a letter and a model without languages give und, 0 and rejected.
    Repeated rows are classified one by one; other columns are not read. Texts are compressed whole.
    """

    def rate(ids, texts):
        found = [classify(t, model) for t in texts]
        return [ids, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    return map_texts(docs, rate, "lang_pred string, score double, rejected boolean", id_col, text_col)
