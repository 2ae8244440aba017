"""Pieces against the library's ids, packings against bounds and brute force."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def file():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows, capacity, end_id):
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        for piece, lo in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[lo : lo + capacity], dtype="<u4")
            out.append((doc_id, piece, lo, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def sound(packed, capacity):
    """Every sequence is filled without gaps, up to its capacity; returns their number."""
    of = defaultdict(list)
    for r in packed:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in of.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(of)


def test_query(spark, texts, library):
    found = queries.queries()["op13_packing"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == expected(library, texts.items(), 4096, 1)
    lengths = [r["length"] for r in rows]
    assert packing.lower_bound(lengths, 4096) <= sound(rows, 4096) <= packing.lower_bound(lengths, 4096) + 1


def test_odd_rows(odd, none, spark, library, file):
    clash = odd.withColumns({"piece": F.lit("mine"), "length": F.lit("mine"), "sequence_id": F.lit("mine"), "offset": F.lit("mine")})
    found = packing.pack(packing.encoded_pieces(clash, file, 1, 1000), 1000).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == expected(library, [(r["doc_id"], r["text"]) for r in odd.collect()], 1000, 1)
    sound(found, 1000)
    empty = packing.pack(packing.encoded_pieces(none, file, 1, 1000), 1000)
    assert empty.collect() == [] and empty.columns[-2:] == ["sequence_id", "offset"]


def test_ids_of_words_apart(file, library):
    coder = packing.WordIds(file)
    chance = random.Random(3)
    alphabet = ["a", "B", "é", "É", "é", "́", "ẞ", "İ", "Σ", "ς", "中", "文", "​", "\xa0", "\x85", "\x1c", "1", "٣", "'s", "'T", "’", ".", ",", "!?", "-", "_", " ", "\n", "\t", "\x0b", "😀", "<|", "endoftext", "|>", "Ǆ", "K", "ﬁ", "H̱"]
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "it's DON'T we'll,", "a<|endoftext|>b", "word, " * 50, "x" * 3000, "Été, été; ÉTÉ!"]
    for text in texts:
        assert np.frombuffer(coder(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded(file, library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    coder = packing.WordIds(file)
    for i in range(60):
        text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + j)} stem{chr(97 + j)}," for j in range(8))
        assert np.frombuffer(coder(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(coder.known) + len(coder.older) <= 80


def test_sequences_hold_the_ids(spark, corpus, file, library):
    some = corpus.limit(40)
    packed = packing.pack(packing.encoded_pieces(some, file, 1, 512, with_ids=True), 512)
    held = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
    assert all(len(ids) <= 512 for ids in held.values())


def best(lengths, capacity):
    """The least number of bins, by trying all."""

    @lru_cache(None)
    def bins(mask):
        if not mask:
            return 0, 0  # bins, and what is in the last one, from a fullest-first search
        found = (99, 99)
        for i in range(len(lengths)):
            if mask >> i & 1:
                n, fill = bins(mask ^ (1 << i))
                found = min(found, (n, fill + lengths[i]) if n and fill + lengths[i] <= capacity else (n + 1, lengths[i]))
        return found

    return bins((1 << len(lengths)) - 1)[0]


def test_small_cases_against_all_packings():
    chance = random.Random(11)
    for case in range(120):
        n = chance.randint(1, 10)
        lengths = [chance.randint(1, 100) if case % 3 else chance.choice((34, 33, 51, 49, 67, 26)) for _ in range(n)]
        bins = packing.evolve(lengths, 100, case, generations=60)
        assert sorted(p for b in bins for p in b) == list(range(n)) and all(sum(lengths[p] for p in b) <= 100 for b in bins)
        least = best(tuple(lengths), 100)
        assert packing.lower_bound(lengths, 100) <= least == len(bins)


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly, which best fit decreasing does not find."""
    chance = random.Random(4)
    lengths = []
    for _ in range(20):
        a = chance.randint(380, 490)
        b = chance.randint(250, 1000 - a - 250)
        lengths += [a, b, 1000 - a - b]
    fit = packing.best_fit(sorted(range(60), key=lambda p: (-lengths[p], p)), lengths, 1000, [])
    assert len(packing.evolve(lengths, 1000, 1, generations=300)) < len(fit)


def test_crossover_and_mutation_keep_all_pieces():
    chance = random.Random(9)
    lengths = [chance.randint(1, 400) for _ in range(80)]
    order = list(range(80))
    one, two = (packing.best_fit(chance.sample(order, 80), lengths, 1000, []) for _ in range(2))
    for child in (packing.crossover(one, two, lengths, 1000, chance), packing.mutated(one, lengths, 1000, chance)):
        assert sorted(p for b in child for p in b) == order and all(sum(lengths[p] for p in b) <= 1000 for b in child)


@pytest.mark.parametrize("kind", ["mixed", "hot", "short", "halves"])
def test_many_shards(spark, kind):
    size = {"mixed": F.rand(3) * 999 + 1, "hot": F.when(F.rand(4) < 0.4, 337).otherwise(F.rand(5) * 600 + 1), "short": F.lit(1), "halves": F.rand(6) * 300 + 501}[kind]
    pieces = spark.range(4000).select("id", size.cast("bigint").alias("length"))
    packed = packing.pack(pieces, 1000, shard_pieces=256).collect()
    assert sorted(r["id"] for r in packed) == list(range(4000))
    lengths = [r["length"] for r in packed]
    assert sound(packed, 1000) <= 1.01 * packing.lower_bound(lengths, 1000) + 1


def test_refuses_lengths_out_of_bounds(spark):
    for length in (0, 11, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, length)], "id int, length bigint"), 10)


def test_reruns_agree(spark):
    pieces = spark.range(600).select("id", (F.pmod(F.xxhash64("id"), F.lit(500)) + 250).alias("length")).coalesce(2)
    one, two = (sorted(map(tuple, packing.pack(pieces, 1000, shard_pieces=100).collect())) for _ in range(2))
    assert one == two


def test_new_words_of_many_texts_are_encoded_together(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        coder = packing.WordIds(f.read())
    assert "_encode_plain" not in vars(coder)  # the lean way agrees with the whole tokenizer
    odd = ["It's THE end.", "café CAFÉ", "naïve Straße ΣΑΣ", "a1b2 x.y z!!", "", "it'll don't", "ﬁne ǅ ªb", "zzzzqqqq " * 3, "a<|endoftext|>b end.", "end. end . .", "straße ŉ ñandú, łódź. żółć\u0301 ǆ"]
    texts = odd + [f"word{'abcdefghij'[i % 10] * (i // 10 + 1)} and {chr(97 + i % 26)}thing{chr(97 + i // 26)}." for i in range(200)]
    calls, real = [], coder._encode
    monkeypatch.setattr(coder, "_encode", lambda some, *tokenizer: calls.append(1) or real(some, *tokenizer))
    found = coder.many(texts)
    assert len(calls) < 10
    want = [e.ids for e in coder.coder.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(raw, dtype="<u4").tolist() for raw in found] == want and coder.many(texts) == found
