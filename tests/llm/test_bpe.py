import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
OURS = bpe.encoder(RAW, public_tokenizers.PATTERN)
RANKS = {base64.b64decode(t): int(r) for t, r in map(bytes.split, RAW.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r'theé\u0085 "))))
def test_equals_the_library(text):
    assert OURS.encode([text]) == [THEIRS.encode_ordinary(text)]
    assert OURS.decode(OURS.encode([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_001, "ab" * 20_000, "中文" * 9_000, "the" * 10_000, "", " ", "\n\n\n x"])
def test_long_pre_tokens(text):
    assert OURS.encode([text]) == [THEIRS.encode_ordinary(text)]


def test_ranks_that_are_not_monotone():
    """A merge whose pair becomes possible late but ranks early comes before the rest of its bucket."""
    singles = b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b + 10) for b in range(256))
    merges = [b"abcd", b"ab", b"cd", b"bc"]  # abcd ranks before its parts
    ranks = singles + b"\n" + b"\n".join(base64.b64encode(m) + b" %d" % (i if i == 0 else 300 + i) for i, m in enumerate(merges))
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("abcdabcdab", "xabcdabcdcdab", "abab" * 7 + "cd", "abcabcdbcd"):
        assert own.encode([text]) == [lib.encode_ordinary(text)], text


def test_a_merge_looks_up_its_two_new_pairs_alone():
    """Whether an entry is stale is known from its place; it was a third look-up for each entry."""
    looked = []

    class Counted(dict):
        def get(self, key):
            looked.append(key)
            return dict.get(self, key)

    own = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    own.pairs = Counted(own.pairs)
    words = [b" internationalisation", b"qwrtzpsdf", b" Donaudampfschiff", "naïveté".encode()] * 3
    merged = own.merge(words)
    assert merged == [tuple(THEIRS.encode_ordinary(w.decode())) for w in words]
    assert 0 < len(looked) <= 2 * (sum(map(len, words)) - sum(map(len, merged)))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    monkeypatch.setattr(bpe, "SHARED", 2)
    own = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    for text in ("lorem ipsum dolor sit amet", "consectetur adipiscing elit sed do", "lorem ipsum"):
        assert own.encode([text]) == [THEIRS.encode_ordinary(text)]


def test_frames(corpus, texts):
    got = {r["doc_id"]: r for r in bpe.round_trip(corpus, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in texts.items():
        ids = THEIRS.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decode_and_odd_rows(odd, none):
    coded = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in coded) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
