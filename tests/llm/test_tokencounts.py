import numpy as np
import public_tokenizers
import pytest

from trackloom.llm import tokencounts as tc
from trackloom.llm.queries import op6_token_counts, token_fields

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()


def plain(starts, ends, bounds, rule):
    counts, crossing = [0.0] * len(bounds), [0] * len(bounds)
    for a, b in zip(starts, ends, strict=True):
        parts = [sum(lo <= c < hi for c in range(a, b)) for lo, hi in bounds]
        met = [s for s, p in enumerate(parts) if p]
        if len(met) > 1 or sum(parts) < b - a:
            for s in met:
                crossing[s] += 1
        if not met:
            continue
        if rule == "share":
            for s in met:
                counts[s] += parts[s] / (b - a)
        elif rule == "largest":
            counts[parts.index(max(parts))] += 1
        else:
            at = a if rule == "start" else b - 1
            for s, (lo, hi) in enumerate(bounds):
                counts[s] += lo <= at < hi
    return counts, crossing


@pytest.mark.parametrize("rule", tc.RULES)
def test_allocation_equals_brute_force(rule):
    rng = np.random.default_rng(2)
    for _ in range(300):
        ends = np.cumsum(rng.integers(1, 6, rng.integers(0, 12)))
        starts = ends - np.diff(ends, prepend=0)
        cuts = np.sort(rng.integers(0, int(ends[-1]) + 1 if len(ends) else 1, 6)).tolist()
        bounds = [(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[3], cuts[4])]
        counts, crossing = tc.allocate(starts, ends, bounds, rule)
        want = plain(starts.tolist(), ends.tolist(), bounds, rule)
        assert counts == pytest.approx(want[0]) and crossing == want[1]


def test_spans_cover_the_text():
    for text in ("plain words here", "café \U0001f600\U0001f601 naïve", "中文字", ""):
        starts, ends = tc.token_spans(text, RAW, public_tokenizers.PATTERN)
        covered = {c for a, b in zip(starts, ends, strict=True) for c in range(a, b)}
        assert covered == set(range(len(text))) and (np.diff(starts) >= 0).all()


def test_sections_add_up(corpus, texts):
    rows = tc.count_sections(corpus, PATH, public_tokenizers.PATTERN).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == texts.keys()
    for i, own in by.items():
        own.sort(key=lambda r: r["section"])
        assert "".join(texts[i][r["char_start"] : r["char_end"]] for r in own) == texts[i]
        assert all(r["char_start"] == 0 or texts[i][r["char_start"] - 1] == "\n" for r in own)
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]


def test_query_equals_brute_force(spark, texts):
    """Tokens of the library laid over the bytes one by one; each goes to the line of its first character."""
    coder = tc._encoding(RAW, public_tokenizers.PATTERN)[0]
    want = set()
    for i, text in texts.items():
        text = text or ""
        char_of_byte = [c for c, ch in enumerate(text) for _ in ch.encode()]
        lines = text.split("\n")
        bounds, at = [], 0
        for k, line in enumerate(lines):
            end = at + len(line) + (k < len(lines) - 1)
            if end > at or not text:
                bounds.append((at, end))
            at = end
        line_of = [k for k, (lo, hi) in enumerate(bounds) for _ in range(lo, hi)]
        ids, byte = coder.encode_ordinary(text), 0
        counts, crossing = [0] * len(bounds), [0] * len(bounds)
        for t in ids:
            n = len(coder.decode_single_token_bytes(t))
            met = {line_of[char_of_byte[b]] for b in range(byte, byte + n)}
            counts[line_of[char_of_byte[byte]]] += 1
            for k in met if len(met) > 1 else ():
                crossing[k] += 1
            byte += n
        want |= {(i, k, lo, hi, float(counts[k]), crossing[k], len(ids)) for k, (lo, hi) in enumerate(bounds)}
    got = op6_token_counts(spark, "/root/testdata/sf0.001").collect()
    names = ("doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens")
    assert {tuple(r[n] for n in names) for r in got} == want and len(got) == len(want)


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title words", None, "Body of the text"), (2, None, None, None)], "doc_id bigint, a string, b string, c string")
    got = {r["doc_id"]: r for r in tc.count_fields(df, ["a", "b", "c"], PATH, public_tokenizers.PATTERN, "share").collect()}
    assert got[1]["field_tokens"][1] == 0 and sum(got[1]["field_tokens"]) <= got[1]["doc_tokens"]
    assert got[2]["field_tokens"] == [0, 0, 0]
    with pytest.raises(ValueError):
        tc.allocate(np.array([0]), np.array([1]), [(0, 1)], "other")


def fields_plain(values, rule, separator="\n\n"):
    """Tokens of the whole and of each field, by the brute-force allocation over the library's tokens."""
    text, bounds, at = separator.join(values), [], 0
    for v in values:
        bounds.append((at, at + len(v)))
        at += len(v) + len(separator)
    starts, ends = tc.token_spans(text, RAW, public_tokenizers.PATTERN)
    return len(starts), plain(starts.tolist(), ends.tolist(), bounds, rule)[0]


@pytest.mark.parametrize("rule", tc.RULES)
def test_fields_equal_brute_force(spark, rule):
    long = "words and more, 😀 caf\u00e9 " * 4000
    data = [(1, "web", "One text.\n\nAnd more"), (None, None, "no id"), (None, "", None), (3, "a", "a"), (3, "a", "a"), (4, "\u4e2d\u6587", "\n\n \n x")]
    df = spark.createDataFrame([(i, s, t, "text", "bounds") for i, s, t in data], "doc_id bigint, source string, body string, text string, bounds string")
    got = [(r["doc_id"], r["doc_tokens"], r["field_tokens"]) for r in tc.count_fields(df, ["source", "body"], PATH, public_tokenizers.PATTERN, rule, " ").collect()]
    assert len(got) == len(data)
    for i, s, t in data:
        n, counts = fields_plain([s or "", t or ""], rule, " ")
        assert any(g[0] == i and g[1] == n and g[2] == pytest.approx(counts) for g in got), (i, s, t)
    big = tc.count_fields(spark.createDataFrame([(9, long, "end")], "doc_id bigint, a string, b string"), ["a", "b"], PATH, public_tokenizers.PATTERN, rule).first()
    whole = tc.token_spans(long + "\n\nend", RAW, public_tokenizers.PATTERN)[0]
    assert big["doc_tokens"] == len(whole) and big["field_tokens"][0] > len(whole) - 6
    assert tc.count_fields(df.limit(0), ["source"], PATH, public_tokenizers.PATTERN, rule).count() == 0


def test_fields_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in token_fields(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len({r["doc_id"] for r in rows})
    for r in rows:
        n, (source, text) = fields_plain([r["source"] or "", r["text"] or ""], "share")
        g = got[r["doc_id"]]
        assert (g["doc_tokens"], g["source_tokens"], g["text_tokens"]) == (n, pytest.approx(source, abs=1e-6), pytest.approx(text, abs=1e-6))


def test_odd_rows(odd, none):
    rows = tc.count_sections(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len({(r["doc_id"], r["section"]) for r in rows}) == len(rows) - 1  # document 3 is there twice
    assert [(r["char_end"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2)] == [(0, 0.0), (0, 0.0)]
    assert tc.count_sections(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_the_rank_file_is_looked_up_once_for_many_texts(monkeypatch):
    made, calls, real = {}, [], tc._encoding
    monkeypatch.setattr(tc, "map_texts", lambda docs, rate, schema: made.update(rate=rate))
    monkeypatch.setattr(tc, "_encoding", lambda *file: calls.append(1) or real(*file))
    tc.count_sections(None, PATH, public_tokenizers.PATTERN)
    out = made["rate"](list(range(40)), ["a line\nand café", None] * 20)
    assert len(calls) == 1 and len(out[0]) == 60
