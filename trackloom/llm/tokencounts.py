"""Token counts of the fields or sections of a document, from one encoding of the whole.

Each document is encoded once. Tokens have spans of characters (from the bytes they cover), sections
have spans of characters, and an interval join of the two sorted lists gives each token to its
sections. A token that crosses a boundary is allocated by an explicit rule:

  start    to the section of its first character
  end      to the section of its last character
  largest  to the section with most of its characters, the earlier of equals
  share    to each section in proportion to its characters

A token that covers part of a character counts as covering it. Characters in no section (a
separator between fields) give their tokens to no section; these are counted as unassigned.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_texts, small_batches

RULES = ("start", "end", "largest", "share")
_encodings: dict = {}


def _encoding(rank_file: bytes, pattern: str):
    """The library's encoding and its tokens' lengths in bytes, by id; one per worker process."""
    import numpy as np
    import tiktoken

    key = (rank_file, pattern)  # its hash is made once for a task's file
    if key not in _encodings:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encodings[key]


def token_spans(text: str, rank_file: bytes, pattern: str):
    """First and one past the last character of each token, as arrays."""
    return _spans(text, *_encoding(rank_file, pattern))


def _spans(text: str, coder, lengths):
    import numpy as np

    sizes = lengths[np.array(coder.encode_ordinary(text), dtype=np.int64)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return char[starts], char[ends - 1] + 1


def allocate(starts, ends, bounds, rule: str):
    """Tokens of each section and tokens that cross its bounds. bounds: ordered, disjoint (from, to)."""
    import numpy as np

    if rule not in RULES:
        raise ValueError(f"rule {rule!r}; known: {', '.join(RULES)}")
    lo, hi = np.array([b[0] for b in bounds], dtype=np.int64), np.array([b[1] for b in bounds], dtype=np.int64)
    first = np.searchsorted(hi, starts, side="right")  # first section that ends after the token's start
    last = np.searchsorted(lo, ends, side="left") - 1  # last section that starts before the token's end
    n = len(bounds)
    crossing = np.zeros(n, dtype=np.int64)
    inside = (first == last) & (starts >= lo[np.minimum(first, n - 1)]) & (ends <= hi[np.minimum(first, n - 1)])
    counts = np.bincount(first[inside], minlength=n).astype(float)
    for i in np.flatnonzero(~inside):
        sections = range(first[i], last[i] + 1)
        parts = [min(ends[i], hi[s]) - max(starts[i], lo[s]) for s in sections]
        parts, sections = [p for p in parts if p > 0], [s for s, p in zip(sections, parts, strict=True) if p > 0]
        for s in sections:
            crossing[s] += 1
        if not sections:
            continue
        if rule == "share":
            for s, p in zip(sections, parts, strict=True):
                counts[s] += p / (ends[i] - starts[i])
        elif rule == "largest":
            counts[sections[parts.index(max(parts))]] += 1
        elif rule == "start" and lo[sections[0]] <= starts[i]:
            counts[sections[0]] += 1
        elif rule == "end" and hi[sections[-1]] >= ends[i]:
            counts[sections[-1]] += 1
    return counts.tolist(), crossing.tolist()


def line_bounds(text: str) -> list[tuple[int, int]]:
    """Lines with the newline that ends them; a text without characters is one empty section."""
    bounds, at = [], 0
    while (i := text.find("\n", at)) >= 0:
        bounds.append((at, i + 1))
        at = i + 1
    if at < len(text) or not bounds:
        bounds.append((at, len(text)))
    return bounds


def joined_fields(docs: DataFrame, fields: list[str], separator: str = "\n\n") -> DataFrame:
    """doc_id, text (the fields joined, null ones empty) and bounds (their character spans, in order).

    Fields of other types count as their text. Repeated rows, rows without an id and those without any field
    stay rows; docs' own columns text and bounds, if any, are not returned."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, bounds = F.lit(0), []
    for v in values:
        end = at + F.length(v)
        bounds.append(F.struct(at.alias("lo"), end.alias("hi")))
        at = end + len(separator)
    return docs.select("doc_id", F.concat_ws(separator, *values).alias("text"), F.array(*bounds).alias("bounds"))


def count_sections(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "start") -> DataFrame:
    """One row per line of each text: doc_id, section (from 0), char_start, char_end, n_tokens,
    n_crossing (tokens that it shares with another section), doc_tokens (of the whole text).

    Null and empty texts have one section of no tokens. Every token goes to a section, as lines cover
    the text: over a document n_tokens sums to doc_tokens. Repeated rows are counted one by one; other
    columns are not read; an empty table gives no rows. A text is encoded and joined whole, whatever
    its length: a worker holds one text's tokens at a time.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def rate(ids, texts):
        out = [[], [], [], [], [], [], []]
        coder, lengths = _encoding(ranks, pattern)
        for i, text in zip(ids, texts, strict=True):
            bounds = line_bounds(text := text or "")
            starts, ends = _spans(text, coder, lengths)
            counts, crossing = allocate(starts, ends, bounds, rule)
            for column, values in zip(out, ([i] * len(bounds), range(len(bounds)), [b[0] for b in bounds], [b[1] for b in bounds], counts, crossing, [len(starts)] * len(bounds)), strict=True):
                column.extend(values)
        return out

    schema = "section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"
    return map_texts(docs, rate, schema)


def count_fields(docs: DataFrame, fields: list[str], vocabulary: str, pattern: str, rule: str = "start", separator: str = "\n\n") -> DataFrame:
    """doc_id, doc_tokens and field_tokens (array<double>, in the order of fields): the fields joined
    by separator are encoded as one text. Tokens of the separator alone go to no field.

    Null fields are empty ones and have no tokens, and rows without an id are counted as others are; repeated
    rows are counted one by one; other columns are not read, whatever their names; an empty table gives
    no rows. A document is encoded whole, whatever its length, and a worker holds one's tokens at a time."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    kind = pa.struct([("doc_tokens", pa.int64()), ("field_tokens", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<doc_tokens:bigint, field_tokens:array<double>>")
    def rate(texts: pa.Array, bounds: pa.Array) -> pa.Array:
        rows = []
        coder, lengths = _encoding(ranks, pattern)
        for text, b in zip(texts, bounds, strict=True):
            starts, ends = _spans(text.as_py(), coder, lengths)
            rows.append({"doc_tokens": len(starts), "field_tokens": allocate(starts, ends, [(x["lo"], x["hi"]) for x in b.as_py()], rule)[0]})
        return pa.array(rows, kind)

    return joined_fields(docs, fields, separator).select("doc_id", rate("text", "bounds").alias("r")).select("doc_id", "r.*")
