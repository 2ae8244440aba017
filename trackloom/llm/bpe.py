"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of a text form a linked list of positions. Every adjacent pair that can merge is in the
bucket of its merge's rank; a bitmap of the non-empty buckets, with a summary bitmap above it, gives
the next rank by find-first-set. Entries that an earlier merge has made stale are skipped when met.
A merge costs a constant number of steps whatever the length, so very long pre-tokens are cheap.
Pre-tokens never merge with each other: many of them share one queue, with links cut between them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_texts, remembered

#: Bits of a word of the lower bitmap.
FAN = 256
#: Pre-tokens that share a queue: enough to spread the cost of setting one up, few enough for the CPU's cache.
SHARED = 2_000
#: Bytes from which a queue's lists are arrays: slower, but a fifteenth of the memory.
COMPACT = 1 << 20
#: Bytes of the pre-tokens whose ids a worker remembers, about. Those of more than LONGEST characters
#: are never remembered.
REMEMBERED, LONGEST = 96 << 20, 64
#: Characters of the texts that are split together, and pre-tokens that are dealt with at once.
TOGETHER, PIECES = 500_000, 100_000


class Encoder:
    """Encodes and decodes by the ranks of one vocabulary, given as the bytes of its rank file
    (lines of a base64 token and its rank) and the pattern that splits texts."""

    def __init__(self, rank_file: bytes, pattern: str):
        import numpy as np
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.shift = max(self.tokens).bit_length()
        get = self.ranks.get
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    self.pairs[a << self.shift | b] = rank
        get = self.pairs.get
        self.first = np.array([get(int(a) << self.shift | int(b), -1) for a in self.single for b in self.single])  # of two bytes
        self.most = max(self.tokens)
        self.own = list(range(self.most + 1))  # one object per id, for all who hold it
        self.decimal = list(map(str, self.own))
        self.bytes = list(map(self.tokens.get, self.own))
        self.held = 0
        self.name = f"ids {hashlib.sha256(rank_file + pattern.encode()).hexdigest()}"

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, merging the pair of the lowest rank first and the leftmost of those."""
        import numpy as np

        pairs, shift = self.pairs.get, self.shift
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        length = len(raw)
        listed = (lambda x: array("i", x.astype(np.int32).tobytes())) if length > COMPACT else np.ndarray.tolist
        ends = np.cumsum(sizes)
        inside = np.ones(length, dtype=bool)  # the position has a successor in its piece
        inside[ends[sizes > 0] - 1] = False
        places = np.arange(length, dtype=np.int32)
        after = listed(np.where(inside, places + 1, -1))
        before = listed(np.where(np.concatenate([[False], inside[:-1]]), places - 1, -1)) if length else []
        ids = listed(self.single[raw])
        # the first pairs are of single bytes: their buckets come from one sort
        first = self.first[raw[:-1].astype(np.int32) * 256 + raw[1:]] if length else np.empty(0, dtype=np.int32)
        at = np.flatnonzero(inside[:-1] & (first >= 0))
        at = at[np.argsort(first[at], kind="stable")]
        ranks, starts = np.unique(first[at], return_index=True)
        flat, bounds = listed(at), [*starts.tolist(), len(at)]
        buckets = {r: flat[lo:hi] for r, lo, hi in zip(ranks.tolist(), bounds, bounds[1:])}
        # of each position, the rank of its pair with the next as it is now, or -1: an entry of another rank is stale
        now = np.full(length, -1, dtype=np.int32)
        now[at] = first[at]
        now = listed(now)
        del places, first, at, flat
        words = [0] * (self.most // FAN + 1)
        summary = 0
        for r in buckets:
            words[r // FAN] |= 1 << r % FAN
            summary |= 1 << r // FAN
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            r = w * FAN + (bits & -bits).bit_length() - 1
            words[w] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
            entries = buckets.pop(r)
            if len(entries) > 1:
                entries = sorted(entries)
            for k, p in enumerate(entries):
                if now[p] != r:
                    continue  # stale
                q = after[p]
                ids[p], ids[q] = r, -1
                after[p] = n = after[q]
                now[p] = now[q] = -1
                lower = False
                if n >= 0:
                    before[n] = p
                    if (s := pairs(r << shift | ids[n])) is not None:
                        now[p] = s
                        lower = s < r
                        if s in buckets:
                            buckets[s].append(p)
                        else:
                            buckets[s] = [p]
                            words[s // FAN] |= 1 << s % FAN
                            summary |= 1 << s // FAN
                if (m := before[p]) >= 0:
                    if (s := pairs(ids[m] << shift | r)) is None:
                        now[m] = -1
                    else:
                        now[m] = s
                        lower |= s < r
                        if s in buckets:
                            buckets[s].append(m)
                        else:
                            buckets[s] = [m]
                            words[s // FAN] |= 1 << s % FAN
                            summary |= 1 << s // FAN
                if lower and k + 1 < len(entries):  # a lower rank comes first; the rest waits in its bucket
                    buckets[r] = entries[k + 1 :]
                    words[w] |= 1 << r % FAN
                    summary |= 1 << w
                    break
        left = np.array(ids, dtype=np.int32)
        alive = left >= 0
        stops = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])].tolist()
        flat = list(map(self.own.__getitem__, left[alive].tolist()))
        return [tuple(flat[lo:hi]) for lo, hi in zip(stops, stops[1:])]

    def _learn(self, pieces: set[str]) -> tuple[dict, list[str]]:
        """Ids by pre-token, those of pieces among them, and the pieces to forget once they were used.

        What is remembered is in two halves: when the younger is full it becomes the older, whose
        pre-tokens are forgotten unless they are met again meanwhile.
        """
        memory = remembered(self.name)
        if not memory:
            memory.update(young={}, old={})
            self.held = 0
        if self.held > REMEMBERED // 2:
            memory.update(young={}, old=memory["young"])
            self.held = 0
        young, old = memory["young"], memory["old"]
        new = [w for w in pieces if w not in young]
        young.update((w, old[w]) for w in new if w in old)
        unknown = [w for w in new if w not in old]
        raw = [w.encode() for w in unknown]
        # a piece that is a token as a whole is that token, whatever its merges
        whole = [self.ranks.get(b) for b in raw]
        young.update((w, (r,)) for w, r in zip(unknown, whole, strict=True) if r is not None)
        rest = [(w, b) for w, b, r in zip(unknown, raw, whole, strict=True) if r is None]
        for i in range(0, len(rest), SHARED):
            part = rest[i : i + SHARED]
            young.update(zip((w for w, _ in part), self.merge([b for _, b in part]), strict=True))
        once = [w for w in unknown if len(w) > LONGEST]
        self.held += sum(200 + 2 * len(w) + 8 * len(young[w]) for w in new if len(w) <= LONGEST)
        return young, once

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, list[str], int]]:
        """(text, its pre-tokens, their characters or a few more) in order; those of a long text in parts."""
        for i, text in enumerate(texts):
            if len(text) <= TOGETHER:
                yield i, self.split.findall(text), len(text)
            else:
                found = (m[0] for m in self.split.finditer(text))
                while part := list(islice(found, PIECES)):
                    yield i, part, sum(map(len, part))

    def parts(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(text, ids) in order, a text's ids in one part or more. Parts are made together up to a bound
        of characters, so that memory follows neither the number of texts nor their length, but for a
        single pre-token. Cyclic garbage isn't looked for meanwhile: what is made here has no cycles."""
        held, chars = [], 0
        for i, pieces, n in chain(self._parts(texts), [(-1, [], 0)]):
            held.append((i, pieces))
            chars += n
            if i < 0 or chars > TOGETHER:
                gc.disable()
                try:
                    known, once = self._learn(set(chain.from_iterable(p for _, p in held)))
                    get = known.__getitem__
                    made = [(j, list(chain.from_iterable(map(get, p)))) for j, p in held if j >= 0]
                    for w in once:
                        del known[w]
                finally:
                    gc.enable()
                held, chars = [], 0
                yield from made
                del made

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in self.parts(texts):
            out[i] += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[bytes, str], Encoder] = {}


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One Encoder per worker process and vocabulary."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file, pattern)
    return _encoders[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) per row of docs. Null and empty texts have no ids; repeated rows
    are encoded one by one; other columns are not read; an empty table gives no rows. Texts of any
    length are encoded whole, in parts. The rank file, of a few MB at most, is read on the driver from
    the path given and travels with the task."""
    ranks = _read(vocabulary)

    def rate(ids, texts):
        import numpy as np

        out = [array("i") for _ in texts]
        for i, part in encoder(ranks, pattern).parts([t or "" for t in texts]):
            out[i].extend(part)
        return [ids, [np.frombuffer(x, dtype=np.int32) for x in out]]

    return map_texts(docs, rate, "ids array<int>", id_col, text_col, TOGETHER)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the bytes of its ids; null ids give null."""
    ranks = _read(vocabulary)

    @F.arrow_udf("binary")
    def to_bytes(column: pa.Array) -> pa.Array:
        coder = encoder(ranks, "(?!)")
        return pa.array((coder.decode(x.values.to_pylist()) if x.is_valid else None for x in column), pa.binary())

    return encoded.withColumn("decoded", to_bytes(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    bytes that the ids decode to), in one pass that never sends ids out of the worker. Null and empty
    texts have no ids, and their digests are those of nothing; an empty table gives no rows. Digests
    are fed part by part, so the ids of a long text are never held at once."""
    ranks = _read(vocabulary)

    def rate(ids, texts):
        coder = encoder(ranks, pattern)
        decimal, raw = coder.decimal.__getitem__, coder.bytes.__getitem__
        counts, named, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for i, part in coder.parts([t or "" for t in texts]):
            if part:
                named[i].update(((counts[i] and ",") or "").encode() + ",".join(map(decimal, part)).encode())
                decoded[i].update(b"".join(map(raw, part)))
                counts[i] += len(part)
        return [ids, counts, [h.hexdigest() for h in named], [h.hexdigest() for h in decoded]]

    return map_texts(docs, rate, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col, TOGETHER)
