"""Packing of documents into sequences of a fixed number of tokens by a grouping genetic algorithm.

A document is its token ids and an end id. Longer ones than a sequence are cut; the pieces are packed
whole. Pieces are dealt in turn, by length within a partition, into shards of bounded size. Each shard is evolved on
several islands, which are tasks of their own: a population of packings, whose crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold what came twice, and
best-fits the displaced pieces, largest first. Between epochs an island's elite migrates to the next
island of its shard. A shard that reaches a lower bound of its number of bins is done. Then the loosest
bins of all shards are dissolved and their pieces are packed in fewer shards, round by round, until one
shard holds them: what a shard wastes is filled by others' pieces.

No task holds more than a shard, whatever the number of documents, and what is random is seeded by
shard and island, so that a lost task gives the same packing again.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, remembered, small_batches

#: Expected pieces of a shard, unless they are so short that they fill fewer than SHARD_BINS sequences.
SHARD_PIECES, SHARD_BINS = 8192, 64
#: Islands of a shard, and epochs between which elites migrate.
ISLANDS, EPOCHS = 2, 2
#: Packings of an island, and generations of an epoch.
POPULATION, GENERATIONS = 6, 12
#: At most this part of a shard's bins is dissolved for the next round, those with over LOOSE of a sequence free.
DISSOLVED, LOOSE = 0.125, 0.01
#: Words whose ids a worker remembers, at most; then it forgets half of them. Words of the texts that are dealt with at once.
REMEMBERED, TOGETHER = 600_000, 100_000

_MARK = re.compile("[\u0300-\u036f]")
_PUNCTUATION = b".,;:!?"


def _plain(word: bytes) -> bool:
    """Of lower-case Latin letters, without marks of their own: composition and lower case leave them as they are."""
    if word.isascii():
        return word.isalpha() and word.islower()
    letters = word.decode()
    return letters.isalpha() and max(letters) < "\u0250" and letters == letters.lower()


#: The characters that stand for bytes in the vocabulary of a byte-level tokenizer; a space stays one.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)} | {32: " "}


class WordIds:
    """Ids of texts by a tokenizers file of words with word ends, as bytes of little-endian 32-bit numbers.

    The tokenizer drops white space and merges within words only, so that words between ASCII white
    space are encoded apart and remembered. A text that holds an added token is encoded whole.
    """

    def __init__(self, file: bytes):
        import numpy as np
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(file.decode())
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        # lower-case Latin letters stay as they are, so that their words need no expressions, if the file is as others are
        lean = json.loads(file) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        letters = [t for t in (t.removesuffix("</w>") for t in sorted(vocabulary)) if t.isascii() and _plain(t.encode())]
        letters += [c for c in map(chr, range(128, 0x250)) if _plain(c.encode())] * (1 + len(letters) // 2000)
        if not self._agree(letters[:: 1 + len(letters) // 2000]):
            self._encode_plain = lambda words: self._encode([words.decode()])[0]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _agree(self, words: list[str]) -> bool:
        """The lean tokenizer gives words, and what two and two of them make, the ids that the whole one gives."""
        text = [" ".join(words), " ".join(a + b for a, b in zip(words, words[::-1]))]
        return self._encode(text) == [self._encode_plain(t.encode()) for t in text]

    def _encode_plain(self, words: bytes) -> bytes:
        return self._encode([words.decode("ascii") if words.isascii() else words.decode("latin-1").translate(_BYTES)], self.lean)[0]

    def _encode(self, texts: list[str], coder=None) -> list[bytes]:
        import numpy as np

        if not texts:
            return []
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in (coder or self.coder).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Words of letters are one pre-token each, which one word end closes, so that
        many are encoded as one text; punctuation after such a word is a pre-token of its own."""
        import numpy as np

        new: dict[bytes, bytes] = {}
        stems, lower, plain, other = {}, {}, {}, []
        older, known = self.older.get, self.known.get
        for w in words:
            if (ids := older(w)) is not None:
                new[w] = ids
                continue
            if _plain(w):
                lower[w] = None
                continue
            stem = w.rstrip(_PUNCTUATION)
            if not (is_plain := _plain(stem)):
                letters = stem.decode()
                # as letters that stay letters: composition and lower case can set marks free
                if not (letters if letters.isascii() else unicodedata.normalize("NFC", letters).lower()).isalpha():
                    other.append(w)
                    continue
            if stem != w:
                stems[w] = stem
                if (ids := known(stem) or older(stem)) is not None:
                    new[stem] = ids
                    continue
            if is_plain:
                lower[stem] = None
            else:
                plain[stem] = None
        for words in (list(lower), list(plain)):
            for lo in range(0, len(words), 256):
                some = words[lo : lo + 256]
                raw = self._encode_plain(b" ".join(some)) if some[0] in lower else self._encode([b" ".join(some).decode()])[0]
                stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
                if len(stops) == len(some):
                    new.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops))))
                else:  # what is a letter here is none to the tokenizer
                    other += some
        for tail in {w[len(stem) :] for w, stem in stems.items()}.difference(new):
            if (ids := known(tail) or older(tail)) is not None:
                new[tail] = ids
            else:
                other.append(tail)
        new.update(zip(other, self._encode([w.decode() for w in other]), strict=True))
        for w, stem in stems.items():
            new[w] = new[stem] + new[w[len(stem) :]]
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        self.known.update(new)
        return new

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def _words(self, text: str) -> list[bytes]:
        # the tokenizer composes marks before it lowers case; without marks after ASCII letters the order is all one
        raw = text.encode()
        return (raw if _MARK.search(text) else raw.lower()).split()

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new words of up to TOGETHER words are encoded together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[i].append(self._encode([text])[0])
                continue
            words = self._words(text)
            for lo in range(0, len(words), TOGETHER):
                part = words[lo : lo + TOGETHER] if len(words) > TOGETHER else words
                held.append((i, part))
                if (n := n + len(part)) >= TOGETHER:
                    self._join(held, out)
                    held, n = [], 0
        self._join(held, out)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _join(self, held: list[tuple[int, list[bytes]]], out: list[list[bytes]]) -> None:
        get = self.known.get
        found = [list(map(get, words)) for _, words in held]
        unknown = dict.fromkeys(w for (_, words), some in zip(held, found) if None in some for w, ids in zip(words, some) if ids is None)
        new = self._learn(list(unknown)) if unknown else {}
        for (i, words), some in zip(held, found):
            out[i].append(b"".join([new[w] if ids is None else ids for w, ids in zip(words, some)] if None in some else some))


def encoded_pieces(docs: DataFrame, tokenizer: bytes, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32(, ids) of every document, encoded and cut to pieces.

    tokenizer: the file of a tokenizer of words with word ends. A document ends with end_id; null and
    empty texts are that id alone. Pieces hold capacity tokens, the last of a document the rest. ids:
    little-endian 32-bit numbers. Repeated rows and null ids have pieces of their own; other columns
    are not read. An empty table gives no pieces.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    mark = end_id.to_bytes(4, "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coders = remembered("packing")
        coder = coders.setdefault(zlib.crc32(tokenizer), None) or WordIds(tokenizer)
        coders[zlib.crc32(tokenizer)] = coder
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [], [], [])
            for i, raw in enumerate(coder.many([text or "" for text in batch.column(1).to_pylist()])):
                raw += mark
                for piece, lo in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[lo : lo + 4 * capacity]
                    for column, value in zip(rows, (i, piece, lo // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        column.append(value)
            columns = [ids.take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids binary" if with_ids else ""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def lower_bound(lengths, capacity: int) -> int:
    """Bins that any packing needs: by the sum, by the pieces that can't share a bin with one another, and
    by how many pieces over a k-th of a bin fit into one (the dual feasible functions of Fekete and Schepers)."""
    import numpy as np

    size = np.sort(np.asarray(lengths, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(size)])
    best = -(-int(total[-1]) // capacity)
    half = np.searchsorted(size, capacity // 2, side="right")  # from here on, one a bin
    for least in np.unique(size[:half]):
        alone = np.searchsorted(size, capacity - least, side="right")  # from here on, with none of at least `least`
        small = np.searchsorted(size, least)
        free = (alone - half) * capacity - (total[alone] - total[half]) if alone > half else 0
        best = max(best, len(size) - half + max(0, -(-int(total[half] - total[small] - free) // capacity)))
    for k in range(1, 10):
        weight = np.where((k + 1) * size % capacity, (k + 1) * size // capacity * capacity, k * size)
        best = max(best, -(-int(weight.sum()) // (k * capacity)))
    return int(max(best, len(size) - int(half)))


def best_fit(order, lengths, capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Bins with the pieces of order put, one after the other, where least room is left; new bins where none has room."""
    room = []
    for i, members in enumerate(bins):
        free = capacity - sum(map(lengths.__getitem__, members))
        if free > 0:
            room.append((free, i))
    room.sort()
    for p in order:
        size = lengths[p]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, i = room.pop(at)
            bins[i].append(p)
        else:
            free, i = capacity, len(bins)
            bins.append([p])
        if free > size:
            insort(room, (free - size, i))
    return bins


def rating(bins, lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then unequal ones: their room is in one place."""
    return len(bins), -sum((sum(map(lengths.__getitem__, b)) / capacity) ** 2 for b in bins)


def crossover(one, two, lengths, capacity: int, chance: random.Random) -> list[list[int]]:
    """The first packing with well-filled bins of the second in it."""
    fullest = sorted(two, key=lambda b: -sum(map(lengths.__getitem__, b)))[: max(1, len(two) // 2)]
    injected = chance.sample(fullest, chance.randint(1, len(fullest)))
    twice = {p for b in injected for p in b}
    kept = [list(b) for b in one if twice.isdisjoint(b)]
    stay = {p for b in kept for p in b} | twice
    displaced = sorted((p for b in one for p in b if p not in stay), key=lambda p: (-lengths[p], p))
    return best_fit(displaced, lengths, capacity, kept + [list(b) for b in injected])


def mutated(bins, lengths, capacity: int, chance: random.Random) -> list[list[int]]:
    """The packing with its loosest bins and some others dissolved and best-fitted in another order."""
    order = sorted(range(len(bins)), key=lambda i: sum(map(lengths.__getitem__, bins[i])))
    n = max(1, len(bins) // 16)
    gone = {*order[:n], *chance.sample(range(len(bins)), min(n, len(bins)))}
    loose = [p for i in gone for p in bins[i]]
    weight = {p: lengths[p] * chance.uniform(0.7, 1.3) for p in sorted(loose)}
    loose.sort(key=lambda p: (-weight[p], p))
    return best_fit(loose, lengths, capacity, [list(b) for i, b in enumerate(bins) if i not in gone])


def evolve(lengths, capacity: int, seed: int, starts=(), population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing (lists of positions) of an epoch on one island, from starts and packings of its own."""
    chance = random.Random(seed)
    least = lower_bound(lengths, capacity)
    largest = sorted(range(len(lengths)), key=lambda p: (-lengths[p], p))
    herd = [*map(list, starts)] or [best_fit(largest, lengths, capacity, [])]
    rated = sorted(((rating(b, lengths, capacity), b) for b in herd), key=lambda x: x[0])
    if rated[0][0][0] <= least:
        return rated[0][1]
    while len(rated) < population:
        weight = [lengths[p] * chance.uniform(0.8, 1.25) for p in range(len(lengths))]
        bins = best_fit(sorted(largest, key=lambda p: -weight[p]), lengths, capacity, [])
        rated.append((rating(bins, lengths, capacity), bins))
    for _ in range(generations):
        rated.sort(key=lambda x: x[0])
        if rated[0][0][0] <= least:
            break
        for place in (-1, -2):  # the worst make room
            one, two = (min(chance.sample(rated, 2), key=lambda x: x[0])[1] for _ in range(2))
            child = mutated(crossover(one, two, lengths, capacity, chance), lengths, capacity, chance)
            rated[place] = rating(child, lengths, capacity), child
    return min(rated, key=lambda x: x[0])[1]


def _numbers(bins, n: int) -> list[int]:
    out = [0] * n
    for i, members in enumerate(bins):
        for p in members:
            out[p] = i
    return out


def _bins(numbers) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for p, i in enumerate(numbers):
        out[i].append(p)
    return [b for b in out if b]


_STATE = "shard bigint, island int, keys array<bigint>, lengths array<bigint>, bins array<int>, n_bins int, rate double, done boolean"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Each row's island evolved for an epoch from bins and elite, where they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_STATE))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                starts = [_bins(b) for b in (row["bins"], row["elite"]) if b]
                bins = evolve(lengths, capacity, hash((row["shard"], row["island"], epoch)), starts)
                n, rate = rating(bins, lengths, capacity)
                row |= {"bins": _numbers(bins, len(lengths)), "n_bins": n, "rate": rate, "done": n <= lower_bound(lengths, capacity)}
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in arrow.names}], schema=arrow)

    return state.select("shard", "island", "keys", "lengths", "bins", "elite").mapInArrow(run, _STATE)


def _packed_shards(shards: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """shard, keys, lengths, bins: the best packing that the islands of each shard found."""
    none = F.lit(None).cast("array<int>")
    first = cut(_epoch(shards.withColumns({"island": F.lit(0), "bins": none, "elite": none}), capacity, 0))
    solved, best = first.where("done"), first.where("not done")
    if best.isEmpty():
        return solved
    # what best fit alone does not solve goes to islands
    state = best.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", none)
    for epoch in range(1, epochs + 1):
        # a row an island, dealt one by one, as a row is seconds of work
        after = cut(_epoch(state.repartition(F.col("shard"), F.col("island")), capacity, epoch))
        elite = after.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("elite"))
        state = after.join(elite.hint("merge"), ["shard", "island"])
    least = F.min_by(F.struct("keys", "lengths", "bins"), F.struct("n_bins", "rate", "island")).alias("b")
    won = after.groupBy("shard").agg(least).select("shard", "b.*")
    return solved.select("shard", "keys", "lengths", "bins").unionByName(won)


def _placed(shards: DataFrame, most_dissolved: float, loose: float, capacity: int) -> DataFrame:
    """key, length, bin, offset, loose of each piece of packed shards."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = row["lengths"], _bins(row["bins"])
                free = [capacity - sum(lengths[p] for p in b) for b in bins]
                order = sorted(range(len(bins)), key=lambda i: (-free[i], i))[: max(1, int(len(bins) * most_dissolved))]
                gone = {i for n, i in enumerate(order) if free[i] > (0 if n == 0 else loose * capacity)} if most_dissolved else set()
                out = []
                for i, members in enumerate(bins):
                    at = 0
                    for p in members:
                        out.append((row["shard"], row["keys"][p], lengths[p], i, at, i in gone))
                        at += lengths[p]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                names = ["shard", "key", "length", "bin", "offset", "loose"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "shard bigint, key bigint, length bigint, bin bigint, offset bigint, loose boolean"
    return shards.select("shard", "keys", "lengths", "bins").mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (with length, from 1 to capacity) with sequence_id and offset, where each begins in its sequence.

    Columns of these names in pieces are replaced. Rows that are equal are packed each on its own; a
    sequence has no gaps before its pieces, and room after them only. An empty table gives no rows. A
    length that is null or out of bounds is an error.
    """
    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # numbered before they are written, read after: a row keeps its number
    rows = cut(pieces.select(F.struct(*rest).alias("row"), F.col("length").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("key")))
    n, tokens, bad = rows.agg(F.count(F.lit(1)), F.sum("length"), F.count_if(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))).first()
    if bad:
        raise ValueError(f"{bad} pieces are not of 1 to {capacity} tokens")
    pool, final, turn = rows.select("key", "length"), None, 0
    while n:
        # both bounds: no shard of very many pieces but where they are so short that few bins hold them
        number = max(1, min(-(-n // shard_pieces), -(-tokens // (SHARD_BINS * capacity))))
        # each partition deals its pieces by length in turn, so that shards are alike in their lengths
        place = F.monotonically_increasing_id()
        ordered = pool.sortWithinPartitions("length", "key").select("key", "length", place.alias("place"))
        at = F.col("place").bitwiseAND((1 << 33) - 1) + F.pmod(F.xxhash64(F.shiftright("place", 33), F.lit(turn)), F.lit(number))
        shard = F.pmod(at, F.lit(number)).cast("bigint")
        dealt = ordered.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("p"))
        shards = dealt.select("shard", F.col("p.key").alias("keys"), F.col("p.length").alias("lengths"))
        placed = cut(_placed(_packed_shards(shards, capacity, islands, epochs), DISSOLVED if number > 1 else 0, LOOSE, capacity))
        stay = placed.where("not loose")
        # 8 bits for the round, 38 for the shard, 18 for the bin: a shard has fewer bins than pieces
        name = F.lit(turn).cast("bigint") * (1 << 55) + F.col("shard") * (1 << 18) + F.col("bin")
        stay = stay.select("key", name.alias("sequence_id"), "offset")
        final = stay if final is None else final.unionByName(stay)
        pool, turn = placed.where("loose").select("key", "length"), turn + 1
        n, tokens = pool.agg(F.count(F.lit(1)), F.sum("length")).first()
    if final is None:
        return rows.select("row.*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rows.select("row", "key").join(final, "key").select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array<bigint>) of packed pieces that have ids: each sequence, its pieces in their places."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            whole = [b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"])) for parts in batch.column(1).to_pylist()]
            ids = [np.frombuffer(w, dtype="<u4").astype("int64") for w in whole]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "ids"])

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))  # at most a sequence's tokens
    return grouped.mapInArrow(run, "sequence_id bigint, ids array<bigint>")
