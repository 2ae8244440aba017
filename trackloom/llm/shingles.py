"""Hashes of words and of runs of words, as arrays."""

from __future__ import annotations

import re

from trackloom.llm.common import remembered

#: Words between ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Words whose hashes a worker remembers, at most; then it forgets all.
REMEMBERED = 200_000


def word_hashes(words: list[str], fold: bool = False):
    """64-bit hashes of words, of their lower case if fold; a worker remembers a bounded number."""
    import numpy as np
    import xxhash

    seen = remembered("folded words" if fold else "words")
    if len(seen) > REMEMBERED:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w.lower() if fold else w)
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words, k: int):
    """The hash of each run of k words; with fewer words, of none."""
    import numpy as np

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return h


def shingle_set(words: list[str], k: int):
    """Distinct hashes of the runs of k words, or of all the words where they are fewer."""
    import numpy as np

    return np.unique(shingle_hashes(word_hashes(words), min(k, len(words)))) if words else np.empty(0, dtype=np.uint64)
