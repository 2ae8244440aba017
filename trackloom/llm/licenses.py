"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A text and the templates are lower-case words; their shingles are five words (all the words of a
shorter template). Templates of c/2 to c shingles meet windows of 2c shingles at steps of c, so
that every run of c shingles lies within a window. A template within a window has a Jaccard
similarity of 1/4 at least; one of c/2 shingles, 80 % of which are in a window of 2c, has 0.4c/2.1c,
0.19. With BANDS bands of one row each, the chance that no band agrees is under 0.81^BANDS, 4e-5.
The least hashes of the windows of all lengths come from one pass, by halves. A retrieved template
is a match where a window holds CONTAINMENT of its shingles, each compared by a 64-bit hash of its words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from trackloom.llm.common import map_texts
from trackloom.llm.license_texts import TEXTS
from trackloom.llm.shingles import shingle_hashes, word_hashes

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8
#: Shingles dealt with at once, and hashed at once; a stretch is long beside the widest window.
STRETCH = 1 << 17
HASHED = 8192
TOKEN = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of {1}"
_BY = " as published by the Free Software Foundation"


def _gnu(kind: str, of: str, version: str, name: str) -> list[tuple[str, str]]:
    """A GNU license's notices that tell its version, with and without later ones."""
    texts = (
        f"the GNU {kind}{_BY}, either version {version} of the License, or (at your option) any later version.",
        f"the GNU {kind} version {version}{_BY}.",
        f"the GNU {kind}, version {version} only,{_BY}.",
        f"version {version} of the GNU {kind}{_BY}.",
        f"the GNU {kind}{_BY}; version {version} of the License.",
    )
    return [(name, _FREE.format(of, t)) for t in texts]


#: Notices and terms of public licenses. A GNU notice without its version is of the family.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    _gnu("General Public License", "program", "3", "GPL-3.0")[0],
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    *_gnu("General Public License", "program", "3", "GPL-3.0")[1:],
    *_gnu("General Public License", "program", "2", "GPL-2.0"),
    *_gnu("General Public License", "program", "1", "GPL-1.0"),
    *_gnu("Lesser General Public License", "library", "3", "LGPL-3.0"),
    *_gnu("Lesser General Public License", "library", "2.1", "LGPL-2.1"),
    *_gnu("Library General Public License", "library", "2", "LGPL-2.0"),
    *_gnu("Affero General Public License", "program", "3", "AGPL-3.0"),
    ("GPL", _FREE.format("program", "the GNU General Public License" + _BY)),
    ("LGPL", _FREE.format("library", "the GNU Lesser General Public License" + _BY)),
    ("AGPL", _FREE.format("program", "the GNU Affero General Public License" + _BY)),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *TEXTS,
]


def _pairs(counts):
    """Of texts with so many blocks each, in a row: the places of both halves of each block of the next
    length, and the texts' numbers of those. A last block without a second half is paired with itself."""
    import numpy as np

    ends, halves = np.cumsum(counts), (counts + 1) // 2
    within = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
    first = np.repeat(ends - counts, halves) + 2 * within
    return first, np.minimum(first + 1, np.repeat(ends - 1, halves)), halves


class Templates:
    """The index: per shingle length and window class, the templates' least hash in each band."""

    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS):
        import numpy as np

        rng = np.random.default_rng(7)
        self.a = (rng.integers(0, 2**63, bands, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.names, self.sets, self.classes = [], [], {}
        for name, text in templates:
            words = word_hashes(TOKEN.findall(text), fold=True)
            if not len(words):
                continue
            k = min(SHINGLE, len(words))
            shingles = np.unique(shingle_hashes(words, k))
            c = 2
            while c < len(shingles):
                c *= 2
            self.classes.setdefault(k, {}).setdefault(c, []).append(len(self.names))
            self.names.append(name)
            self.sets.append(shingles)
        self.index = {}
        for k, classes in self.classes.items():
            for c, members in classes.items():
                least = np.stack([self.least(self.sets[t]).min(axis=0) for t in members])  # templates x bands
                near = np.zeros(1 << 16, dtype=bool)
                near[(least & np.uint32(0xFFFF)).ravel()] = True
                keys = np.unique(self.keys(np.arange(bands), least))
                self.index[k, c] = least, near, keys

    @staticmethod
    def keys(band, least):
        """Band and least hash as one number."""
        import numpy as np

        return (np.asarray(band, dtype=np.uint64) << np.uint64(32)) | least.astype(np.uint64)

    def least(self, shingles):
        """The hash of each shingle under each band's function."""
        import numpy as np

        return ((shingles[:, None] * self.a + self.b) >> np.uint64(32)).astype(np.uint32)

    def retrieve(self, shingles, k: int, counts) -> dict[int, list[tuple[int, int]]]:
        """Template to the stretches of shingles (from, to) of windows that share a band with it.

        counts: the texts' numbers of shingles. Windows begin at multiples of their step from their text's
        start and end with it, so a text's do not depend on what other texts there are.
        """
        import numpy as np

        found: dict[int, list[tuple[int, int]]] = {}
        widest = max(self.classes[k])
        parts, held = [], 0  # (from, shingles, first and one past the last of the text)
        at = 0
        for n in counts.tolist():
            for a in range(0, n, STRETCH):
                part = min(STRETCH + widest, n - a)  # a window may reach over the end of its stretch
                parts.append((at + a, part, at, at + n))
                held += part
                if held >= STRETCH:
                    self._retrieve(shingles, k, np.array(parts), found)
                    parts, held = [], 0
            at += n
        if parts:
            self._retrieve(shingles, k, np.array(parts), found)
        return found

    def _retrieve(self, shingles, k: int, parts, found) -> None:
        import numpy as np

        classes = self.classes[k]
        counts = parts[:, 1]
        places = np.repeat(parts[:, 0] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        values = shingles[places]
        first, second, counts = _pairs(counts)
        step = HASHED // 2
        least = np.concatenate([np.minimum(self.least(values[first[i : i + step]]), self.least(values[second[i : i + step]])) for i in range(0, len(first), step)])
        c, widest = 2, max(classes)
        while c <= widest:
            if c > 2:
                first, second, counts = _pairs(counts)
                least = np.minimum(least[first], least[second])  # of blocks of c shingles
            if c in classes:
                ends = np.cumsum(counts)
                part_of = np.repeat(np.arange(len(counts)), counts)
                windows = np.minimum(least, least[np.minimum(np.arange(len(least)) + 1, ends[part_of] - 1)])
                wanted, near, keys = self.index[k, c]
                at_window, at_band = np.nonzero(near[windows & np.uint32(0xFFFF)])
                met = np.isin(self.keys(at_band, windows[at_window, at_band]), keys)
                for w, band in zip(at_window[met].tolist(), at_band[met].tolist(), strict=True):
                    start, _, low, high = parts[part_of[w]].tolist()
                    place = start + (w - int(ends[part_of[w]] - counts[part_of[w]])) * c
                    for t in np.flatnonzero(wanted[:, band] == windows[w, band]):
                        found.setdefault(classes[c][t], []).append((max(low, place - c), min(high, place + 3 * c)))
            c *= 2

    def matches(self, shingles, k: int, counts) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, last shingle, containment): least stretches within one text
        that hold enough of the template, left to right and disjoint."""
        import numpy as np

        out = []
        doc_of = np.repeat(np.arange(len(counts)), counts)
        for t, stretches in self.retrieve(shingles, k, counts).items():
            wanted = self.sets[t]
            places = np.unique(np.concatenate([np.arange(a, b) for a, b in sorted(set(stretches))]))
            places = places[np.isin(shingles[places], wanted)]
            out += [(t, *m) for m in _least_stretches(places.tolist(), shingles[places].tolist(), doc_of[places].tolist(), len(wanted))]
        return out


def _least_stretches(places, hashes, docs, size) -> list[tuple[int, int, float]]:
    """Least stretches that hold enough, each drawn out while more of the template comes within a sixth of its size."""
    need = max(1, -(-size * int(CONTAINMENT * 1000) // 1000))
    gap = max(1, size // 6)
    out, lo, hi, held = [], 0, 0, {}
    while hi < len(places):
        p, h, d = places[hi], hashes[hi], docs[hi]
        held[h] = held.get(h, 0) + 1
        while lo < hi and (docs[lo] != d or p - places[lo] > 3 * size or held[hashes[lo]] > 1):
            held[hashes[lo]] -= 1
            if not held[hashes[lo]]:
                del held[hashes[lo]]
            lo += 1
        if len(held) >= need:
            last = at = hi
            while len(held) < size and at + 1 < len(places) and places[at + 1] - places[last] <= gap and docs[at + 1] == d:
                at += 1
                if hashes[at] not in held:
                    held[hashes[at]] = 1
                    last = at
            out.append((places[lo], places[last], len(held) / size))
            hi, lo, held = last, last + 1, {}
        hi += 1
    return out


def _best(found, index: Templates) -> list:
    """Of matches of one document that overlap, the one contained most, then the longest template, then the first."""
    from bisect import bisect_left

    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for m in sorted(found, key=lambda m: (-m[4], -len(index.sets[m[1]]), m[1], m[0], m[2])):
        spans = taken.setdefault(m[0], [])  # disjoint and in order
        i = bisect_left(spans, (m[2], m[3]))
        if (not i or spans[i - 1][1] <= m[2]) and (i == len(spans) or m[3] <= spans[i][0]):
            spans.insert(i, (m[2], m[3]))
            out.append(m)
    return sorted(out)


_built: dict = {}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, template (its place in the list), char_start, char_end
    (code points, end exclusive), containment.

    Null and empty texts, and an empty table, have no matches; repeated rows match one by one; a text
    that holds two templates, or one twice, has two rows; of matches that overlap the best contained stays. Other columns are not read. Whole texts are scanned, in stretches.
    """
    templates = [tuple(t) for t in templates]

    def rate(ids, texts):
        import numpy as np

        key = tuple(templates)
        index = _built.get(key) or _built.setdefault(key, Templates(templates))
        words = [TOKEN.findall(t or "") for t in texts]
        starts = np.cumsum([0, *map(len, words)])
        stream = np.concatenate([word_hashes(w, fold=True) for w in words] or [np.empty(0, dtype=np.uint64)])
        doc_of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        found = []
        for k in index.classes:
            every = shingle_hashes(stream, k)
            at = np.flatnonzero(doc_of[: len(every)] == doc_of[k - 1 :])  # shingles within one text, by their first word
            for t, a, b, held in index.matches(every[at], k, np.bincount(doc_of[at], minlength=len(words))):
                d = int(doc_of[at[a]])
                found.append((d, t, int(at[a] - starts[d]), int(at[b] + k - 1 - starts[d]), held))
        out = [[], [], [], [], [], []]
        spans: dict[int, list] = {}
        for d, t, a, b, held in _best(found, index):
            at = spans.get(d) or spans.setdefault(d, [m.span() for m in TOKEN.finditer(texts[d])])
            for column, value in zip(out, (ids[d], index.names[t], t, at[a][0], at[b][1], held), strict=True):
                column.append(value)
        return out

    return map_texts(docs, rate, "license string, template int, char_start bigint, char_end bigint, containment double", id_col, text_col)
