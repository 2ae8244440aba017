import random
import re

import numpy as np

from trackloom.llm import licenses
from trackloom.llm.licenses import TEMPLATES, TOKEN


def words(text):
    return [w.lower() for w in TOKEN.findall(text or "")]


def holds(text, template):
    """Whether the words of the template stand in the text in a row."""
    w, t = words(text), words(template)
    return any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1))


def test_whole_templates_equal_brute_force(spark, texts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, name) for d, text in by_id.items() for name, template in TEMPLATES if holds(text, template)}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect() if r["containment"] == 1.0}
    assert got == want and len(want) > 20


def one(spark, text, templates=TEMPLATES):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [(r["license"], text[r["char_start"] : r["char_end"]], r["containment"]) for r in licenses.scan(df, templates).orderBy("char_start").collect()]


def test_spans_edits_and_repeats(spark):
    mit = TEMPLATES[1][1]
    changed = mit.replace("granted", "given", 1)
    filler = "lorem ipsum dolor sit amet " * 40
    ((name, span, held),) = one(spark, filler + changed + " " + filler)
    assert name == "MIT" and 0.8 <= held < 1.0 and span.startswith(("Permission is", "free of"))
    twice = one(spark, f"{filler}Released under the MIT License. {filler}RELEASED*** under&&& the%%% MIT### License.")
    assert [t[0] for t in twice] == ["MIT", "MIT"] and twice[0][1] == "Released under the MIT License"
    assert one(spark, filler + " ".join(mit.split()[:12])) == []


def test_best_of_near_templates(spark):
    assert [t[0] for t in one(spark, "This work is licensed under the GNU General Public License, version 3.")] == ["GPL-3.0"]
    assert [t[0] for t in one(spark, "This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]


FREE = "This program is free software; you can redistribute it and/or modify it under the terms of "
BY = "as published by the Free Software Foundation"


def names(spark, text):
    return [t[0] for t in one(spark, "lorem ipsum dolor sit amet " * 20 + text + " lorem ipsum dolor sit amet" * 20)]


def test_gnu_notices_tell_their_versions(spark):
    gpl, later = "the GNU General Public License ", "of the License, or (at your option) any later version."
    assert names(spark, f"{FREE}{gpl}{BY}; either version 2 {later}") == ["GPL-2.0"]
    assert names(spark, f"{FREE}{gpl}{BY}, either version 3 {later}") == ["GPL-3.0"]
    assert names(spark, f"{FREE}{gpl}version 2 {BY}.") == ["GPL-2.0"]
    assert names(spark, f"{FREE}version 2 of {gpl}{BY}.") == ["GPL-2.0"]
    assert names(spark, f"{FREE}{gpl}{BY}.") == ["GPL"]
    assert names(spark, f"{FREE}the GNU Affero General Public License {BY}, either version 3 {later}") == ["AGPL-3.0"]
    assert names(spark, f"{FREE.replace('program', 'library')}the GNU Lesser General Public License {BY}; either version 2.1 {later}") == ["LGPL-2.1"]


def test_terms_alone_are_found(spark):
    texts = dict(licenses.TEXTS)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "EPL-1.0", "BSD-3-Clause"} <= texts.keys()
    df = spark.createDataFrame([(n, t.replace(" the ", " THE\n * ")) for n, t in texts.items()], "doc_id string, text string")
    assert sorted((r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(df).collect()) == sorted((n, n, 1.0) for n in texts)
    edited = {n: " ".join(w for i, w in enumerate(t.split()) if i % 67 != 40) for n, t in texts.items() if not n.startswith(("BSD", "ISC", "Zlib", "MIT"))}
    df = spark.createDataFrame(list(edited.items()), "doc_id string, text string")
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(df).collect()) == sorted((n, n) for n in edited)
    assert names(spark, texts["BSD-3-Clause"].partition("are met: ")[2]) == ["BSD-3-Clause"]


def test_long_template_across_stretches(spark):
    text = dict(licenses.TEXTS)["GPL-3.0"]
    for before in (licenses.STRETCH - 3000, licenses.STRETCH - 100):
        assert [t[0] for t in one(spark, "alpha " * before + text + " omega" * 9000)] == ["GPL-3.0"]


def test_very_long_text_is_scanned_whole(spark):
    text = "alpha beta gamma delta " * 20_000 + TEMPLATES[5][1] + " omega" * 20_000
    assert [t[0] for t in one(spark, text)] == ["GPL-3.0"]


def test_measured_recall(spark):
    """Edited templates whose shingles are still contained enough, by sets of words: nearly all are found."""
    rng = random.Random(6)
    docs, want = [], {}
    for k in range(1_500):
        name, text = TEMPLATES[k % len(TEMPLATES)]
        own = words(text)
        if len(own) < 12:
            continue
        for _ in range(rng.randint(0, len(own) // 25 + 1)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        kept = shingles(words(text))
        if len(kept & shingles(own)) < 0.8 * len(kept):
            continue
        filler = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(0, 400)))
        docs.append((k, f"{filler} {' '.join(own)} {filler}"))
        want[k] = k % len(TEMPLATES)
    found = {}
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    # another version of a notice may be contained as well or better, so any of the family counts
    right = sum(any(n.split("-")[0] == TEMPLATES[t][0].split("-")[0] for n in found.get(k, ())) for k, t in want.items())
    assert len(want) > 500 and right >= 0.99 * len(want), (right, len(want))


def test_windows_do_not_depend_on_other_texts():
    """A text's stretches are the same alone, among others and after a different text."""
    rng = np.random.default_rng(4)
    index = licenses.Templates(TEMPLATES + list(licenses.TEXTS))
    texts = [np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), part, rng.integers(0, 2**63, n, dtype=np.uint64)])
             for n in (0, 1, 2, 37, 700) for part in (index.sets[3], index.sets[-1], index.sets[-4][::2], index.sets[0][:1])]
    texts.append(np.concatenate([rng.integers(0, 2**63, licenses.STRETCH + 5, dtype=np.uint64), index.sets[-1]]))
    texts.insert(2, texts[0][:0])
    counts = np.array([len(t) for t in texts])
    together = index.retrieve(np.concatenate(texts), 5, counts)
    first, seen = 0, 0
    for t in texts:
        alone = index.retrieve(t, 5, np.array([len(t)]))
        within = {k: {(a - first, b - first) for a, b in v if first <= a < first + len(t)} for k, v in together.items()}
        assert {k: set(v) for k, v in alone.items()} == {k: v for k, v in within.items() if v}
        assert all(0 <= a < b <= len(t) for v in alone.values() for a, b in v)
        first, seen = first + len(t), seen + len(alone)
    assert seen > 10


def test_bands_guarantee_retrieval():
    assert (1 - 1 / 5) ** licenses.BANDS < 1e-4
    assert re.fullmatch(r"[\w.\-']+", "BY-NC")


def test_odd_rows(spark, odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert one(spark, "All rights reserved.", []) == []
    assert [t[0] for t in one(spark, "All rights reserved.")] == ["all-rights-reserved"]
