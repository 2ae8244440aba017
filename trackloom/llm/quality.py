"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned. Boosting visits the features in turn, and each time fits a tree of
at most three leaves over the bins to the gradient; a feature's trees add up to one lookup table. The pairs
of features that still explain most of the residual then get tables over two coarser binnings in the
same way. A score is the sum of one table entry per feature and per pair, by vectorised lookups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_texts

#: The bound of the sample of labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 300, 60, 0.1
LEAST_LEAF = 20
SEED = 5

MARKS = "#*$%&|<>!?.,;:\"'()[]{}=/\\@_-+~^`"
FEATURES = [
    "log_words", "mean_word", "upper", "digits", "other", "marks", "stops", "commas", "exclaims", "pipes", "symbols",
    "distinct", "log_lines", "words_per_line", "repeated_lines", "most_frequent", "longest_word", "capitalised",
]


def _classes():
    import numpy as np

    table = np.full(0x3000, 4, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else 4
    for i, ch in enumerate(MARKS):
        table[ord(ch)] = 5 + i
    return table


_table: list = []


def features(text: str):
    """FEATURES of a whole text, finite for any text."""
    from collections import Counter
    from math import log1p

    import numpy as np

    if not _table:
        _table.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen = np.bincount(_table[0][np.minimum(codes, 0x2FFF)], minlength=5 + len(MARKS))
    words = text.split()
    n, chars = len(words), max(1, len(text) - int(seen[3]))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    of = lambda marks: sum(int(seen[5 + MARKS.index(m)]) for m in marks)
    w, m = max(1, n), max(1, len(lines))
    return [
        log1p(n), chars / w if n else 0.0, seen[1] / chars, seen[2] / chars, seen[4] / chars, int(seen[5:].sum()) / w, of(".") / w, of(",") / w,
        of("!") / w, of("|") / w, of("#*$%&<>") / w, len(count) / w, log1p(len(lines)), n / m, (len(lines) - len(set(lines))) / m,
        max(count.values(), default=0) / w, log1p(max(map(len, count), default=0)), sum(map(str.istitle, words)) / w,
    ]


@dataclass
class Additive:
    """Intercept, bin edges and tables per feature, and (i, j, table) per pair over pair_edges."""

    intercept: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def score(self, x):
        import numpy as np

        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(values, bins: int):
    import numpy as np

    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g, h, n, lo: int, hi: int):
    """Gain and place of the best cut of bins lo..hi-1, or None."""
    import numpy as np

    if hi - lo < 2:
        return None
    cg, ch, cn = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
    left = (cg[:-1] ** 2) / (ch[:-1] + 1)
    right = ((cg[-1] - cg[:-1]) ** 2) / (ch[-1] - ch[:-1] + 1)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
    gain[(cn[:-1] < LEAST_LEAF) | (cn[-1] - cn[:-1] < LEAST_LEAF)] = -1
    k = int(np.argmax(gain))
    return (float(gain[k]), lo + k + 1) if gain[k] > 0 else None


def _tree(g, h, n):
    """Steps of a tree of at most three leaves over ordered bins."""
    import numpy as np

    ranges = [(0, len(g))]
    for _ in range(2):
        cuts = [(c, r) for r in ranges if (c := _best_cut(g, h, n, *r))]
        if not cuts:
            break
        (_, at), (lo, hi) = max(cuts)
        ranges.remove((lo, hi))
        ranges += [(lo, at), (at, hi)]
    step = np.zeros(len(g))
    for lo, hi in ranges:
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return step


def fit(x, y) -> Additive:
    """An Additive from an array of features and labels 0 and 1; with one class only its intercept."""
    import numpy as np

    y = np.asarray(y, dtype=float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    total = np.full(len(y), model.intercept)
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(at, model.tables, strict=True)]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table, n in zip(at, model.tables, sizes, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), n)
            table += step
            total += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]
    g, h = slopes()
    gains = []
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            cell = coarse[i] * wide[j] + coarse[j]
            gg, hh = np.bincount(cell, g, wide[i] * wide[j]), np.bincount(cell, h, wide[i] * wide[j])
            gains.append((float((gg**2 / (hh + 1)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, key=lambda z: (-z[0], z[1:]))[:PAIRS]]
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            cell = coarse[i] * wide[j] + coarse[j]
            gg, hh, nn = (np.bincount(cell, v, wide[i] * wide[j]).reshape(wide[i], wide[j]) for v in (g, h, np.ones(len(y))))
            step = np.zeros_like(table)
            # a cut of one feature, then a tree over the other on each side
            if cut := _best_cut(gg.sum(1), hh.sum(1), nn.sum(1), 0, wide[i]):
                for rows in (slice(0, cut[1]), slice(cut[1], wide[i])):
                    step[rows] = _tree(gg[rows].sum(0), hh[rows].sum(0), nn[rows].sum(0))
            table += RATE * step
            total += RATE * step[coarse[i], coarse[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Additive:
    """A model of label_col from at most sample_rows labelled documents, chosen by hash.

    Labels that are null, or whose document is missing, are passed over. A document with several
    labels has the least of them; of texts that share an id the one with the least features counts,
    so that a rerun learns the same. The sample of labels is bounded, so it is broadcast; only features
    of its documents reach the driver. Without labels of both kinds the model is its intercept.
    """
    import numpy as np

    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")
    )
    sample = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(sample_rows)
    rated = map_texts(
        docs.select("doc_id", "text").join(F.broadcast(sample.select("_id")), F.col("doc_id") == F.col("_id"), "left_semi"),
        lambda ids, texts: [ids, [features(t or "") for t in texts]],
        "x array<double>",
    ).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = sorted((r["doc_id"], r["_y"], r["x"]) for r in rated.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "x").collect())
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), [r[1] for r in rows])


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and score (0 to 1, higher: label 1 likelier).

    Null counts as empty, and an empty text has the score of its features, all of them 0. Repeated
    rows get equal scores; other columns are not read. Features are of the whole text.
    """

    def rate(ids, texts):
        import numpy as np

        x = np.array([features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return [ids, model.score(x).tolist()]

    return map_texts(docs, rate, "score double", id_col, text_col)


def score_column(model: Additive, text_col: str = "text"):
    """The score as a column expression, for filters that keep a table's own columns; null counts as empty."""
    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        import numpy as np

        found = [features(t.as_py() or "") for t in texts]  # one text at a time
        return pa.array(model.score(np.array(found, dtype=float).reshape(-1, len(FEATURES))))

    return rate(F.col(text_col).cast("string"))
