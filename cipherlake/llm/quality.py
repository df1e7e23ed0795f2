"""Quality by histogram gradient-boosted trees over document statistics.

Features are counts and shares of bytes, words and lines of the whole text. The
trees are grown in numpy: features are cut into quantile bins once, each level
of a tree takes its gains from histograms of gradients, and every tree is a
complete one laid out in arrays, so scoring a batch is a few gathers per level.
Training takes a bounded sample of labelled rows; the log-odds are moved from
the sample's rate of positives to that of all training rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cipherlake.llm.common import LOWER, held_out, labelled_sample, strings

NAMES = ("log_words", "word_length", "distinct_words", "top_word", "adjacent_repeats", "distinct_pairs", "digits", "upper", "exclamations", "bars", "symbols", "stops", "non_ascii", "blanks", "log_lines", "distinct_lines", "words_per_line", "ends_with_stop", "long_words", "short_words", "links", "brackets")
_DIGITS, _UPPER = np.arange(48, 58), np.arange(65, 91)
_SYMBOLS, _STOPS, _BLANKS, _BRACKETS = (np.frombuffer(x, np.uint8) for x in (b"*#%&$@~^+=_\\", b".,;:?", b" \t\n\r", b"()[]{}<>"))


def features(text: str | None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.translate(LOWER).split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = n - 1
    return [
        math.log(n),
        lengths.mean(),
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / max(pairs, 1),
        len(set(zip(words, words[1:]))) / max(pairs, 1),
        count[_DIGITS].sum() / size,
        count[_UPPER].sum() / size,
        count[33] / n,
        count[124] / n,
        count[_SYMBOLS].sum() / n,
        count[_STOPS].sum() / n,
        count[128:].sum() / size,
        count[_BLANKS].sum() / size,
        math.log(len(lines)),
        len(set(lines)) / len(lines),
        n / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        (lengths > 15).mean(),
        (lengths <= 3).mean(),
        raw.count(b"://") / n,
        count[_BRACKETS].sum() / n,
    ]


class Trees:
    """Complete trees of one depth in arrays: ``feature`` and ``cut`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    def __init__(self, feature, cut, leaf, start):
        self.feature, self.cut, self.leaf, self.start = feature, cut, leaf, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def grow(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Boosted trees for the logistic loss; a split needs ``least`` hessian on either side."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, p0 = 2**depth - 1, min(max(y.mean(), 1e-6), 1 - 1e-6)
    start = math.log(p0 / (1 - p0))
    feature, cut, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1))
    f = np.full(n, start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-9)
            for j in range(m):
                if not len(edges[j]):
                    continue
                at = (node - first) * (len(edges[j]) + 1) + binned[:, j]
                cells = wide * (len(edges[j]) + 1)
                gs, hs = (np.bincount(at, v, cells).reshape(wide, -1) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                better = top > best
                best[better] = top[better]
                feature[t, first : first + wide][better] = j
                cut[t, first : first + wide][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        gs, hs = (np.bincount(node - inner, v, inner + 1) for v in (g, h))
        leaf[t] = rate * gs / (hs + ridge)
        f += leaf[t][node - inner]
    return Trees(feature, cut, leaf, start)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Trees | None:
    """Trees from at most ``per_class`` training rows of each label; None without both labels."""

    def run(batches):
        for batch in batches:
            rows = [features(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = labelled_sample(docs.sparkSession, docs, labels, "quality", per_class).select("text", "label").mapInArrow(run, "x array<double>, y int").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    order = np.lexsort(np.vstack([x.T, y]))  # partitions come in any order; sums of floats depend on it
    trees = grow(x[order], y[order])
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    real, seen = (min(max(v, 1e-6), 1 - 1e-6) for v in (usable.agg(F.avg("quality")).first()[0], y.mean()))
    trees.start += math.log(real / (1 - real)) - math.log(seen / (1 - seen))
    return trees


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 4000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold``).

    Null, empty and blank texts have all-zero statistics and the score of those.
    A null doc_id counts as the text ``None`` for the fold. Without training
    rows of both labels every score is 0. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in strings(batch.column(1))]).reshape(-1, len(NAMES))
            s = np.zeros(len(x)) if model.value is None else 1 / (1 + np.exp(-np.clip(model.value.margin(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
