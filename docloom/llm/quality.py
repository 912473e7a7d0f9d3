"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text are computed once and written; trees are grown on a bounded sample of labelled rows, flattened into
arrays in heap order, and walked for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_of_id, spread, stash, table

#: Bound of the labelled sample that trees are fitted on, about; it holds at most this many rows at any input size.
SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = [
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "sentence_marks", "exclamations", "pipes", "symbols", "quotes", "non_ascii", "control",
    "mean_word", "sd_word", "max_word", "distinct_words", "short_words", "symbol_ends", "upper_starts", "log_lines", "distinct_lines", "mean_line", "closed_lines", "most_common_word", "distinct_pairs",
]

_CLASS = np.zeros((256, 11), np.float64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|", b"#$%&*<>{}[]\\/=+~^_@", b"\"'`()", bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1
_CONTROL = np.array([i < 32 and i not in (9, 10, 11, 12, 13) or i == 127 for i in range(256)], np.float64)
_SYMBOL = frozenset(b"#$%&*<>{}[]\\/=+~^_@|!")


def statistics(text: str | None) -> np.ndarray:
    """The ``FEATURES`` of one whole text; zeros for null and empty."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    out[0] = np.log1p(n)
    out[2:13] = hist @ _CLASS / n
    out[13] = hist @ _CONTROL / n
    words = raw.split()
    if words:
        lens = np.fromiter(map(len, words), np.float64, len(words))
        distinct: dict[bytes, int] = {}
        for w in words:
            distinct[w] = distinct.get(w, 0) + 1
        m = len(words)
        out[1] = np.log1p(m)
        out[14:17] = lens.mean(), lens.std(), np.log1p(lens.max())
        out[17] = len(distinct) / m
        out[18] = (lens <= 3).mean()
        out[19] = sum(w[-1] in _SYMBOL for w in words) / m
        out[20] = sum(65 <= w[0] <= 90 for w in words) / m
        out[25] = max(distinct.values()) / m
        out[26] = len(set(zip(words, words[1:]))) / max(1, m - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if lines:
        out[21] = np.log1p(len(lines))
        out[22] = len(set(lines)) / len(lines)
        out[23] = np.log1p(n / len(lines))
        out[24] = sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of each row of ``docs(doc_id, text)`` as an array of floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                x = np.stack([statistics(t.as_py()) for t in batch.column("text")]).astype(np.float32)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Trees:
    """Complete trees of one depth in heap order; ``value`` holds the leaves. ``feature`` and ``cut``: (trees, inner nodes)."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; all trees and rows take a step together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        total = self.base + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees by logistic loss; each feature is cut at its quantiles into ``bins`` bins, splits come from histograms."""
    empty = Trees(0.0, depth, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    if not len(y) or y.min() == y.max():
        empty.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        return empty
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(d)]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, base)
    inner = 2**depth - 1
    feats, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain_best, at = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(d):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                place = local * k + coded[:, j]
                sums = [np.bincount(place, w, width * k).reshape(width, k) for w in (g, h, None)]
                left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
                whole = [s.sum(axis=1, keepdims=True) for s in sums]
                right = [a - b for a, b in zip(whole, left)]
                gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
                gain[(left[2] < least) | (right[2] < least)] = -1
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > gain_best
                gain_best[better] = top[better]
                at[better] = np.stack([np.full(width, j), b], axis=1)[better]
            for i in np.flatnonzero(at[:, 0] >= 0):
                feature[first + i], cut[first + i] = at[i, 0], edges[at[i, 0]][at[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        total = total + value[leaf]
        feats.append(feature), cuts.append(cut), values.append(value)
    return Trees(base, depth, np.stack(feats), np.stack(cuts), np.stack(values))


def held_out(doc_id) -> F.Column:
    return crc_of_id(doc_id) % 4 == 2


def learn(features: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Trees:
    """Trees from ``features(doc_id, x)`` and ``labels(doc_id, quality)``; rows without a label or an id, or held out, don't count.

    An id that is labelled more than once has the label of most of its rows (0 in a tie); rows that share a labelled id all count. Beyond
    ``sample`` labelled rows, those with the smallest hashes of their id are taken. Without any, or with one label alone, all scores are
    alike.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg((F.avg((F.col("quality") > 0).cast("int")) > 0.5).cast("int").alias("quality"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(0.97 * sample / n * (1 << 30)))
    rows = features.join(labels, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("x", "quality").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return fit(np.stack(rows["x"].to_list()).astype(np.float32), (rows["quality"].to_numpy() > 0).astype(float))


def score(features: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score`` for each row of ``features(doc_id, x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for k in range(0, batch.num_rows, 2048):
                part = batch.column("x").slice(k, 2048)
                out.append(trees.predict(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored by their zero statistics; repeated rows stay rows, and tie; a null id is held out if the crc32 of the
    empty text says so; long texts are measured whole; columns but id and text are ignored; an empty table gives no rows."""
    features = stash(with_statistics(spread(table(spark, sf_dir, "documents"))), "statistics")
    trees = learn(features, table(spark, sf_dir, "labels"))
    return score(features, trees).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
