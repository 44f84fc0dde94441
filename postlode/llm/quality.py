"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (length, characters by class, words, repetition, lines) are computed over whole
texts in Arrow batches. Trees are fitted on the driver to at most ``sample`` labelled rows,
taken by hash order: features are cut into quantile bins, each level of a tree is grown from
gradient histograms, and all trees lie in flat arrays by heap order, so that a batch of
documents walks down all trees at once by indexing.

Null text counts as empty and is scored like any other. Labels that are null, or of rows
without id, teach nothing; several labels of one id count by their mean, and of several texts
of one id the one with the least statistics teaches. With no label the
score is 1 (nothing is rejected); with labels of one kind it is their smoothed mean. Repeated
rows are scored alike. An empty table gives no rows. Only doc_id and text of documents are
read; doc_id only to choose and join labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, crc_bucket

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b" ", b"\n\r", b"\t\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
#: What is left: symbols and control characters.
NAMES = (
    "log_bytes log_words word_length longest_word other lower upper digit punctuation exclamation pipe space line tab "
    "non_ascii distinct_words repeated_word repeated_second upper_words symbol_words lines line_words distinct_lines entropy"
).split()


def statistics(text: bytes | None) -> list[float]:
    """The features of one text, in the order of NAMES."""
    text = text or b""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=11) / n
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        float(min(200, max(map(len, words), default=0))),
        *by_class,
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        sum(map(eq, words, words[2:])) / w,
        sum(map(bytes.isupper, words)) / w,
        sum(not x[-1:].isalnum() for x in words) / w,
        np.log1p(len(lines)),
        w / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(NAMES))


@dataclass(frozen=True)
class Trees:
    """Trees of one depth in heap order: children of node i at 2i+1 (value <= threshold) and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        total = self.base + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0
) -> Trees:
    """Logistic boosting by second-order histograms; ``least``: hessian that each child must hold."""
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not len(y):
        return Trees(np.inf, feature, threshold, leaf)
    rows, width = x.shape
    mean = (y.sum() + 0.5) / (rows + 1)
    base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    cut = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    columns = np.arange(width)[None, :]
    total = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            n = 2**level
            key = ((node[:, None] * width + columns) * bins + cut).ravel()
            size = n * width * bins
            gs = np.bincount(key, np.repeat(g, width), size).reshape(n, width, bins).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, width), size).reshape(n, width, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = -1
            best = gain.reshape(n, -1).argmax(axis=1)
            good = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            f, b = best // bins, best % bins
            heap = n - 1 + np.arange(n)
            feature[t, heap] = f
            for i in np.flatnonzero(good):
                threshold[t, heap[i]] = edges[f[i]][b[i]] if b[i] < len(edges[f[i]]) else np.inf
            right = x[np.arange(rows), feature[t, heap][node]] > threshold[t, heap][node]
            node = 2 * node + right
        gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * gl / (hl + ridge)
        total += leaf[t, node]
    return Trees(base, feature, threshold, leaf)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 20_000) -> Trees:
    """Trees of at most ``sample`` labelled rows; ``usable`` is over ``doc_id``."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select(F.col("doc_id").alias("l_id"), "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "l_id"])

    # the limit bounds what is broadcast, and (but for repeats of an id) what comes back
    texts = docs.select(F.col("doc_id").alias("l_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "l_id").select("text", "y", "l_id")
    each = bounded_batches(rows).mapInArrow(features, "x array<double>, y double, l_id long").groupBy("l_id").agg(F.min(F.struct("x", "y")).alias("r"))
    got = each.select("l_id", "r.x", "r.y").orderBy("l_id").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit(x, (got["y"].to_numpy() >= 0.5).astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 5) == 0, F.lit(False))


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` (1 at ``threshold`` and above) of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = trees.scores(matrix(b.column(1)))
            columns = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return bounded_batches(texts).mapInArrow(each, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay."""
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(trees.scores(matrix(b.column(at).cast(pa.binary()))) >= threshold))

    return bounded_batches(docs).mapInArrow(each, docs.schema)
