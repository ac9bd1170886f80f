"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level from feature histograms in numpy, on at most about ``SAMPLE`` labelled documents drawn by the hash
of doc_id. They are flattened into arrays (feature, threshold, leaf value by node number), which a batch of documents walks
down together. Scoring is one map over whole texts.

Edge cases: a null or empty text has all-zero statistics and is scored like any other. Without labels the score is 0.5. Labels
that contradict each other on one doc_id count as the higher one; rows with a null doc_id or quality teach nothing. A null
doc_id is not held out. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.langid import is_held_out

#: Labelled documents that are learned from; trees, their depth, bins, learning rate, leaf regularisation, least weight in a leaf.
SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 80, 5, 64, 0.15, 2.0, 8.0

FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "lower", "upper", "digit", "space", "newline", "stop_comma", "symbol", "foreign",
    "exclaim", "entropy", "distinct_words", "top_word", "adjacent", "distinct_pairs", "words_a_line", "repeated_lines", "lettered_words",
    "capital_words", "all_capital_words", "short_words", "long_words", "braces", "pipes",
)

_CLASS = np.zeros(256, np.int64)  # 0: controls
for _name, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t"), (5, b"\n"), (6, b".,"), (7, [b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,"]), (8, range(128, 256))):
    _CLASS[list(_bytes)] = _name
_LETTERED = re.compile(rb"[A-Za-z\x80-\xff]")


def statistics(text: bytes | None) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(len(FEATURES))
    text = text or b""
    if not text:
        return out
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, by_byte, 9) / len(text)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = by_byte[by_byte > 0] / len(text)
    pairs = set(zip(words, words[1:], strict=False))
    lettered = [w for w in counts if _LETTERED.search(w)]
    out[:] = (
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, *by_class[1:9], by_byte[33] / len(text), -(p * np.log2(p)).sum(),
        len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(pairs) / n,
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(lettered) / max(1, len(counts)),
        sum(counts[w] for w in lettered if w[:1].isupper()) / n, sum(counts[w] for w in lettered if w.isupper()) / n,
        sum(k for w, k in counts.items() if len(w) <= 3) / n, sum(k for w, k in counts.items() if len(w) >= 12) / n,
        (by_byte[list(b"{}[]<>()")].sum()) / len(text), by_byte[124] / len(text),
    )
    return out


class Trees:
    """Boosted trees as arrays over node numbers: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fits logistic loss."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n_features = x.shape[1]
    offset = np.arange(n_features) * BINS
    total = np.full(len(y), base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * n_features * BINS + offset + bins).reshape(-1)
            shape = (width, n_features, BINS)
            gs, hs = (np.bincount(cell, np.repeat(w, n_features), width * n_features * BINS).reshape(shape).cumsum(2) for w in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < LEAST) | (ht - hs < LEAST)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            use = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // BINS, best % BINS
            b = np.where(use, b, BINS)
            for i in np.flatnonzero(use):
                feature[k, first + i] = f[i]
                threshold[k, first + i] = edges[f[i]][min(b[i], len(edges[f[i]]) - 1)] if b[i] < len(edges[f[i]]) else np.inf
            f = np.where(use, f, 0)
            at = 2 * at + 1 + (bins[np.arange(len(y)), f[at - first]] > b[at - first])
        leaf = at - inner
        value[k] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[k][leaf]
    return Trees(base, feature, threshold, value)


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.empty((0, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns from labelled documents outside the held-out third."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("quality").cast("double")).alias("__label"))
    own = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text")).withColumn("__mark", F.xxhash64("text"))
    # different rows only, so that one that comes again and again is drawn once
    rows = own.select("__doc", "__mark").join(known, F.col("__doc") == F.col("__id")).groupBy("__doc", "__mark").agg(F.max("__label").alias("__label"))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("__doc", "__mark"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("__label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    # about ``sample`` rows of three numbers: a broadcast of a few hundred kB
    rows = own.join(F.broadcast(drawn), ["__doc", "__mark"]).groupBy("__doc", "__mark", "__label").agg(F.first("text").alias("text")).select("__label", "text")
    table = rows.mapInArrow(run, "label double, x array<double>").toArrow()
    y = table.column("label").to_numpy()
    x = np.array(table.column("x").to_pylist()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))
    return boost(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame | None = None, model: Trees | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                s = shared.value.score(_matrix(part.column("text").cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = is_held_out(F.col("doc_id")).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
