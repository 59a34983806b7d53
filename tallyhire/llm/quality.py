"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

The trees are fitted on the driver from a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id, never from
the held-out fold); only their statistics are collected, one vector per row.  Fitting sees each statistic as one of at
most ``BINS`` quantile bins and grows complete trees level by level from histograms of gradients.  The fitted trees are
flat arrays: node *k* of a tree has its children at *2k+1* and *2k+2*, so a batch of documents walks a tree by ``depth``
rounds of array indexing.

Statistics are taken from the text alone.  Cases: a null or empty text has all statistics zero and gets a score like any
other; repeated rows get equal scores; a null doc_id is scored and never held out; other columns are not read; without a
usable label the score is one half; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyhire.llm.common import as_bytes, fit_rows, held_out, slices

#: Labelled rows that the trees are fitted on, at most.
FIT_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, RIDGE, LEAST_ROWS = 60, 4, 0.2, 1.0, 10
THRESHOLD = 0.3

UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a"):ord("z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
SYMBOLS = [ord(c) for c in "#*$%&|<>@=~^_{}[]\\/+"]
STOPS = [ord(c) for c in ".!?"]

STATISTICS = (
    "words", "bytes_per_word", "distinct_share", "next_repeat_share", "top_word_share", "short_word_share",
    "long_word_share", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "comma_share",
    "stop_share", "wide_share", "lines", "words_per_line", "repeated_line_share", "space_share", "single_letter_share",
    "worst_symbol_share", "worst_upper_share", "least_distinct_share",
)
#: Words of a stretch; the worst stretch tells a text that is partly bad from one that is a little bad all over.
STRETCH = 64


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = int(counts.sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = max(1, int(counts[UPPER].sum() + counts[LOWER].sum()))
    upper, symbols = int(counts[UPPER].sum()), int(counts[SYMBOLS].sum())

    # per stretch of words, from the bytes between word ends
    ends = np.cumsum(lengths)
    body = np.frombuffer(b"".join(words), np.uint8)
    cuts = np.concatenate([[0], ends[STRETCH - 1:n - STRETCH // 2:STRETCH] if n > STRETCH else []]).astype(np.int64)
    is_symbol = np.zeros(256, np.int64)
    is_symbol[SYMBOLS] = 1
    spans = np.diff(np.append(cuts, len(body)))
    symbol_by = np.add.reduceat(is_symbol[body], cuts) / spans
    upper_by = np.add.reduceat(UPPER[body].astype(np.int64), cuts) / spans
    bounds = np.searchsorted(ends, cuts, side="right") if len(cuts) > 1 else np.array([0])
    bounds[0] = 0
    distinct_by = [len(np.unique(c)) / max(1, len(c)) for c in np.split(codes, bounds[1:])]
    return [
        float(np.log1p(n)), float(lengths.mean()), len(number) / n,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, float(np.bincount(codes).max()) / n,
        float((lengths <= 2).mean()), float((lengths >= 14).mean()), upper / letters,
        float(counts[DIGIT].sum()) / size, symbols / n, float(counts[ord("!")]) / n, float(counts[ord("|")]) / n,
        float(counts[ord(",")]) / n, float(counts[STOPS].sum()) / n, float(counts[128:].sum()) / size,
        float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines),
        1 - len(body) / size, float((lengths == 1).mean()),
        float(symbol_by.max()), float(upper_by.max()), float(min(distinct_by)),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, one row per tree; a node that is not split sends every row to its first child."""

    bias: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = (self.features.shape[1] + 1).bit_length() - 2 if self.features.size else 0
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1.  A split needs ``LEAST_ROWS`` rows on either side; without one both ways are equal."""
    inner, nodes = 2 ** DEPTH - 1, 2 ** (DEPTH + 1) - 1
    none = Forest(0.0, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)))
    if not len(y):
        return none
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Forest(bias, none.features, none.thresholds, none.values)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    columns = np.arange(x.shape[1]) * BINS
    flat, margin = binned + columns, np.full(len(y), bias)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
        threshold, value, node = np.full(nodes, np.inf), np.zeros(nodes), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            shape = (width, x.shape[1], BINS)
            g, h, c = (np.bincount(cell, w, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2) for w in (
                np.repeat(gradient, x.shape[1]), np.repeat(weight, x.shape[1]), None))
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g)**2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain = np.where((c >= LEAST_ROWS) & (all_c - c >= LEAST_ROWS), gain, -1).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(width), best] > 1e-9):
                j, b = divmod(int(best[k]), BINS)
                feature[first + k], cut[first + k], threshold[first + k] = j, b, edges[j][b]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        sums = np.bincount(node, gradient, minlength=nodes) / (np.bincount(node, weight, minlength=nodes) + RIDGE)
        value[inner:] = RATE * sums[inner:]
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(bias, np.array(features), np.array(thresholds), np.array(values))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array([statistics(t) for t in as_bytes(batch, "text")], pa.list_(pa.float64())),
        ], names=["doc_id", "label", "x"])


def fitted(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Forest:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    rows = fit_rows(documents, labels, "quality", most).selectExpr("cast(doc_id as long) doc_id", "text", "label").mapInArrow(
        _vectors, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r"))
    found = rows.orderBy("doc_id").select("r.x", "r.label").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, np.array(found.column("label").to_pylist(), float))


def scored(documents: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = forest.score(np.array([statistics(t) for t in as_bytes(batch, "text")], float))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
            ], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, documents.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer"))


def passing(documents: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score reaches the threshold, all columns as they were."""
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(forest.score(np.array([statistics(t) for t in texts], float)) >= threshold))

    return documents.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema]))
