"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded sample of labelled documents, with the direction of chosen
features held fixed, and flattened into numpy node arrays that score a batch of documents a level at a time.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality, stats

#: Production parameters. At most about SAMPLE labelled documents are grown on, picked by a hash of doc_id.
SAMPLE = 10_000
FOLDS = 5
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 48
LEAST_WEIGHT, RIDGE = 2.0, 1.0
#: A document passes unless the trees give it less than this chance of good quality.
THRESHOLD = 0.3
#: 1: the score may only rise with the feature; -1: only fall.
DIRECTION = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "doubled_share": -1, "exclaim_share": -1, "log_words": 1}
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 20, 30


@dataclass
class Trees:
    """Complete binary trees of one depth in arrays: node i has children 2i + 1 and 2i + 2; a node that splits
    nothing sends all left. ``leaf`` has the values of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), trees), np.int64)
        each = np.arange(trees)[None, :]
        while inner and at[0, 0] < inner if len(x) else False:
            at = 2 * at + 1 + (x[rows, self.feature[each, at]] > self.threshold[each, at])
        return self.start + self.leaf[each, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(self.margin(x) / 2))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def grow(x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss, Newton leaves. A node's bounds pass to its children, the middle of their values between
    them where the split's feature has a direction, so the whole ensemble keeps it."""
    n, d = x.shape
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(feature, threshold, leaf, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    n_cuts = np.array([len(c) for c in cuts])
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        bounds = np.array([[-np.inf, np.inf]])
        for level in range(depth):
            width = 1 << level
            sums = [np.zeros((width, d, BINS)) for _ in range(2)]
            for j in range(d):
                for out, value in zip(sums, (g, h), strict=True):
                    out[:, j] = np.bincount(node * BINS + binned[:, j], value, width * BINS).reshape(width, BINS)
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            low, high = bounds[:, 0, None, None], bounds[:, 1, None, None]
            left_v, right_v = np.clip(left_g / (left_h + RIDGE), low, high), np.clip(right_g / (right_h + RIDGE), low, high)
            gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(all_g, all_h)
            allowed = (left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT) & (direction[None, :, None] * (right_v - left_v) >= 0) & (np.arange(BINS)[None, None, :] < n_cuts[None, :, None])
            gain = np.where(allowed, gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            new = np.empty((2 * width, 2))
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                lo, hi = bounds[k]
                new[2 * k] = new[2 * k + 1] = lo, hi
                if gain[k, best[k]] <= 1e-9:
                    continue
                feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, cuts[j][b]
                if direction[j]:
                    middle = (left_v[k, j, b] + right_v[k, j, b]) / 2
                    new[2 * k + (direction[j] < 0)][1] = new[2 * k + (direction[j] > 0)][0] = middle
            bounds = new
            at = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        top, weight = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = RATE * np.clip(top / (weight + RIDGE), bounds[:, 0], bounds[:, 1])
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, start)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, sample: int = SAMPLE) -> tuple[np.ndarray, Trees]:
    """The usual shares, from all labelled rows, and the trees, from about ``sample`` of them."""
    train = common.saved(stats.labelled(rows, labels, label, folds), "counts-labelled")
    shares, n = quality.usual_shares(train), train.count()
    # of the most finely divided hash range, the part that holds about ``sample`` documents
    part = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n, 1)))).orderBy("doc_id").limit(2 * sample).toPandas()
    x = stats.features(part[list(stats.COUNTS)].to_numpy(), shares) if len(part) else np.zeros((0, len(stats.FEATURES)))
    direction = np.array([DIRECTION.get(f, 0) for f in stats.FEATURES])
    return shares, grow(x, part["y"].to_numpy(float), direction)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, all COUNTS, base_failed, score and kept of every row."""
    rows = common.saved(stats.counts(docs), "counts")
    shares, trees = fit(rows, labels)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = stats.features(pdf[list(stats.COUNTS)].to_numpy(), shares)
            pdf["score"] = np.concatenate([trees.score(x[i : i + 2048]) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
            pdf["base_failed"] = (pdf["n_words"] < LEAST_WORDS) | (100 * pdf["n_repeat_words"] > MOST_REPEATED * pdf["n_words"])
            pdf["kept"] = ~pdf["base_failed"] & (pdf["score"] >= threshold)
            yield pdf

    return rows.mapInPandas(work, quality.COUNT_SCHEMA + ", score double, base_failed boolean, kept boolean")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = judged(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
