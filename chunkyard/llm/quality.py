"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents and
flattened into numpy node arrays, one row per tree, so that a batch of
documents is scored by a few gathers per tree level. For chosen statistics the
score may only rise with the statistic, which splits and leaf bounds enforce.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import flat, lean, map_batches, table
from .words import BLANKS, SLICE, row_hashes, runs

#: Labelled rows that are learned from: those with the smallest hash of doc_id.
SAMPLE = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Bytes that begin a code point and are no ASCII blank; the symbols; capitals; digits; exclamation marks; stops and commas.
CLASSES = np.stack(
    [
        np.array([b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r" for b in range(256)]),
        *(np.isin(np.arange(256), list(chars)) for chars in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b".,")),
    ]
)
LINE_ENDS = np.arange(256) == 10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeated", "distinct", "capitals", "digits", "exclamations", "stops", "words_a_line")
#: The score (bad quality) may only rise with these.
RISING = ("symbols", "dup_lines", "repeated", "exclamations")


def _repeats(words: np.ndarray) -> int:
    """Words (by their hashes) in three-word windows that are found twice or more."""
    windows = row_hashes(words, 3)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit, at = np.zeros(len(words), bool), np.flatnonzero(np.isin(windows, twice))
    for i in range(3):
        hit[at + i] = True
    return int(hit.sum())


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[CLASSES, texts]: bytes of each class, a slice of the data at a time."""
    out = np.zeros((len(CLASSES), len(offsets) - 1), np.int64)
    total = np.zeros(SLICE + 1, np.int32)
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        at = np.clip(offsets - a, 0, len(part))
        for of, counted in zip(CLASSES, out, strict=True):
            np.cumsum(of[part], out=total[1 : len(part) + 1])
            counted += np.diff(total[at])
    return out


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """BASE (int64) and FEATURES (float64) of each text; null counts as empty. Words and lines are told apart by 64-bit hashes."""
    data, offsets = flat(column)
    word_chars, symbols, capitals, digits, exclamations, stops = _counts(data, offsets)
    words, starts, _ = runs(data, offsets, BLANKS, False)
    at = np.searchsorted(starts, offsets)
    own_lines, line_starts, _ = runs(data, offsets, LINE_ENDS, False)
    has_word = np.diff(np.append(np.searchsorted(starts, line_starts), len(starts))) > 0
    own_lines, line_starts = own_lines[has_word], line_starts[has_word]
    line_at = np.searchsorted(line_starts, offsets)
    rows = []
    for a, b, c, d in zip(at, at[1:], line_at, line_at[1:], strict=False):
        w, lines = words[a:b], own_lines[c:d]
        rows.append((b - a, d - c, d - c - _distinct(lines), _repeats(w), _distinct(w)))
    n, lines, dup, repeated, distinct = np.array(rows, np.int64).reshape(-1, 5).T
    base = np.stack([n, word_chars, symbols, dup, repeated], axis=1)
    some, chars = np.maximum(n, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [np.log1p(n), word_chars / some, symbols / some, dup / np.maximum(lines, 1), repeated / some, distinct / some, capitals / chars, digits / chars, exclamations / some, stops / some, n / np.maximum(lines, 1)], axis=1
    )
    return base, features


def _distinct(x: np.ndarray) -> int:
    if len(x) < 2:
        return len(x)
    x = np.sort(x)
    return 1 + int(np.count_nonzero(x[1:] != x[:-1]))


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: the children of node i are 2i+1 (feature <= threshold) and 2i+2."""

    start: float
    feature: np.ndarray  # [trees, inner nodes]
    threshold: np.ndarray
    value: np.ndarray  # [trees, leaves]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of bad quality."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):  # all rows are at one level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return total


def fit(x: np.ndarray, bad: np.ndarray, rising: tuple[int, ...] = (), n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for log-loss with Newton leaves; without both classes, no trees and nothing is bad."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(x) == 0 or bad.all() or not bad.any():
        return Trees(-np.inf, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    start = float(np.log(bad.mean() / (1 - bad.mean())))
    margin = np.full(len(x), start)
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - bad, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + leaves)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        at = np.zeros(len(x), np.int64)
        value[0] = -g.sum() / (h.sum() + l2)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            split: list = [None] * width
            node = at - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b, k = node * (len(c) + 1) + binned[f], len(c) + 1
                sums = [np.bincount(b, w, width * k).reshape(width, k).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (ga, ha, na) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                lo, hi = low[first : first + width, None], high[first : first + width, None]
                left, right = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(ga - gl) / (ha - hl + l2), lo, hi)
                own = np.clip(-ga / (ha + l2), lo, hi)
                cost = lambda v, gs, hs: gs * v + 0.5 * (hs + l2) * v * v
                gain = cost(own, ga, ha) - cost(left, gl, hl) - cost(right, ga - gl, ha - hl)
                gain[(nl < least) | (na - nl < least)] = 0
                if f in rising:
                    gain[left > right] = 0
                j = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), j] > best + 1e-9):
                    best[i] = gain[i, j[i]]
                    split[i] = (f, c[j[i]], left[i, j[i]], right[i, j[i]])
            for i, s in enumerate(split):
                me, a, b = first + i, 2 * (first + i) + 1, 2 * (first + i) + 2
                low[[a, b]], high[[a, b]], value[[a, b]] = low[me], high[me], value[me]
                if s:
                    feature[me], threshold[me], value[a], value[b] = s
                    if s[0] in rising:
                        high[a] = low[b] = (s[2] + s[3]) / 2
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        margin += rate * value[at]
        trees.append((feature, threshold, rate * value[inner:]))
    return Trees(start, *(np.stack(t) for t in zip(*trees, strict=True)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Trees from at most `sample` labelled rows (quality 0: bad); null ids and labels are left out."""
    known = lean(labels, doc_id="doc_id", quality="quality").dropna()
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    labelled = lean(docs, doc_id="doc_id", text="text").join(chosen, "doc_id")

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))[1]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # As many rows as the sample, but for ids that are not unique; ordered, so that a rerun learns the same.
    rows = map_batches(labelled, over, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality", "x").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy() == 0, tuple(FEATURES.index(f) for f in RISING), **options)


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the BASE statistics, base_failed, kept, for every row of docs.

    kept is false where the base rules fail or the trees find bad quality more
    likely than not. Null and empty texts have no words, so they fail. Repeated
    rows stay; other columns are ignored. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        failed = base_failed(base)
        kept = ~failed & (shared.value.margin(x) <= 0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in base.T.copy()), pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    given = lean(docs, doc_id="doc_id", text="text")
    return map_batches(given, over, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of docs that are kept, whole and with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        return batch.filter(pa.array(~base_failed(base) & (shared.value.margin(x) <= 0)))

    return map_batches(docs, over, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))
