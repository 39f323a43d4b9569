"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees kept as flat node arrays.

Statistics are computed for many texts at once from their bytes (numpy, no loop over words). The trees are trained here
on a bounded sample of labelled rows, with monotonic constraints on chosen statistics, and scoring walks all rows
down all trees level by level through flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACE, Hashes, mixed, release, spread, text_chunks, words

#: Labelled rows that the trees are fitted on: those with the least hash of doc_id.
SAMPLE_ROWS = 12_000
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

STATISTICS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "line_words", "long_word_rate", "end_mark_rate")
#: -1: a higher value never raises the score.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1}

_CLASS = {
    "symbol": np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8)),
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "mark": np.isin(np.arange(256), np.frombuffer(b"!?@^~=+_/\\{}[]", np.uint8)),
    "first": (np.arange(256) & 0xC0) != 0x80,
}


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again; does it occur earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    earlier[order[1:]] = same
    return again, earlier


def statistics(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts end to end: n_words and STATISTICS (integers), and FEATURES (floats), a row per text."""
    n = len(off) - 1
    start, end, first = words(raw, off)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_CLASS["first"][raw], out=points[1:])
    lengths = points[end] - points[start]
    word_chars = np.bincount(doc, lengths, n).astype(np.int64)
    symbols = _per_text(_CLASS["symbol"][raw], off)
    hashes = Hashes(raw)

    salt = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        word = hashes.of(start, end)
        repeat = np.zeros(n, np.int64)
        if len(start) >= WINDOW:
            full = doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]
            key = salt[doc[: len(full)]].copy()
            for k in range(WINDOW):
                key = mixed(key * np.uint64(0xD1342543DE82EF95) + word[k : k + len(full)])
            at = np.flatnonzero(full)
            again, _ = _repeats(key[at])
            edge = np.zeros(len(start) + WINDOW + 1, np.int64)
            edge[at[again]] += 1
            edge[at[again] + WINDOW] -= 1
            repeat = np.bincount(doc, np.cumsum(edge)[: len(start)] > 0, n).astype(np.int64)
        _, word_earlier = _repeats(mixed(word ^ salt[doc]))
    distinct = n_words - np.bincount(doc, word_earlier, n).astype(np.int64)

    breaks = np.flatnonzero(raw == 10)
    line_start = np.union1d(off[:-1][off[:-1] < off[1:]], breaks + 1) if len(raw) else np.zeros(0, np.int64)
    line_start = line_start[line_start < len(raw)]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    nearest = np.searchsorted(breaks, line_start)
    line_end = np.minimum(np.append(breaks, len(raw))[nearest], off[line_doc + 1])
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    _, line_earlier = _repeats(mixed(hashes.of(line_start, line_end) ^ salt[line_doc]))
    dup_lines = np.bincount(line_doc, line_earlier, n).astype(np.int64)
    lines = np.bincount(line_doc, minlength=n)

    closing = np.isin(raw[end - 1], np.frombuffer(b".?!:;", np.uint8)) if len(end) else np.zeros(0, bool)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    rate = lambda name: _per_text(_CLASS[name][raw], off) / c
    features = np.column_stack([
        np.log1p(n_words), word_chars / w, symbols / c, dup_lines / np.maximum(lines, 1), repeat / w, rate("upper"), rate("digit"), rate("mark"),
        distinct / w, n_words / np.maximum(lines, 1), np.bincount(doc, lengths > 20, n) / w, np.bincount(doc, closing, n) / w,
    ])
    return np.column_stack([n_words, word_chars, symbols, dup_lines, repeat]), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


@dataclass
class Forest:
    """All trees' nodes end to end. A leaf is its own child; ``value`` counts at leaves only."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds, for all rows at once: every step moves all (row, tree) pairs one level down."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at].sum(1) + self.bias


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0, monotone: dict[str, int] | None = None) -> Forest | None:
    """Second-order boosting of logistic loss on binned features; None if the labels don't have both classes.

    A split on a constrained feature must order its two leaf values as the constraint says, and its midpoint bounds
    what the subtrees may say, so the whole forest is monotone in that feature.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES[: x.shape[1]]])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), bias)
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(**node) -> int:
        for k, v in node.items():
            out[k].append(v)
        return len(out["value"]) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        value = float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(code[rows, j], w, len(e) + 1))[:-1] for w in (g, h, None))
                gr, hr, nr = g.sum() - gs, h.sum() - hs, len(rows) - ns
                vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gs * vl + (hs + ridge) * vl**2 / 2 + gr * vr + (hr + ridge) * vr**2 / 2) + (g.sum() * value + (h.sum() + ridge) * value**2 / 2)
                gain[(ns < least) | (nr < least) | (signs[j] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k, vl[k], vr[k])
        _, j, k, vl, vr = best
        if j < 0:
            me = add(feature=0, threshold=np.inf, left=0, right=0, value=rate * value)
            out["left"][me] = out["right"][me] = me
            score[rows] += rate * value
            return me
        me, mid, left = add(feature=j, threshold=edges[j][k], left=0, right=0, value=0.0), (vl + vr) / 2, code[rows, j] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[j])]
        out["left"][me] = grow(rows[left], level + 1, *bounds[0])
        out["right"][me] = grow(rows[~left], level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
    arrays = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in out.items()}
    return Forest(**arrays, roots=np.array(roots), depth=depth, bias=bias)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, raw, off in text_chunks(b.column("text")):
            x = statistics(raw, off)[1]
            yield pa.RecordBatch.from_arrays([b.column("label").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Train on ``labels`` (doc_id, quality), ``sample_rows`` of them at most; the sample's ids are the one broadcast.

    Labels of one id count once: where they clash most decide, and good if it is even. So do rows of one id, by their
    least text, so no more than ``sample_rows`` rows of features reach the driver. Null ids and labels teach nothing.
    """
    sample = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))
    found = rows.drop("_id").mapInArrow(_feature_rows, "label double, x array<double>").toArrow()
    if not len(found):
        return None
    x = np.array(found.column("x").to_pylist())
    y = found.column("label").to_numpy()
    order = np.lexsort([*x.T, y])  # the order rows come in must not matter
    return train(x[order], y[order])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def assess(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """Statistics and verdict of every row: one pass, no shuffle. Without a forest only the base rules judge.

    Reads ``doc_id``, a number, and ``text``, whatever other columns there are.
    A null or empty text has no words, fails the base rules and is not kept. Rows that repeat get equal verdicts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for i, j, raw, off in text_chunks(b.column("text")):
                counts, x = statistics(raw, off)
                failed = base_failed(counts)
                score = 1 / (1 + np.exp(-forest.scores(x))) if forest is not None else np.where(failed, 0.0, 1.0)
                cols = [b.column("doc_id").slice(i, j - i), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, SCHEMA)


def keep_good(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that ``assess`` would keep: filtered where they are read, no shuffle.

    Null and empty texts go; rows that repeat go or stay together; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            good = []
            for _, _, raw, off in text_chunks(b.column("text")):
                counts, x = statistics(raw, off)
                score = 1 / (1 + np.exp(-forest.scores(x))) if forest is not None else np.ones(len(counts))
                good.append(~base_failed(counts) & (score >= threshold))
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return spread(docs).mapInArrow(rows, docs.schema)
