"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on what recurs in toxic text and not in
ordinary text. A window of a text is compressed with the ordinary dictionary alone and with both; the bytes that the
toxic one saves are the window's distance. A text's largest savings, and how many windows save at least so many bytes,
are calibrated into a probability by a logistic fit on labelled texts that trained neither dictionary.

Dictionaries trained on whole toxic and ordinary texts, compared with each other, were tried first and miss too much:
toxic text is ordinary text but for a few words, so two such dictionaries differ mostly in what ordinary strings they
happened to keep (README has the figures).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import LOWER, drop_table, spread, write_table

#: Labelled rows that are learned from, those with the least hash of doc_id; two of three train the dictionaries.
SAMPLE_ROWS = 12_000
#: Windows of ordinary text, and of marks of toxic text, that a dictionary is trained on, and bytes of one.
SAMPLE_WINDOWS, SAMPLE_BYTES = 40_000, 256
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
#: Bytes of a window, and zstandard's level.
WINDOW, LEVEL = 40, 13
#: Stands before every window and always compresses: a block that doesn't is stored as it is, and hides small savings.
LEAD = b"\0" * 31 + b" "
#: Savings that are counted.
SAVED = (1, 2, 3, 4, 5)
#: A word marks toxic text if it follows so many different words there, by share of toxic texts and at least, and so
#: many times as many as in ordinary text, text for text.
LEAST_SHARE, LEAST_TEXTS, TIMES = 0.015, 3, 10
#: Bytes of texts that are compressed together.
TOGETHER = 1 << 20

_LOWER = bytes(LOWER)
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]{4,}")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def cuts(text: bytes, size: int) -> list[int]:
    """Where windows of at most ``size`` bytes end: after a space where they can. They hold the whole text."""
    out, at, n, find = [], 0, len(text), text.rfind
    while at < n:
        to = at + size
        if to < n:
            space = find(b" ", at, to)
            to = space + 1 if space > at else to
        else:
            to = n
        out.append(to)
        at = to
    return out


def pairwise_words(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Each word of at least four bytes with the one before it."""
    found = _WORD.findall(text)
    return zip(found, [b"", *found], strict=False)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own last bytes
        return b"".join(samples)[-size:]


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to (label, word, before)."""
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words, before = zip(*set(pairwise_words(_lowered(text))), strict=True) if text and _WORD.search(_lowered(text)) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(words), pa.float64()), pa.array(words, pa.binary()), pa.array(before, pa.binary())], names=["label", "word", "before"])


def _windows_of(marks: frozenset[bytes] | None):
    """Rows (text) to windows: of the text, or of its words that are marks, with spaces between."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                data = _lowered(text)
                if marks is not None:
                    found = [w for w in _WORD.findall(data) if w in marks]
                    data = b" " + b" ".join(found) + b" " if found else b""
                ends = cuts(data, SAMPLE_BYTES)
                yield pa.RecordBatch.from_arrays([pa.array([data[i:j] for i, j in zip([0, *ends], ends, strict=False)], pa.binary())], names=["w"])

    return rows


def _drawn(rows: DataFrame, marks: frozenset[bytes] | None) -> list[bytes]:
    """``SAMPLE_WINDOWS`` of the rows' windows at most, those with the least hash, in an order of their own."""
    w = rows.select("text").mapInArrow(_windows_of(marks), "w binary").withColumn("_h", F.xxhash64("w"))
    return [bytes(x) for x in w.orderBy("_h", "w").limit(SAMPLE_WINDOWS).toArrow().column("w").to_pylist()]


def train_dictionaries(rows: DataFrame) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary of rows (label, text); None if a class is missing or nothing marks toxic text.

    Words and the words they follow are counted by the executors over whole texts; near copies repeat a word after the
    same one, so they don't count. What comes to the driver are the marks and a bounded number of windows.
    """
    n = {r["label"]: r["n"] for r in rows.where(F.length("text") > 0).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0.0, 1.0}:
        return None
    seen = rows.select("label", "text").mapInArrow(_pair_rows, "label double, word binary, before binary").distinct()
    had = seen.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
    least = max(LEAST_TEXTS, LEAST_SHARE * n[1.0])
    kept = had.where((F.col("toxic") >= least) & (F.col("toxic") / n[1.0] >= TIMES * (F.col("ordinary") + 0.5) / n[0.0]))
    marks = frozenset(bytes(r["word"]) for r in kept.select("word").collect())
    samples = _drawn(rows.where("label = 1"), marks) if marks else []
    if not samples:
        return None
    return _dictionary(ORDINARY_BYTES, _drawn(rows.where("label = 0"), None)), _dictionary(TOXIC_BYTES, samples)


class Distance:
    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        kept = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (ordinary, ordinary + toxic)]
        self.without, self.with_ = (zstandard.ZstdCompressor(dict_data=d, compression_params=how) for d in kept)

    def saved(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved in each window of all texts, and where each text's windows start (one more at the end)."""
        ends = [cuts(t, WINDOW) for t in texts]
        first = np.append(0, np.cumsum([len(e) for e in ends]))
        if not first[-1]:
            return np.zeros(0, np.int64), first
        led = [LEAD + t[i:j] for t, e in zip(texts, ends, strict=True) for i, j in zip([0, *e], e, strict=False)]
        sizes = np.fromiter(map(len, led), np.int64, len(led))
        at = np.column_stack([np.cumsum(sizes) - sizes, sizes]).astype(np.uint64)
        source = zstandard.BufferWithSegments(b"".join(led), at.tobytes())
        lengths = []
        for c in (self.without, self.with_):
            out = c.multi_compress_to_buffer(source)
            lengths.append(np.fromiter(map(len, map(out.__getitem__, range(len(out)))), np.int64, len(out)))
        return lengths[0] - lengths[1], first

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the sums of its 1, 2 and 4 largest savings, counts by SAVED, shares, and the number of windows."""
        found, first = self.saved([_lowered(t) for t in texts])
        rows = np.zeros((len(texts), 4 + 2 * len(SAVED)))
        for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if i < j:
                own = found[i:j]
                top = np.sort(own)[::-1][:4]
                n = np.array([np.count_nonzero(own >= least) for least in SAVED])
                rows[k] = (top[0], top[:2].sum(), top.sum(), *np.log1p(n), *n / (j - i), np.log1p(j - i))
        return rows


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, scales, weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _feature_rows(ordinary: bytes, toxic: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(ordinary, toxic)
        for b in batches:
            texts, at, held = b.column("text").to_pylist(), 0, 0
            for k, t in enumerate(texts, 1):
                held += len(t or "")
                if held >= TOGETHER or k == len(texts):
                    x = distance.features(texts[at:k])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k - at), pa.array(list(x), pa.list_(pa.float64()))], names=[b.schema.names[0], "x"])
                    at, held = k, 0

    return rows


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from ``labels`` (doc_id, toxic), held-out rows left aside; None if they don't show both classes.

    ``sample_rows`` labels at most are joined with their texts, whole, whatever their length; of these, as many distinct
    texts at most are used. Equal texts count once and stay on one side; where their labels clash, most decide, and
    toxic if it is even. Null and empty texts teach nothing.
    """
    seen = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = seen.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # sample_rows at most
    rows = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("_sha")).agg(F.first("text").alias("text"), (F.avg("label") >= 0.5).cast("double").alias("label"))
    path = write_table(rows.orderBy(F.xxhash64("_sha"), "_sha").limit(sample_rows).repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxicity-sample")
    rows = docs.sparkSession.read.schema("_sha string, text string, label double").parquet(path)
    first = F.pmod(F.xxhash64("_sha", F.lit(1)), F.lit(3)) < 2
    found = train_dictionaries(rows.where(first))
    if found is None:
        return None
    seen = rows.where(~first).select("label", "text").mapInArrow(_feature_rows(*found), "label double, x array<double>").toArrow()
    drop_table(docs.sparkSession, path)
    if not len(seen):
        return None
    x, y = np.array(seen.column("x").to_pylist()), seen.column("label").to_numpy()
    order = np.lexsort([*x.T, y])  # the order rows come in must not matter
    return Model(*found, *calibrate(x[order], y[order]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: one pass, no shuffle. Without a model nothing is called toxic.

    A null text is empty; it saves nothing and has the score of that. Rows that repeat have equal scores.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _feature_rows(model.ordinary, model.toxic)(batches) if model else ()
        for b in parts:
            x = np.array(b.column("x").to_pylist()).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])
        if model is None:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(len(b)))], names=["doc_id", "score"])

    scored = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
