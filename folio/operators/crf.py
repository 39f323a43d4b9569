"""Linear-chain conditional random fields: trained with L-BFGS and both penalties, predicting by Viterbi."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.shared import written

# Penalties and iterations of training.
C1, C2, ITERATIONS = 0.1, 0.1, 100
#: Tokens whose gradient one task sums.
TOKENS_A_TASK, TOKENS_IN_ONE = 4000, 50_000

Features = dict[str, str | bool]


def names(features: Features) -> list[str]:
    """Active features: ``key=value`` for text, ``key`` for true."""
    return [k if v is True else f"{k}={v}" for k, v in features.items() if v is not False and v is not None]


@dataclass
class Crf:
    labels: list[str]
    features: dict[str, int]
    state: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels

    def _scores(self, sequence: list[Features]) -> np.ndarray:
        out = np.zeros((len(sequence), len(self.labels)))
        for t, f in enumerate(sequence):
            rows = [self.features[n] for n in names(f) if n in self.features]
            if rows:
                out[t] = self.state[rows].sum(0)
        return out

    def predict(self, sequence: list[Features]) -> list[str]:
        """The likeliest labels; the first label of equally likely ones."""
        if not sequence:
            return []
        s = self._scores(sequence)
        back, now = [], s[0]
        for t in range(1, len(s)):
            way = now[:, None] + self.move
            back.append(way.argmax(0))
            now = way.max(0) + s[t]
        k = int(now.argmax())
        out = [k]
        for b in reversed(back):
            k = int(b[k])
            out.append(k)
        return [self.labels[k] for k in reversed(out)]

    def to_json(self) -> str:
        return json.dumps({"labels": self.labels, "features": list(self.features), "state": self.state.tolist(), "move": self.move.tolist()})

    @classmethod
    def from_json(cls, text: str) -> Crf:
        d = json.loads(text)
        return cls(d["labels"], {f: k for k, f in enumerate(d["features"])}, np.array(d["state"]).reshape(len(d["features"]), -1), np.array(d["move"]))


@lru_cache(maxsize=2)
def loaded(model: str) -> Crf:
    """A model from its JSON, read once a worker."""
    return Crf.from_json(model)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


Coded = list[tuple[list[list[int]], list[int]]]


def coded_loss(coded: Coded, w: np.ndarray, n: int, m: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood of sequences (feature numbers by place, labels) and its gradient, without penalties: a sum over them."""
    state, move = w[: n * m].reshape(n, m), w[n * m :].reshape(m, m)
    gs, gm, total = np.zeros_like(state), np.zeros_like(move), 0.0
    for rows, ys in coded:
        t = len(rows)
        s = np.array([state[r].sum(0) if len(r) else np.zeros(m) for r in rows])
        a, b = np.empty((t, m)), np.zeros((t, m))
        a[0] = s[0]
        for k in range(1, t):
            a[k] = _sum_exp(a[k - 1][:, None] + move, 0) + s[k]
        for k in range(t - 2, -1, -1):
            b[k] = _sum_exp(move + (s[k + 1] + b[k + 1])[None, :], 1)
        z = _sum_exp(a[-1][None, :], 1)[0]
        p = np.exp(a + b - z)
        for k, r in enumerate(rows):
            p[k, ys[k]] -= 1
            np.add.at(gs, r, p[k])
        total += z - s[range(t), ys].sum()
        for k in range(1, t):
            gm += np.exp(a[k - 1][:, None] + move + (s[k] + b[k])[None, :] - z)
            gm[ys[k - 1], ys[k]] -= 1
            total -= move[ys[k - 1], ys[k]]
    return total, np.concatenate([gs.ravel(), gm.ravel()])


def minimised(likelihood: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, c1: float = C1, c2: float = C2, iterations: int = ITERATIONS, memory: int = 6) -> np.ndarray:
    """Orthant-wise L-BFGS from zero: the absolute penalty enters by its slope on the side of zero a weight is on."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = likelihood(w)
        return f + c2 * (w @ w), g + 2 * c2 * w

    w = np.zeros(size)
    f, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        pseudo = np.where(w != 0, g + c1 * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - c1, 0))
        if np.abs(pseudo).max(initial=0) < 1e-5:
            break
        q, stack = pseudo.copy(), []
        for s, y in reversed(pairs):
            k = (s @ q) / (y @ s)
            q -= k * y
            stack.append(k)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), k in zip(pairs, reversed(stack), strict=True):
            q += s * (k - (y @ q) / (y @ s))
        step = np.where(q * pseudo > 0, -q, 0)
        side = np.where(w != 0, np.sign(w), -np.sign(pseudo))
        rate, old = (1.0 if pairs else 1 / max(1.0, np.abs(pseudo).sum())), f + c1 * np.abs(w).sum()
        for _ in range(20):
            new = w + rate * step
            new[new * side < 0] = 0
            fn, gn = loss(new)
            if fn + c1 * np.abs(new).sum() <= old + 1e-4 * (pseudo @ (new - w)):
                break
            rate /= 2
        else:
            break
        if (y := gn - g) @ (s := new - w) > 1e-10:
            pairs = [*pairs[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        done = abs(old - fn - c1 * np.abs(new).sum()) < 1e-6 * max(1.0, abs(old))
        w, f, g = new, fn, gn
        if done:
            break
    return w


def train(sequences: list[list[Features]], targets: list[list[str]], **how) -> Crf:
    """Fit on sequences that one task holds. All transitions have a weight, whether they occur or not."""
    labels = sorted({y for ys in targets for y in ys})
    number = {y: k for k, y in enumerate(labels)}
    features = {n: k for k, n in enumerate(sorted({n for s in sequences for f in s for n in names(f)}))}
    coded = [([[features[n] for n in names(f)] for f in s], [number[y] for y in ys]) for s, ys in zip(sequences, targets, strict=True) if s]
    n, m = len(features), len(labels)
    w = minimised(lambda w: coded_loss(coded, w, n, m), n * m + m * m, **how)
    return Crf(labels, features, w[: n * m].reshape(n, m), w[n * m :].reshape(m, m))


def _by_place(a, b):
    """Maps have no order, so structs with one are compared by their ordinal."""
    return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)


CODED = "f array<array<int>>, y array<int>"


def fit(rows: DataFrame, in_one_task: int = TOKENS_IN_ONE, **how) -> str:
    """Train on all of ``rows``: doc_id, ord, features (map), label; the model as JSON.

    Up to ``in_one_task`` tokens one task does it, which saves a job a round; the weights are those of more tasks, but
    for the order of sums. Beyond, sequences are coded once and written. Each loss is a job: a task sums its sequences' losses and gradients, sums of
    tasks are added up in groups, and the driver takes the step. What the driver holds is the model's weights, a number
    for each feature and label that occurs, whatever the number of sequences.
    """
    spark = rows.sparkSession
    one = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "features", "label")), _by_place).alias("s"))

    count = rows.count()
    if count <= in_one_task:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs = [doc for b in batches for doc in b.column(0).to_pylist()]
            model = train([[dict(t["features"]) for t in s] for s in docs], [[t["label"] for t in s] for s in docs], **how)
            yield pa.RecordBatch.from_pydict({"model": [model.to_json()]})

        return one.orderBy("doc_id").select("s").coalesce(1).mapInArrow(alone, "model string").first()[0]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(False, n) for doc in b.column(0).to_pylist() for t in doc for n in names(dict(t["features"]))}
            seen |= {(True, t["label"]) for doc in b.column(0).to_pylist() for t in doc}
            label, name = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.bool_()), pa.array(name, pa.string())], names=["label", "name"])

    found = one.select("s").mapInArrow(named, "label boolean, name string").distinct().collect()
    labels, known = sorted(r.name for r in found if r.label), sorted(r.name for r in found if not r.label)
    features = spark.sparkContext.broadcast({n: k for k, n in enumerate(known)})
    number = {y: k for k, y in enumerate(labels)}
    n, m = len(known), len(labels)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = features.value
        for b in batches:
            docs = b.column(0).to_pylist()
            f = pa.array([[[at[x] for x in names(dict(t["features"]))] for t in s] for s in docs], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([f, pa.array([[number[t["label"]] for t in s] for s in docs], pa.list_(pa.int32()))], names=["f", "y"])

    parts = max(1, -(-count // TOKENS_A_TASK))
    coded = written(one.select("s").repartition(parts).mapInArrow(code, CODED), "sequences").coalesce(parts)

    def likelihood(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights = spark.sparkContext.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, gradient = 0.0, np.zeros(n * m + m * m)
            for b in batches:
                own, slope = coded_loss(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), weights.value, n, m)
                total, gradient = total + own, gradient + slope
            yield pa.RecordBatch.from_pydict({"loss": [total], "gradient": pa.array([gradient.tobytes()], pa.binary())})

        sums = _summed(coded.mapInArrow(part, "loss double, gradient binary"), parts)
        weights.unpersist()
        return sums

    w = minimised(likelihood, n * m + m * m, **how)
    return Crf(labels, {f: k for k, f in enumerate(known)}, w[: n * m].reshape(n, m), w[n * m :].reshape(m, m)).to_json()


def _summed(sums: DataFrame, parts: int, at_once: int = 64) -> tuple[float, np.ndarray]:
    """Losses and gradients of tasks added up: in groups first if there are many, so the driver adds ``at_once`` at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gradient = 0.0, None
        for b in batches:
            for own, slope in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += own
                gradient = np.frombuffer(slope) if gradient is None else gradient + np.frombuffer(slope)
        if gradient is not None:
            yield pa.RecordBatch.from_pydict({"loss": [total], "gradient": pa.array([gradient.tobytes()], pa.binary())})

    got = (sums.coalesce(at_once).mapInArrow(add, "loss double, gradient binary") if parts > at_once else sums).collect()
    return sum(r.loss for r in got), np.sum([np.frombuffer(r.gradient) for r in got], axis=0)


def save(spark: SparkSession, model: str, path: str) -> None:
    """A model's JSON as a file in a store that Spark writes."""
    spark.createDataFrame([(model,)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].rstrip("\n")


def predictions(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, ord, prediction of every token: a document is a sequence, documents are independent."""
    one = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "features")), _by_place).alias("s"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batch(batches):
        crf = loaded(model)
        for b in batches:
            docs, orders, found = [], [], []
            for doc, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs += [doc] * len(s)
                orders += [t["ord"] for t in s]
                found += crf.predict([dict(t["features"]) for t in s])
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column(0).type), pa.array(orders, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "ord", "prediction"])

    return one.select("doc_id", "s").mapInArrow(batch, f"doc_id {kind}, ord long, prediction string")


# Autocut: a field's value is cut out of a longer text by labels on its characters.


def char_sequence(text: str, reach: int = 3) -> list[Features]:
    """Features of each character: itself, its word, and its neighbours."""
    words, word_at = [], []
    for i, c in enumerate(text):
        if not c.isspace() and (i == 0 or text[i - 1].isspace() or c.isalnum() != text[i - 1].isalnum()):
            words.append("")
        word_at.append(-1 if c.isspace() else len(words) - 1)
        if not c.isspace():
            words[-1] += c
    out = []
    for i, c in enumerate(text):
        f: Features = {"ch.lower": c.lower(), "ch.isupper": c.isupper(), "ch.isdigit": c.isdigit()}
        for d in [k for k in range(-reach, reach + 1) if k]:
            f[f"{d:+d}:ch"] = text[i + d].lower() if 0 <= i + d < len(text) else ""
        if word_at[i] >= 0:
            w = words[word_at[i]]
            f |= {"word.lower": w.lower(), "word.istitle": w.istitle(), "word.isdigit": w.isdigit()}
            f |= {f"{d:+d}:word": words[word_at[i] + d].lower() if 0 <= word_at[i] + d < len(words) else "" for d in (-1, 1)}
        out.append(f)
    return out


def cut(text: str, labels: str, yes: str = "x", no: str = "_") -> str:
    """From the first ``yes`` on up to the first ``no`` that is found in the rest, searched from the same offset again."""
    start = labels.find(yes)
    if start < 0:
        return ""
    end = labels[start:].find(no, start)
    return text[start:] if end < 0 else text[start : start + end]


def aligned_labels(expected: str, actual: str):
    """A column of labels of ``actual``'s characters: which of them ``expected`` matches; null where either is null."""
    from folio.operators.alignment import labels_match

    @F.arrow_udf("string")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        both = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else labels_match(a, b) for a, b in both], pa.string())

    return run(expected, actual)


def fit_autocut(inputs: list[str], targets: list[str]) -> Crf:
    from folio.operators.alignment import labels_match

    return train([char_sequence(x) for x in inputs], [list(labels_match(y, x)) for x, y in zip(inputs, targets, strict=True)])


def autocut(model: Crf, text: str) -> str:
    return cut(text, "".join(model.predict(char_sequence(text))))


def autocut_column(model: str):
    """A column function: what a trained model cuts out of each text; null stays null. A worker reads the model once."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        crf = loaded(model)
        return pa.array([None if x is None else autocut(crf, x) for x in texts.to_pylist()], pa.string())

    return run
