"""Quality classifier: Naive Bayes support vectors.

Method
    A text's features are indicators of n-grams, hashed into a fixed table: single words, and runs
    of one to three token classes. A token's class is its punctuation, or a word's case, or "the
    word before once more". Indicators are scaled by the classes' log-count ratios (Wang and
    Manning, 2012), rows are brought to length 1, and a linear model is fitted to the hinge loss by
    dual coordinate descent (Hsieh et al., 2008). Margins become scores by a logistic curve that is
    fitted to out-of-fold margins.

    The fit takes at most ``train_rows`` labelled rows, those with the smallest hash of their id, so
    what comes to the driver is bounded: train_rows arrays of at most ``features`` distinct slots.
    Scoring is one pass over whole texts with the weights, a table of fixed size, sent to all.

Defined results
    * null and empty texts have no n-gram and get the score of the bias alone.
    * labels that are null, or whose id is null, are not used; an id labelled twice counts twice.
    * with no labelled rows every score is 0.5; with rows of one class, the smoothed share of 1.
    * rows with a null or a repeated id are scored like all others; an empty table gives no rows;
      other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bounded_batches, ids_and_texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
FEATURES = 1 << 20
TRAIN_ROWS = 6000
THRESHOLD = 0.3
CACHE_TOKENS = 150_000
#: Class numbers of words; punctuation has numbers from PUNCTUATION on.
LOWER, TITLE, UPPER, DIGITS, MIXED, AGAIN, PUNCTUATION = range(1, 8)


class Tokens(dict):
    """token -> hash << 16 | class."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        h = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        if not (token[0].isalnum() or token[0] == "_"):
            kind = PUNCTUATION + h % 60_000
        elif token.isdigit():
            kind = DIGITS
        elif token.islower():
            kind = LOWER
        elif token.isupper() and len(token) > 1:
            kind = UPPER
        elif token[0].isupper() and (len(token) == 1 or token[1:].islower()):
            kind = TITLE
        else:
            kind = MIXED
        out = self[token] = h << 16 | kind
        return out


def features_of(text: str | None, tokens: Tokens, size: int = FEATURES) -> np.ndarray:
    """Sorted distinct slots of the text's n-grams."""
    found = TOKEN.findall(text or "")
    if not found:
        return np.empty(0, np.int64)
    both = np.fromiter(map(tokens.__getitem__, found), np.int64, len(found))
    kind, word = both & 0xFFFF, both >> 16
    at = np.flatnonzero(kind < PUNCTUATION)
    words = word[at]
    kind = kind.copy()
    kind[at[1:][words[1:] == words[:-1]]] = AGAIN
    k = kind.astype(np.uint64)
    mixed = [words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    run = k + np.uint64(1)
    for n in range(3):
        if n:
            run = run[:-1] * np.uint64(0x100000001B3) + k[n:] + np.uint64(1)
        mixed.append((run + np.uint64(n << 60)) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique((np.concatenate(mixed) >> np.uint64(40)).astype(np.int64) % size)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        """The scaled row has length 1: its squared ratios are the second table."""
        if not len(slots):
            return self.bias
        w = self.weights[slots]
        return float(w[:, 0].sum() / max(float(np.sqrt(w[:, 1].sum())), 1e-9) + self.bias)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), smooth)
    for slots, label in zip(rows, y):
        counts[int(label), slots] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; one dual variable for each row, each kept in [0, cost]."""
    w, bias = np.zeros(size), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            slots, v = rows[i], values[i]
            g = sign[i] * (v @ w[slots] + bias) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), cost)
            step = (a - alpha[i]) * sign[i]
            if step:
                w[slots] += step * v
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = a
        if largest < 1e-3 * cost:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, by Newton steps on smoothed targets."""
    up, down = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([d @ margins + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins) @ margins + 1e-3, h @ margins], [h @ margins, h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], y: np.ndarray, size: int = FEATURES, cost: float = 1.0, epochs: int = 20, folds: int = 3) -> Model:
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros((size, 2), np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def one(pick: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in pick]
        ratio = log_ratios(own, y[pick], size)
        values = [ratio[s] / max(float(np.linalg.norm(ratio[s])), 1e-9) for s in own]
        w, bias = dual_descent(own, values, y[pick], size, cost, epochs)
        return np.stack([w * ratio, ratio**2], axis=1).astype(np.float32), bias

    margins, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for f in range(folds):
        if len(np.unique(y[fold != f])) < 2:
            continue
        w, bias = one(np.flatnonzero(fold != f))
        part = Model(w, bias, 1, 0)
        for i in np.flatnonzero(fold == f):
            margins[i] = part.margin(rows[i])
    w, bias = one(np.arange(len(y)))
    return Model(w, bias, *logistic_curve(margins, y))


def _featurer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rows = [features_of(t.as_py(), tokens, size).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["label", "slots"])

    return run


def held_out(id_col: str):
    """Rows never learnt from: crc32 of the id's decimal text is a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, size: int = FEATURES) -> Model:
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    rows = ids_and_texts(docs, id_col, text_col).join(F.broadcast(sample), "id")  # train_rows rows at most
    table = rows.select("label", "text").mapInArrow(_featurer(size), "label int, slots array<int>").toArrow()
    slots, y = [np.asarray(s, np.int64) for s in table.column("slots").to_pylist()], table.column("label").to_numpy()
    # the tasks' order is no part of the result
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(slots[i].tobytes()), len(slots[i]), int(y[i])))
    return fit([slots[i] for i in order], np.array([int(y[i] > 0) for i in order]), size)


def _scorer(model, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            m = model.value
            scores = [m.score(features_of(t.as_py(), tokens, size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), pa.array(scores, pa.float64())], [*(n for i, n in enumerate(batch.schema.names) if i != 1), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    out = ids_and_texts(docs, id_col, text_col).mapInArrow(_scorer(sent, len(model.weights)), "id long, score double")
    return out.select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    size = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            keep = [sent.value.score(features_of(t.as_py(), tokens, size)) >= threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
