"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL.

Features are the single words and word pairs of a text, single shapes and runs of two and
three shapes (a shape is the kind of characters in a word, so it speaks for words never seen
before), and words that repeat the one before. They are hashed into ``2**BITS`` weights. A text's
vector holds their counts over the square root of the number of words; its score is the logistic
function of the sparse dot product with the weights.

The model is fitted in one task on at most ``max_rows`` labelled rows, those with the smallest
hash of ``doc_id``. Its weights are a fixed 1 MiB, the only thing that is broadcast. Scoring
reads every whole text once and shuffles nothing.

Defined results: a missing text is empty; an empty text gets the score of the intercept alone;
labelled rows without a text, a label or a document do not take part; without usable labelled
rows every score is 0.5; equal rows are scored alike; an empty
table gives no rows; further columns are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .texts import CACHE_WORDS, filter_texts, map_texts, mix

BITS = 18
MAX_TRAINING_ROWS = 5_000
THRESHOLD = 0.3
_SIZE = 1 << BITS
_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
           (re.compile(rb"[0-9]+"), b"9")]
_RUN = re.compile(rb"([^Aa9])\1+")
_MODEL = pa.schema([("model", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def fold(modulus: int, id_column: str = "doc_id") -> Column:
    """The remainder that decides whether a labelled row is held out."""
    return F.crc32(F.col(id_column).cast("string")) % modulus


def shape(word: bytes) -> bytes:
    """Kinds of characters of a word: ``Word,`` is ``Aa,`` and ``of%%%`` is ``a%``."""
    for pattern, kind in _SHAPES:
        word = pattern.sub(kind, word)
    return _RUN.sub(rb"\1", word)


class _Words(dict):
    """Hash of a word and hash of its shape, as 16 bytes."""

    def __missing__(self, word: bytes) -> bytes:
        value = (xxhash.xxh64_digest(word) + xxhash.xxh64_digest(shape(word), 1))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def _pairs(values: np.ndarray, seed: int, width: int = 2) -> np.ndarray:
    """Hashes of runs of ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out = np.full(n, seed, np.uint64)
    for at in range(width):
        out = mix(out + values[at:at + n])
    return out


class Features:
    """Feature numbers of a text; a number occurs as often as its feature does."""

    def __init__(self):
        self._words = _Words()

    def of(self, text: bytes) -> tuple[np.ndarray, float]:
        """(feature numbers, value of one occurrence)."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), 0.0
        both = np.frombuffer(b"".join(map(self._words.__getitem__, words)), np.uint64)
        word, kind = both[::2], both[1::2]
        same = np.full(int((word[1:] == word[:-1]).sum()), 0x5EED, np.uint64)
        hashes = np.concatenate((word, _pairs(word, 1), kind, _pairs(kind, 2),
                                 _pairs(kind, 3, 3), same))
        return (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64), 1 / math.sqrt(len(words))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader updates, one row after the other.

    The last of the ``size + 1`` places is free for an intercept; ``offset`` is a fixed one.
    """

    size: int = _SIZE
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.z = np.zeros(self.size + 1)
        self.n = np.zeros(self.size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, step)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = (logistic(float(w @ values) + self.offset) - label) * values
        square = slope * slope
        n = self.n[at]
        self.z[at] += slope - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def fit_rows(texts: list[bytes], labels: list[int], rounds: int = 2) -> bytes:
    """Weights after ``rounds`` passes over the rows in a fixed mixed order."""
    features, model = Features(), Ftrl()
    rows = []
    for text, label in zip(texts, labels):
        numbers, value = features.of(text)
        at, counts = np.unique(numbers, return_counts=True)
        rows.append((np.append(at, _SIZE).astype(np.int32),
                     np.append(counts * value, 1.0).astype(np.float32), label))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for at in order.permutation(len(rows)):
            model.learn(*rows[at])
    return model.weights().astype(np.float32).tobytes()


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column,
          fit_texts=fit_rows, max_rows: int = MAX_TRAINING_ROWS) -> bytes | None:
    """Fit on at most ``max_rows`` labelled rows for which ``usable`` holds; None without any.

    ``fit_texts(texts, labels)`` returns the model as bytes.
    """
    mixed = F.xxhash64("doc_id", F.lit(11))
    chosen = (labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
              .orderBy(mixed, "doc_id").limit(max_rows))
    # At most max_rows pairs of numbers.
    rows = (docs.where(F.col("text").isNotNull()).select("doc_id", "text")
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label")
            .agg(F.min("text").alias("text")))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        texts = table.column("text").cast(pa.binary()).to_pylist()
        return pa.table([[fit_texts(texts, table.column("_label").to_pylist())]], schema=_MODEL)

    # A bounded number of rows, so one group may hold them all.
    found = (rows.withColumn("_all", F.lit(0)).groupBy("_all")
             .applyInArrow(fit, from_arrow_schema(_MODEL)).collect())
    return bytes(found[0]["model"]) if found else None


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.features = weights, Features()

    def score(self, text: bytes) -> float:
        at, value = self.features.of(text)
        return logistic(float(self.weights[at].sum(dtype=np.float64)) * value
                         + float(self.weights[-1]))


def score_texts(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"),
                    "score": [scorer.score(text) for text in batch.column("text").to_pylist()]}

        return step

    return map_texts(docs, work, _SCORES)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with at least the threshold's score, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.score(text) >= threshold for text in texts]

    return filter_texts(docs, work)


def train_quality(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    found = train(docs, labels, "quality", fold(5) != 0)
    return np.frombuffer(found or bytes(4 * (_SIZE + 1)), np.float32)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality; one labelled row in five is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, weights).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
