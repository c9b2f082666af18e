"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

The weights are trained by follow-the-regularised-leader with an elastic net, which leaves most of them at exactly zero;
the probabilities are then calibrated with one temperature on rows the training did not see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import bounded_sample

BITS = 16
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, space for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the 1- to 3-grams of a whole text; both arrays are empty where it has no letter."""
    points = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != 32).any():
        return np.empty(0, np.int64), np.empty(0)
    a = np.concatenate((np.uint32([32]), points, np.uint32([32])))
    one = a * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + a[1:] * np.uint32(2246822519) + np.uint32(1)
    three = two[:-1] * np.uint32(31) + a[2:] * np.uint32(3266489917) + np.uint32(2)
    h = np.concatenate((one, two, three))
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h >>= np.uint32(32 - BITS)
    if len(h) < 20_000:
        ids, counts = np.unique(h, return_counts=True)
        return ids.astype(np.int64), counts.astype(float)
    counts = np.bincount(h, minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids].astype(float)


def _document_frequency(batches):
    df = np.zeros(1 << BITS, np.int64)
    rows = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df[ngram_counts(text)[0]] += 1
            rows += 1
    ids = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(ids, -1), pa.int32()), pa.array(np.append(df[ids], rows), pa.int64())], names=["gram", "n"]
    )


def _counted(batches):
    for batch in batches:
        found = [ngram_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("at"),
                pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
                pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary()),
            ],
            names=["lang", "at", "ids", "counts"],
        )


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def weigh(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[ids]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weigh(ids, counts) @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, counts = ngram_counts(text)
        if not len(ids) or not self.labels:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(ids, counts) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    classes: int,
    size: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    epochs: int = 3,
    seed: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal updates, one row at a time. Returns weights (last row: bias) and their squared gradient sums."""
    z = np.zeros((size + 1, classes))
    n = np.zeros((size + 1, classes))
    order = np.random.default_rng(seed)

    def solve(ids):
        zi, ni = z[ids], n[ids]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w), ni

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, x = rows[k]
            ids, x = np.append(ids, size), np.append(x, 1.0)
            w, ni = solve(ids)
            p = softmax(x @ w)
            p[target[k]] -= 1.0
            g = x[:, None] * p
            root = np.sqrt(ni + g * g)
            z[ids] += g - (root - np.sqrt(ni)) / alpha * w
            n[ids] = ni + g * g
    return solve(np.arange(size + 1))[0], n


def best_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(target)), target], 1e-15)).mean()

    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, key: str = "doc_id", per_language: int = 800, seed: int = 11) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang``.

    Document frequencies count every row. The weights come from about ``per_language`` rows of each language, chosen by a
    hash of the key; every fifth of them only sets the temperature. No labelled row gives a model without labels, whose
    answer is always ``und``.
    """
    known = docs.where(F.col("lang").isNotNull()).select(F.col(key).alias("key"), "text", "lang")
    counted = known.select("text").mapInArrow(_document_frequency, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(1 << BITS)
    total = 0
    for gram, n in counted.collect():  # a row for each of the fixed number of hashed n-grams at most
        if gram < 0:
            total = n
        else:
            df[gram] = n
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    rows = (
        bounded_sample(known, "key", "lang", per_language, seed)
        .select("lang", F.xxhash64(F.col("key").cast("string"), F.lit(seed)).alias("at"), "text")
        .mapInArrow(_counted, "lang string, at long, ids binary, counts binary")
        .collect()
    )
    rows = sorted((r for r in rows if r["ids"]), key=lambda r: (r["at"], r["lang"], bytes(r["ids"])))
    labels = sorted({r["lang"] for r in rows})
    model = LanguageModel(labels, idf.astype(np.float32), np.zeros((1 << BITS, len(labels)), np.float32), np.zeros(len(labels)), 1.0)
    if not rows:
        return model
    seen = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32).astype(float)) for r in rows]
    target = np.array([labels.index(r["lang"]) for r in rows])
    hold = np.arange(len(rows)) % 5 == 4
    weighed = [(i, model.weigh(i, c)) for i, c in seen]
    w, _ = follow_the_leader([x for x, h in zip(weighed, hold, strict=True) if not h], target[~hold], len(labels), 1 << BITS)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    if hold.any():
        logits = np.array([model.logits(*x) for x, h in zip(seen, hold, strict=True) if h])
        model.temperature = best_temperature(logits, target[hold])
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, for every row and its whole text.

    Texts that are null or have no letter are ``und`` with score 0; repeated rows get equal answers; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
