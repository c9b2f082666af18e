"""Quality classifier: histogram gradient-boosted trees over statistics of the document.

Every text becomes a short vector of statistics of its bytes, words and lines. The trees are grown level by level on
binned values, then flattened into arrays in heap order, so that numpy walks all rows down a tree at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import bounded_sample, fold, sigmoid, text_bytes

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "mark": b"#$%&*@^~+=/\\<>[]{}_`",
    "pipe": b"|",
    "other": bytes(range(128, 256)),
}
_KIND_OF = np.array([[float(b in members) for members in _KINDS.values()] for b in range(256)])

FEATURES = (
    "log_bytes",
    "log_words",
    "word_length",
    *[f"{k}_share" for k in _KINDS],
    "entropy",
    "distinct_words",
    "repeated_next",
    "top_word",
    "log_lines",
    "line_length",
    "distinct_lines",
    "marked_words",
)


def statistics(text: bytes | None) -> list[float]:
    """The feature values of a whole text; a null or empty one has only zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = counts @ _KIND_OF / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    top = Counter(words).most_common(1)
    lines = text.split(b"\n")
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        (n - kinds[3] * n) / m,
        *kinds,
        float(-(p * np.log2(p)).sum()),
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        top[0][1] / m if top else 0.0,
        float(np.log(len(lines))),
        n / len(lines),
        len(set(lines)) / len(lines),
        (kinds[5] + kinds[6]) * n / m,
    ]


@dataclass
class Trees:
    """Complete binary trees in heap order: node k of tree t sends a row to 2k + 1 or, above its cut, to 2k + 2."""

    features: np.ndarray  # (trees, inner nodes)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.features.shape[1] if len(self.features) else 0
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0
) -> Trees:
    """Boost the logistic loss. ``least``: the smallest sum of second derivatives in a leaf."""
    inner, n_leaves = 2**depth - 1, 2**depth
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, n_leaves)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    every = np.arange(x.shape[1])
    grown = []
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * len(every) + every) * bins + binned
            size = width * len(every) * bins
            hist = [np.bincount(flat.ravel(), np.repeat(v, len(every)), size).reshape(width, len(every), bins) for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-6):
                j, b = divmod(int(best[k]), bins)
                if b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + l2)
        margin += value[leaf]
        grown.append((feature, cut, value))
    model.features, model.cuts, model.leaves = (np.stack(v) for v in zip(*grown, strict=True))
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", per_class: int = 3000, seed: int = 29) -> Trees:
    """Learn from about ``per_class`` labelled rows of each class (null labels are left out). The classes keep their
    true shares by a shift of the margin, so the scores are probabilities. Without rows of both classes the score is the
    share of the class seen, 0.5 without any."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(key).agg(F.max("quality").alias("_y"))
    shares = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    rows = docs.select(key, text_bytes().alias("_text")).join(F.broadcast(bounded_sample(marks, key, "_y", per_class, seed)), key)

    def run(batches):
        for batch in batches:
            found = [statistics(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("_y").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["at", "y", "x"])

    at = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("at")
    found = rows.select(at, "_y", "_text").mapInArrow(run, "at long, y int, x array<double>").collect()
    found = sorted(found, key=lambda r: (r["at"], r["y"], r["x"]))
    y = np.array([r["y"] for r in found], float)
    model = grow(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), y)
    if 0 < y.sum() < len(y):
        model.base += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _scored(shared, texts: list[bytes | None]) -> np.ndarray:
    return shared.value.scores(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES)))


def score(docs: DataFrame, model: Trees, keep: list[str], cut: float = 0.3) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (score of ``cut`` or more), for every row and whole text.

    Null and empty texts are scored by their all-zero statistics; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            s = _scored(shared, batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*keep, "score", "predicted"]
            )

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Trees, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``cut`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(_scored(shared, texts.tolist()))

    return docs.where(quality(text_bytes()) >= cut)


def training_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.where(fold(key, 5) != 0)
