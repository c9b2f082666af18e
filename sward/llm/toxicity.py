"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed to rows of an embedding table; filters of several widths slide over them; the largest answer of each
filter over the whole text goes into a logistic output. Gradients reach only the places that gave a maximum. A threshold
is set for each language on held-back rows; the language of a text is guessed from its words, never taken from a column.

Every labelled row is used, with its whole text. Spark counts words and adds up gradients over the rows of a stripe; the
driver holds the model only, whose size does not depend on the number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import Memo, chunks, fold, sigmoid, text_bytes, word_list
from sward.session import materialize, scratch

BUCKETS = 1 << 20
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
LANG_BUCKETS = 1 << 16
#: Steps of a pass over the training rows, and passes.
STRIPES, EPOCHS = 8, 4
#: Gradients are added up as whole multiples of 1 / SCALE, so sums do not depend on the order of rows.
SCALE = float(1 << 30)
#: Cuts that a threshold is chosen from in one unit of log-odds.
CUTS = 512
#: Words that the filters slide over at a time.
STRETCH = 1 << 17


def bucket(word: bytes) -> int:
    """Row of a word; row 0 is the padding."""
    return 1 + zlib.crc32(word) % (BUCKETS - 1)


def word_ids(text: bytes | None, memo: Memo) -> np.ndarray:
    words = word_list(text)
    return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All word ids in one row with padding after each text, and the starts. Filters that begin in a text or right after it
    see no other text."""
    gap = np.zeros(PAD + 1, np.int32)
    starts = np.cumsum([0] + [len(t) + PAD + 1 for t in texts])[:-1]
    return np.concatenate([x for t in texts for x in (t, gap)]), starts


def stretches(texts: list[np.ndarray], size: int = STRETCH) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray]]:
    """Numbers of consecutive texts, their words and how many filters begin in them, about ``size`` at a time. A longer
    text comes in several stretches, each in a group of its own, with the next words that filters reach."""
    at, words, begin = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, len(t) + 1, size):
            n = min(size, len(t) + 1 - a)
            if at and sum(begin) + n > size:
                yield at, words, np.array(begin)
                at, words, begin = [], [], []
            at.append(i)
            words.append(t[a : a + n + PAD])
            begin.append(n)
    if at:
        yield at, words, np.array(begin)


@dataclass
class ToxicityModel:
    embeddings: np.ndarray
    kernels: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    prior: float = 0.5
    languages: list[str] = field(default_factory=list)
    language_weights: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, ids: np.ndarray) -> list[np.ndarray]:
        """By width: the answers of the filters starting at each position."""
        x = self.embeddings[ids]
        found = []
        for k, width in zip(self.kernels, WIDTHS, strict=True):
            r = x @ k[0]
            for j in range(1, width):
                r[:-j] += x[j:] @ k[j]
            found.append(r)
        return found

    def __getstate__(self):
        known = np.flatnonzero(self.embeddings.any(axis=1))
        return self.__dict__ | {"embeddings": (known, self.embeddings[known])}

    def __setstate__(self, state):
        known, rows = state["embeddings"]
        self.__dict__.update(state)
        self.embeddings = np.zeros((BUCKETS, DIM), np.float32)
        self.embeddings[known] = rows

    def peaks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest answer of each filter in each text, the words it begins at, and the weight of each language."""
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        words = np.zeros((*best.shape, PAD + 1), np.int32)
        spoken = np.zeros((len(texts), len(self.languages)))
        for at, own, begin in stretches(texts):
            ids, starts = laid_out(own)
            found = np.ascontiguousarray(np.concatenate(self.responses(ids), axis=1).T)
            place = np.array([a + found[:, a : a + n].argmax(axis=1) for a, n in zip(starts, begin, strict=True)])
            value = found[np.arange(len(found)), place]
            better = value > best[at]
            best[at] = np.where(better, value, best[at])
            words[at] = np.where(better[..., None], ids[place[..., None] + np.arange(PAD + 1)], words[at])
            if self.languages:
                edges = np.stack([starts, starts + begin], axis=1).ravel()
                spoken[at] += np.add.reduceat(self.language_weights[ids & (LANG_BUCKETS - 1)], edges)[::2]
        return best, words, spoken

    def raw(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated probability and guessed language of each text."""
        if not texts:
            return np.empty(0), np.empty(0, int)
        best, _, spoken = self.peaks(texts)
        score = sigmoid(np.maximum(best + np.concatenate(self.shifts), 0) @ self.out + self.bias)
        return score, spoken.argmax(axis=1) if self.languages else np.full(len(texts), -1)

    def gradient(self, texts: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, sums in units of 1 / SCALE): the gradient of the weighted logistic loss by row of ``embeddings`` and,
        below zero, of :meth:`dense`."""
        best, words, _ = self.peaks(texts)
        live = best + np.concatenate(self.shifts)
        hidden = np.maximum(live, 0)
        slope = (sigmoid(hidden @ self.out + self.bias) - target) * weight
        back = slope[:, None] * self.out * (live > 0)
        dense, slots, pulls = [], [], []
        for k, width in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(width):
                dense.append(np.einsum("nfd,nf->ndf", self.embeddings[words[:, own, j]], back[:, own]).reshape(len(texts), -1))
                slots.append(words[:, own, j].ravel())
                pulls.append((back[:, own, None] * self.kernels[k][j].T).reshape(-1, DIM))
        dense = np.rint(np.concatenate([*dense, back, hidden * slope[:, None], slope[:, None]], axis=1) * SCALE).astype(np.int64).sum(axis=0)
        slots, pulls = np.concatenate(slots), np.concatenate(pulls)
        some = (slots > 0) & pulls.any(axis=1)
        dense = np.append(dense, np.zeros(-len(dense) % DIM, np.int64)).reshape(-1, DIM)
        return added(
            np.concatenate([-1 - np.arange(len(dense)), slots[some]]), np.concatenate([dense, np.rint(pulls[some] * SCALE).astype(np.int64)])
        )

    def dense(self) -> np.ndarray:
        """All numbers outside ``embeddings``, in the order of :meth:`gradient`."""
        return np.concatenate([*[k.ravel() for k in self.kernels], *self.shifts, self.out, [self.bias]])

    def set_dense(self, numbers: np.ndarray) -> None:
        parts = np.split(numbers.astype(np.float32), np.cumsum([*[k.size for k in self.kernels], *[len(x) for x in self.shifts], len(self.out)]))
        n = len(WIDTHS)
        self.kernels = [p.reshape(w, DIM, FILTERS) for p, w in zip(parts[:n], WIDTHS, strict=True)]
        self.shifts, self.out, self.bias = parts[n : 2 * n], parts[2 * n], float(parts[-1][0])

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities bent so that the threshold of the guessed language lies at 0.5."""
        p, lang = self.raw(texts)
        t = np.array([self.thresholds.get(self.languages[k], self.threshold) if k >= 0 else self.threshold for k in lang])
        if not len(p):
            return p
        return np.clip(np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), 0.0, 1.0)


def added(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order and the sums of their rows."""
    if not len(slots):
        return slots, values
    order = np.argsort(slots, kind="stable")
    slots, values = slots[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    return slots[first], np.add.reduceat(values, first, axis=0)


def first_embeddings(ids: np.ndarray, n: np.ndarray, toxic: np.ndarray, share: float, rng, prior: float = 5.0, least: int = 3) -> np.ndarray:
    """Small random vectors, moved along one direction by how much more often than average a word's texts are labelled 1.
    Words in fewer than ``least`` texts are not moved; words of no training text say nothing."""
    lift = np.where(n >= least, np.log((toxic + prior * share) / (n + prior) / share), 0.0)
    small = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    way = rng.normal(0, 1, DIM)
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[ids] = small[ids] + (lift[:, None] * way / np.sqrt(way @ way)).astype(np.float32)
    out[0] = 0
    return out


def untrained(embeddings: np.ndarray, rng) -> ToxicityModel:
    return ToxicityModel(
        embeddings,
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )


def flat(share: float) -> ToxicityModel:
    """A model that answers the share of the class that it saw."""
    zero = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return ToxicityModel(np.zeros((BUCKETS, DIM), np.float32), zero, [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS), np.float32), bias)


def best_threshold(score: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with the best F1, half-way (in log-odds) between the scores around it; 0.5 if a class is missing.
    ``toxic`` and ``clean``: rows of either class with each score."""
    if not (toxic.sum() and clean.sum()):
        return 0.5
    order = np.argsort(score, kind="stable")
    s, true, false = score[order], np.cumsum(toxic[order][::-1])[::-1], np.cumsum(clean[order][::-1])[::-1]
    f1 = 2 * true / (true + false + toxic.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    odds = np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))
    return float(np.clip(sigmoid((odds[k] + odds[max(k - 1, 0)]) / 2), 0.02, 0.98))


HELD = -1


def labelled_words(docs: DataFrame, labels: DataFrame, key: str, seed: int) -> DataFrame:
    """(y, lang, ids, part) of every labelled row, stored by ``part``: hashed words of the whole text, and the stripe of the
    row, ``HELD`` for a fifth of all rows, by key and text.

    Labels grow with the texts, so both are joined by key at any size and never sent whole to every executor."""
    spark = docs.sparkSession
    marks = materialize(labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("_y")), "toxic_marks")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(key, text_bytes().alias("_text"), lang.alias("_lang")).join(marks.hint("merge"), key)
    at = F.pmod(F.xxhash64(F.col(key).cast("string"), "_text", F.lit(seed)), F.lit(5 * STRIPES))
    part = F.when(at < 4 * STRIPES, at % STRIPES).otherwise(HELD).cast("int").alias("part")

    def run(batches):
        memo = Memo(bucket)
        for batch in batches:
            ids = [word_ids(t, memo).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_y", "_lang")], pa.array(ids, pa.binary()), batch.column("part")], names=["y", "lang", "ids", "part"])

    schema = "y int, lang string, ids binary, part int"
    path = scratch(spark, "toxic_words")
    rows.select("_y", "_lang", "_text", part).mapInArrow(run, schema).write.partitionBy("part").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _texts(batch) -> list[np.ndarray]:
    return [np.frombuffer(t, np.int32) for t in batch.column("ids").to_pylist()]


def _counted(batches):
    """Training texts with each word, of any label and of label 1 (``lang`` null), and words of all rows by language."""

    def table(lang, slots, n, toxic):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), *[pa.array(x.astype(np.int64)) for x in (slots, n, toxic)]], names=["lang", "slot", "n", "toxic"])

    def spoken():
        for lang, n in by_lang.items():
            slots = np.flatnonzero(n)
            yield table(lang, slots, n[slots], np.zeros(len(slots)))

    n, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    by_lang: dict[str, np.ndarray] = {}
    for batch in batches:
        for t, y, lang, part in zip(_texts(batch), *[batch.column(c).to_pylist() for c in ("y", "lang", "part")], strict=True):
            if part != HELD:
                own = np.unique(t)
                n[own] += 1
                toxic[own] += y
            if lang is not None:
                if lang not in by_lang and len(by_lang) >= 64:
                    yield from spoken()
                    by_lang.clear()
                slots, times = np.unique(t & (LANG_BUCKETS - 1), return_counts=True)
                by_lang.setdefault(lang, np.zeros(LANG_BUCKETS, np.int64))[slots] += times
    yield from spoken()
    slots = np.flatnonzero(n)
    yield table(None, slots, n[slots], toxic[slots])


def _pulled(shared):
    def run(batches):
        model, weight = shared.value
        slots, sums, size = [], [], 0
        for batch in batches:
            texts, y = _texts(batch), batch.column("y").to_numpy()
            for a, b in chunks(batch.column("ids").to_pylist(), 1 << 19):
                s, v = model.gradient(texts[a:b], y[a:b], weight[y[a:b]])
                slots.append(s)
                sums.append(v)
                size += len(s)
                if size > 1 << 18:
                    s, v = added(np.concatenate(slots), np.concatenate(sums))
                    slots, sums, size = [s], [v], len(s) // 2
        if slots:
            s, v = added(np.concatenate(slots), np.concatenate(sums))
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), *[pa.array(np.ascontiguousarray(v[:, i])) for i in range(DIM)]], names=["slot", *[f"g{i}" for i in range(DIM)]])

    return run


def fit(rows: DataFrame, sizes: dict[tuple[int, int], int], ids: np.ndarray, n: np.ndarray, toxic: np.ndarray, rate: float = 0.2, seed: int = 3) -> ToxicityModel:
    """Train the network by adaptive steps, each from the gradient over all rows of a stripe. Each class has the same total
    weight. ``sizes``: rows by stripe and label."""
    total = np.array([sum(c for (part, label), c in sizes.items() if part != HELD and label == y) for y in (0, 1)])
    rng = np.random.default_rng(seed)
    model = untrained(first_embeddings(ids, n, toxic, total[1] / total.sum(), rng), rng)
    weight = total.sum() / (2 * total)
    squares, gathered = np.zeros(BUCKETS, np.float32), np.full(len(model.dense()), 1e-8)
    sc = rows.sparkSession.sparkContext
    names = [f"g{i}" for i in range(DIM)]
    for step in range(EPOCHS * STRIPES):
        part = step % STRIPES
        size = sum(sizes.get((part, y), 0) for y in (0, 1))
        if not size:
            continue
        shared = sc.broadcast((model, weight))
        pulled = rows.where(F.col("part") == part).select("y", "ids").mapInArrow(_pulled(shared), ", ".join(f"{c} long" for c in ("slot", *names)))
        sums = pulled.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("slot")
        shared.destroy()
        slots = sums.column("slot").to_numpy()
        pull = np.stack([sums.column(c).to_numpy() for c in names], axis=1) / SCALE / size
        inner = slots < 0
        g = pull[inner][::-1].ravel()[: len(gathered)]
        gathered += g * g
        model.set_dense(model.dense() - rate * g / np.sqrt(gathered))
        used, pull = slots[~inner], pull[~inner].astype(np.float32)
        squares[used] += (pull * pull).mean(axis=1)
        model.embeddings[used] -= rate * pull / np.sqrt(squares[used] + 1e-12)[:, None]
    return model


def _language_weights(lang: np.ndarray, slots: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, which = np.unique(lang, return_inverse=True)
    counts = np.full((LANG_BUCKETS, len(names)), 0.1)
    np.add.at(counts, (slots, which), n)
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    logs -= logs.mean(axis=1, keepdims=True)
    logs[0] = 0  # the padding
    return list(names), logs


def set_thresholds(model: ToxicityModel, held: DataFrame) -> None:
    """Thresholds with the best F1 over all rows of ``held``, in all and by guessed language, among ``CUTS`` to one unit of
    log-odds; only the rows of each cut are counted on the driver."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = _texts(batch)
            for a, b in chunks(batch.column("ids").to_pylist()):
                p, lang = own.raw(texts[a:b])
                p = np.clip(p, 1e-6, 1 - 1e-6)
                cut = np.rint(np.log(p / (1 - p)) * CUTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(cut), batch.column("y")[a:b]], names=["lang", "cut", "y"])

    found = held.select("y", "ids").mapInArrow(run, "lang long, cut long, y int").groupBy("lang", "cut").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    lang, cut, toxic, clean = (c.to_numpy().astype(np.int64) for c in found.toArrow().select(["lang", "cut", "toxic", "clean"]).columns)
    shared.destroy()
    cuts, where = np.unique(cut, return_inverse=True)
    model.threshold = best_threshold(sigmoid(cuts / CUTS), *[np.bincount(where, x, len(cuts)) for x in (toxic, clean)])
    for k, name in enumerate(model.languages):
        own = lang == k
        if min(toxic[own].sum(), clean[own].sum()) >= 10:
            model.thresholds[name] = best_threshold(sigmoid(cut[own] / CUTS), toxic[own], clean[own])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: int = 23) -> ToxicityModel:
    """Learn from all labelled rows among ``labels`` (null labels are left out) and the whole texts in ``docs``.

    The network learns from four fifths of the rows, the thresholds by language are set on the last fifth; the languages are
    learned from all. Without rows of both classes the model answers the share of the class that it saw.
    """
    rows = labelled_words(docs, labels, key, seed)
    sizes = {(r["part"], r["y"]): r["count"] for r in rows.groupBy("part", "y").count().collect()}
    if len({y for part, y in sizes if part != HELD}) < 2:
        return flat(sum(c for (_, y), c in sizes.items() if y) / max(1, sum(sizes.values())))
    counted = rows.mapInArrow(_counted, "lang string, slot long, n long, toxic long").groupBy("lang", "slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counted = counted.toArrow().sort_by([("lang", "ascending"), ("slot", "ascending")])
    words = counted.filter(pa.compute.is_null(counted["lang"]))
    model = fit(rows, sizes, *[words.column(c).to_numpy() for c in ("slot", "n", "toxic")])
    spoken = counted.filter(pa.compute.is_valid(counted["lang"]))
    lang = np.array(spoken.column("lang").to_pylist(), object)
    if len(lang):
        model.languages, model.language_weights = _language_weights(lang, *[spoken.column(c).to_numpy() for c in ("slot", "n")])
    set_thresholds(model, rows.where(F.col("part") == HELD))
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (score of 0.5 or more), for every row and whole text.

    Null and empty texts have no words and get the score of the bias alone; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        own, memo = shared.value, Memo(bucket)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            parts = [own.scores([word_ids(t, memo) for t in texts[a:b]]) for a, b in chunks(texts)]
            s = np.concatenate(parts).astype(float) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(run, schema)


def training_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.where(fold(key, 5) != 0)
