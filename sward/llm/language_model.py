"""Language-model scoring by context-tree weighting over bytes.

The modelled text is the words (A-Z lower-cased) with one space after each and one end mark. A byte is eight binary
decisions; each decision has a node in the tree of every context depth. A node holds how often each bit came there; its
Krichevsky-Trofimov estimate is mixed with that of its longer contexts by the weights of context-tree weighting, over all
depths from 0 to 5. Counts come from all training texts; then the tree is fixed and gives a code length for each byte.

The tree is never whole in one place: it is cut below the contexts of two bytes, and each of these subtrees is weighed in
a group of its own, upwards, then, once the few nodes above are weighed, downwards. What comes out is a table of the log
probability of every (context, byte) that occurs, which grows with the corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import chunks, space_words, text_bytes
from sward.session import materialize

DEPTH = 5
END = 10  # the byte of the end mark; no word has it
#: Most frequent words whose counts every task holds; all others are joined by key.
FREQUENT = 1 << 18
#: Most frequent (context, byte) pairs whose log probability every task holds; all others are joined by key.
GRAMS = 1 << 21
#: Depth at which the tree is cut into subtrees.
CUT = 2
#: Contexts of a subtree that are weighed at once, and rows that a task hands on at once.
SLICE, HANDED = 2048, 1 << 17
#: Different keys that a task holds while it counts.
GATHERED = 1 << 20


def symbols(text: bytes | None) -> np.ndarray:
    """The modelled bytes of a text; a null or blank one has only the end mark."""
    words = space_words(text)
    return np.frombuffer(b" ".join(words) + (b" \n" if words else b"\n"), np.uint8)


def laid_out(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bytes of several texts in one row, the bytes 1 to ``DEPTH`` places before each, and the starts. Before a text there
    are only end marks."""
    parts = [symbols(t) for t in texts]
    data = np.concatenate(parts)
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
    before = []
    for d in range(1, DEPTH + 1):
        own = np.concatenate((np.full(d, END, np.uint8), data))[: len(data)]
        for j in range(d):
            at = starts + j
            own[at[at < len(data)]] = END  # the rest of a shorter text sees its end mark there anyway
        before.append(own)
    return data, before, starts


def gram_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte at each place as one number, the nearest byte of the context in the highest place; and the starts."""
    data, before, starts = laid_out(texts)
    key = np.zeros(len(data), np.int64)
    for b in [*before, data]:
        key = key << 8 | b
    return key, starts


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series from 8 up."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def node_counts(by_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 255 decisions of a byte (in heap order from 1, place 0 unused) from counts of 256 bytes."""
    sums = np.zeros((*by_byte.shape[:-1], 512))
    sums[..., 256:] = by_byte
    for k in (128, 64, 32, 16, 8, 4, 2, 1):
        sums[..., k : 2 * k] = sums[..., 2 * k : 4 * k : 2] + sums[..., 2 * k + 1 : 4 * k : 2]
    return sums[..., 0:512:2][..., :256], sums[..., 1:512:2][..., :256]


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.zeros(zeros.shape)
    seen = zeros + ones > 0
    a, b = zeros[seen], ones[seen]
    out[seen] = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)
    return out


def _by_rows(fn, *arrays, size: int = 4096):
    """``fn`` over slices of the rows, to bound the memory of what it makes on the way."""
    out = [fn(*[a[i : i + size] for a in arrays]) for i in range(0, len(arrays[0]), size)]
    return np.concatenate(out) if out else np.zeros((0, 256))


def own_log(counts: np.ndarray) -> np.ndarray:
    """log of the KT probabilities of all decisions of contexts with these counts of bytes."""
    return _by_rows(lambda c: kt_log(*node_counts(c)), counts)


def own_estimate(counts: np.ndarray) -> np.ndarray:
    """KT estimates of a 1 at all decisions; NaN where a context never came to one."""

    def estimate(c):
        z, o = node_counts(c)
        return np.where(z + o > 0, (o + 0.5) / (z + o + 1), np.nan)

    return _by_rows(estimate, counts)


def weighed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, the mean of the own one and the product of the children's, and the own one's share."""
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def descend(kt, share, mixed_above, spent, left):
    """One step down: the estimates mixed over all depths so far, and what the depths below still share."""
    mixed = np.where(np.isnan(kt), mixed_above, spent + left * kt)
    gone = left * share
    return mixed, spent + gone * np.where(np.isnan(kt), mixed_above, kt), left - gone


def _levels(keys: np.ndarray, n: np.ndarray, top: int):
    """For depths from ``top``: the place of each context's next shorter one on the level above, and counts of 256 bytes."""
    levels, above = [], None
    for d in range(top, DEPTH + 1):
        names, at = np.unique(keys >> 8 * (DEPTH - d + 1), return_inverse=True)
        counts = np.bincount(at * 256 + (keys & 255), n, len(names) * 256).reshape(-1, 256)
        levels.append((np.zeros(len(names), np.int64) if above is None else np.searchsorted(above, names >> 8), counts))
        above = names
    return levels, at


def _upwards(levels) -> tuple[np.ndarray, list[np.ndarray]]:
    """The log weighted probabilities of the highest level, and the shares of all levels; the deepest has no children."""
    lower, shares = None, []
    for d in range(len(levels) - 1, -1, -1):
        own = own_log(levels[d][1])
        if lower is None:
            both, share = own, np.ones(own.shape)
        else:
            below = np.zeros_like(own)
            np.add.at(below, levels[d + 1][0], lower)
            both, share = weighed(own, below)
        shares.insert(0, share)
        lower = both
    return lower, shares


def _slices(keys: np.ndarray):
    """Ranges of sorted keys that end where a context of ``CUT + 1`` bytes does, with ``SLICE`` of the deepest or so."""
    deepest = np.cumsum(np.concatenate(([0], (keys[1:] >> 8) != (keys[:-1] >> 8))))
    ends = np.flatnonzero(np.diff(keys >> 8 * (DEPTH - CUT))) + 1
    start = 0
    for end in [*ends.tolist(), len(keys)]:
        if end == len(keys) or deepest[end - 1] - deepest[start] >= SLICE:
            yield start, end
            start = end


def subtree_weight(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of bytes after one context of ``CUT`` bytes, and the log of the product of its children's weighted
    probabilities; ``keys`` are sorted."""
    below = np.zeros((1, 256))
    for a, b in _slices(keys):
        below += _upwards(_levels(keys[a:b], n[a:b], CUT + 1)[0])[0].sum(axis=0)
    return np.bincount(keys & 255, n, 256).reshape(1, 256), below


def subtree_logs(keys: np.ndarray, n: np.ndarray, mixed_above, spent, left) -> np.ndarray:
    """log10 of the probability of the byte of every key after its context, given what the node above hands down."""
    counts, below = subtree_weight(keys, n)
    handed = descend(own_estimate(counts), weighed(own_log(counts), below)[1], mixed_above, spent, left)
    out = np.empty(len(keys))
    for a, b in _slices(keys):
        levels, at = _levels(keys[a:b], n[a:b], CUT + 1)
        _, shares = _upwards(levels)
        passed = handed
        for (above, c), share in zip(levels, shares, strict=True):
            passed = descend(own_estimate(c), share, *(x[above] for x in passed))
        logs = _by_rows(lambda p: _byte_logs(np.clip(p, 1e-12, 1 - 1e-12)), passed[0])
        out[a:b] = logs[at, keys[a:b] & 255]
    return out


def _arrays(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.float64).tobytes()


def _up(table: pa.Table) -> pa.Table:
    keys, n = (table.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    counts, below = subtree_weight(keys, n)
    both = weighed(own_log(counts), below)[0]
    return pa.table({"one": pa.array([int(keys[0] >> 8 * DEPTH)], pa.int64()), "counts": [_arrays(counts)], "both": [_arrays(both)]})


def _first_level(table: pa.Table) -> pa.Table:
    counts, below = (sum(np.frombuffer(x) for x in table.column(c).to_pylist()).reshape(1, 256) for c in ("counts", "both"))
    own = own_log(counts)
    both, share = weighed(own, below)
    return pa.table({"one": table.column("one")[:1], "counts": [_arrays(counts)], "both": [_arrays(both)], "share": [_arrays(share)]})


def _handed_down(rows) -> dict[int, tuple[np.ndarray, ...]]:
    """What each context of one byte hands to its subtrees, from the at most 256 of them."""
    counts, below = np.zeros((1, 256)), np.zeros((1, 256))
    for r in rows:
        counts, below = counts + np.frombuffer(r["counts"]), below + np.frombuffer(r["both"])
    even = np.full((1, 256), 0.5)
    root = descend(own_estimate(counts), weighed(own_log(counts), below)[1], even, np.zeros((1, 256)), np.ones((1, 256)))
    return {r["one"]: descend(own_estimate(np.frombuffer(r["counts"]).reshape(1, 256)), np.frombuffer(r["share"]).reshape(1, 256), *root) for r in rows}


def context_tree(grams: DataFrame) -> DataFrame:
    """(gram, m, log) from (gram, n, m): the log10 of the probability of every byte after its context; n are the counts
    to learn from, 0 for a pair that is only asked for."""
    cut = F.shiftright("gram", 8 * (DEPTH - CUT + 1)).alias("cut")
    grouped = grams.select(cut, "gram", "n", "m").groupBy("cut")
    firsts = grouped.applyInArrow(_up, "one long, counts binary, both binary").groupBy("one")
    rows = firsts.applyInArrow(_first_level, "one long, counts binary, both binary, share binary").collect()  # 256 at most
    held = grams.sparkSession.sparkContext.broadcast(_handed_down(rows))

    def down(table: pa.Table) -> pa.Table:
        keys, n, m = (table.column(c).to_numpy() for c in ("gram", "n", "m"))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        return pa.table({"gram": keys, "m": m[order], "log": subtree_logs(keys, n, *held.value[int(keys[0] >> 8 * DEPTH)])})

    return grouped.applyInArrow(down, "gram long, m long, log double")


def _byte_logs(p: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of 256 bytes from those of a 1 at the 255 decisions."""
    logs = np.zeros((len(p), 512))
    one, zero = np.log10(p), np.log10(1 - p)
    for k in (1, 2, 4, 8, 16, 32, 64, 128):
        logs[:, 2 * k : 4 * k : 2] = logs[:, k : 2 * k] + zero[:, k : 2 * k]
        logs[:, 2 * k + 1 : 4 * k : 2] = logs[:, k : 2 * k] + one[:, k : 2 * k]
    return logs[:, 256:]


def _gather(batches):
    """Counts of words in the texts to learn from, and of (context, byte) in all, each as 2 x gram + (to learn from or
    not), over the texts of a task; handed on whenever many have come together."""

    def handed(words, ids, n):
        for a in range(0, len(words), HANDED):
            part = list(words.items())[a : a + HANDED]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([c for _, c in part], pa.int64())], names=["word", "gram", "n"])
        for a in range(0, len(ids), HANDED):
            part = ids[a : a + HANDED]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[a : a + HANDED])], names=["word", "gram", "n"])

    def summed(parts):
        ids, at = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
        return ids, np.bincount(at, np.concatenate([n for _, n in parts]), len(ids)).astype(np.int64)

    words: Counter = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        texts, learn = (batch.column(c).to_pylist() for c in ("_text", "_learn"))
        for a, b in chunks(texts):
            for t, x in zip(texts[a:b], learn[a:b], strict=True):
                if x:
                    words.update(space_words(t))
                    words[b"\n"] += 1
            keys, starts = gram_keys(texts[a:b])
            marks = np.repeat(np.array(learn[a:b], np.int64), np.diff([*starts, len(keys)]))
            parts.append(np.unique(keys << 1 | marks, return_counts=True))
            waiting += len(parts[-1][0])
            while len(parts) > 1 and (len(parts[-2][0]) <= 2 * len(parts[-1][0]) or waiting > GATHERED):
                parts[-2:] = [summed(parts[-2:])]  # two of like size, so that what is held grows with the distinct keys
                waiting = sum(len(i) for i, _ in parts)
            if len(words) > 250_000 or waiting > GATHERED:
                for ids, n in parts:
                    yield from handed(words, ids, n)
                    words = Counter()
                parts, waiting = [], 0
    for ids, n in parts or [(np.empty(0, np.int64), np.empty(0, np.int64))]:
        yield from handed(words, ids, n)
        words = Counter()


@dataclass
class LanguageModel:
    grams: DataFrame  # (gram, m, log) of all (context, byte) of the texts
    counts: DataFrame  # (word, n) of all training tokens; the end is the word of one line feed
    tokens: int
    distinct: int


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, ``most`` at most: all from the lowest step of counts (64 to a doubling) that
    leaves no more than that. Only the sizes of the steps come to the driver."""
    step = F.floor(64 * F.log2(count)).cast("int")
    found, cut = 0, None
    for at, n in sorted(rows.groupBy(step).count().collect(), reverse=True):
        if found + n > most:
            break
        found, cut = found + n, at
    return rows.where(step >= cut) if cut is not None else rows.limit(0)


def train(docs: DataFrame, learn: Column) -> LanguageModel:
    """Count words and contexts of the rows of ``docs`` for which ``learn`` is true (null texts have only their end), and
    weigh the tree for all that occurs in ``docs``."""
    rows = docs.select(text_bytes().alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    gram, learnt = F.shiftright("gram", 1).alias("gram"), F.col("gram").bitwiseAND(1) * F.col("n")
    partial = rows.mapInArrow(_gather, "word binary, gram long, n long").select("word", gram, F.coalesce(learnt, "n").alias("n"), F.col("n").alias("m"))
    counted = materialize(partial.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm_counts")
    words = counted.where(F.col("word").isNotNull()).select("word", "n")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    grams = materialize(context_tree(counted.where(F.col("gram").isNotNull()).select("gram", "n", "m")), "lm_grams")
    return LanguageModel(grams, words, int(total["n"] or 0), int(total["v"]))


def score(docs: DataFrame, model: LanguageModel, key: str = "doc_id", others: dict[str, Column] | None = None) -> DataFrame:
    """For every row: ``key``, the columns of ``others``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigram
    words with one added to each count, log10), ``score`` (log10 probability of the whole text under the tree) and
    ``bits_per_byte``. The rows are some or all of those that ``train`` was given.

    Null, empty and blank texts have one token, the end. Repeated rows get equal scores; an empty table gives an empty
    result; an empty training set gives even probabilities.
    """
    spark = docs.sparkSession
    n, v = model.tokens, model.distinct
    top = most_frequent(model.counts, "n", FREQUENT).toArrow()  # FREQUENT rows at most
    frequent = dict(zip(top.column("word").to_pylist(), np.log10(top.column("n").to_numpy() + 1.0).tolist(), strict=True))
    top = most_frequent(model.grams, "m", GRAMS).select("gram", "log").toArrow()  # GRAMS rows at most
    order = np.argsort(top.column("gram").to_numpy())
    known = [top.column(c).to_numpy()[order] for c in ("gram", "log")]
    least = float(np.log10(n + v + 1))
    held = spark.sparkContext.broadcast((*known, frequent))
    del top, frequent, known, order

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in chunks(texts):
                yield scored(*held.value, batch.slice(a, b - a), texts[a:b])

    def by_tree(grams, values, texts):
        """Sums over the pairs at hand, and for each text the others with how often they come."""
        keys, starts = gram_keys(texts)
        names, at = np.unique(keys, return_inverse=True)
        place = np.minimum(np.searchsorted(grams, names), max(len(grams) - 1, 0))
        hit = grams[place] == names if len(grams) else np.zeros(len(names), bool)
        found = np.zeros(len(names))
        found[hit] = values[place[hit]]
        sums = np.add.reduceat(found[at], starts)
        row = np.repeat(np.arange(len(texts)), np.diff([*starts, len(keys)]))
        miss = ~hit[at]
        which, tf = np.unique(row[miss] * len(names) + at[miss], return_counts=True)
        ends = np.searchsorted(which // max(len(names), 1), np.arange(len(texts) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(names[which % max(len(names), 1)]), pa.array(tf.astype(np.int64))], names=["gram", "tf"])
        return sums, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    def scored(grams, values, logs, batch, texts):
        tokens, found, base, size, ends, rare, often = [], [], [], [], [0], [], []
        for t in texts:
            words = space_words(t)
            words.append(b"\n")
            got = [x for x in map(logs.get, words) if x is not None]
            tokens.append(len(words))
            found.append(len(got))
            base.append(sum(got) - least * len(words))
            size.append(sum(map(len, words)) + len(words) - 1)
            rest = Counter(w for w in words if w not in logs) if len(got) < len(words) else {}
            rare += rest.keys()
            often += rest.values()
            ends.append(len(rare))
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(often, pa.int64())], names=["word", "tf"])
        sums, others_ = by_tree(grams, values, texts)
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in keep],
                pa.array(tokens, pa.int64()),
                pa.array(found, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(sums),
                pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                others_,
            ],
            names=[*keep, "n_tokens", "_found", "_base", "_score", "_size", "_rest", "_grams"],
        )

    others = others or {}
    keep = [key, *others]
    rows = docs.select(key, *[c.alias(k) for k, c in others.items()], text_bytes().alias("_text"))
    fields = [*[rows.schema[c] for c in keep], *[T.StructField(c, t()) for c, t in (("n_tokens", T.LongType), ("_found", T.LongType), ("_base", T.DoubleType), ("_score", T.DoubleType), ("_size", T.LongType))]]
    lists = [T.StructField(c, T.ArrayType(T.StructType([T.StructField(x, t()), T.StructField("tf", T.LongType())]))) for c, x, t in (("_rest", "word", T.BinaryType), ("_grams", "gram", T.LongType))]
    first = materialize(rows.mapInArrow(run, T.StructType([*fields, *lists])).withColumn("_row", F.monotonically_increasing_id()), "lm_first")
    held.destroy()  # what the tasks held is not needed again: the rows are stored
    rare = first.select("_row", F.explode("_rest").alias("r")).select("_row", "r.word", "r.tf")
    more = rare.join(model.counts, "word").groupBy("_row").agg(F.sum("tf").alias("_more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("_gain"))
    asked = first.select("_row", F.explode("_grams").alias("r")).select("_row", "r.gram", "r.tf")
    code = asked.join(model.grams, "gram").groupBy("_row").agg(F.sum(F.col("tf") * F.col("log")).alias("_code"))
    whole = F.col("_score") + F.coalesce("_code", F.lit(0.0))
    return first.drop("_rest", "_grams").join(more, "_row", "left").join(code, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("_found") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_gain", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        (-whole / F.log10(F.lit(2.0)) / F.col("_size")).alias("bits_per_byte"),
    )
