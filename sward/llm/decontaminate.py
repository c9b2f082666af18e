"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items go into one automaton. A document is streamed through it once; after every word the automaton
knows the longest run of words ending there that occurs in some item. A run that covers a window marks its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.llm.common import text_bytes, unused, word_list
from sward.session import materialize

WINDOW = 10
#: Words of test items in one automaton; more items are searched in several blocks.
BLOCK_WORDS = 50_000
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class SuffixAutomaton:
    """All substrings of several word sequences, with the states that stand for whole windows.

    ``hits[state]`` lists (window length, item ids) for the windows that end wherever the state is reached, its own and
    those of its suffixes; an own window counts only if the current match is at least as long.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                sequences.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        own: dict[int, dict[int, set[str]]] = {}
        for name, ids in sequences:
            m = min(window, len(ids))
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= m:
                    at = state
                    while self.length[self.link[at]] >= m:
                        at = self.link[at]
                    own.setdefault(at, {}).setdefault(m, set()).add(name)
        self.hits: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = tuple((m, tuple(names)) for m, names in own.get(state, {}).items())
            self.hits[state] = mine + self.hits[self.link[state]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """Part the strings of ``q`` that are one word longer than ``p`` from its longer ones."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked word ranges (start, end), merged and in order, and the items whose windows occur."""
        following, link, length, hits = self.next, self.link, self.length, self.hits
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(w)
            if to is None:
                continue
            state = to
            matched += 1
            if hits[state]:
                most = 0
                for m, found in hits[state]:
                    if m <= matched:
                        names.update(found)
                        most = max(most, m)
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, names


_SPANS = pa.list_(pa.list_(pa.int32()))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finder(automaton):
    """(key, n_words, spans, items) of every row."""

    def run(batches):
        own = automaton.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column("_text").to_pylist():
                words = word_list(text)
                found, who = own.match(words)
                n_words.append(len(words))
                spans.append([list(x) for x in found])
                items.append(sorted(who))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["key", "n_words", "spans", "items"],
            )

    return run


def _counter(batches):
    """(row, key, n_words) of every row."""
    for batch in batches:
        n_words = [len(word_list(t)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(n_words, pa.int64())], names=["row", "key", "n_words"])


def _block_finder(automaton):
    """(row, spans, items) of the rows in which this block's items occur."""

    def run(batches):
        own = automaton.value
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                found, who = own.match(word_list(text))
                if found:
                    out.append((row, [list(x) for x in found], sorted(who)))
            rows, spans, items = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["row", "spans", "items"])

    return run


def _merger(batches):
    for batch in batches:
        spans = [[list(x) for x in _merge([tuple(x) for x in own])] for own in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, _SPANS), batch.column("items")], names=["row", "spans", "items"])


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Broadcast automata of the items, a bounded number of words in each. Items without words or text have none."""
    spark = items.sparkSession
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 5)))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        built = SuffixAutomaton(
            ((r["item"], word_list(r["text"].encode("utf-8", "surrogatepass"))) for r in part.collect()), window
        )
        yield blocks, spark.sparkContext.broadcast(built)


def find_spans(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """For every row: ``key``, ``n_words``, ``spans`` (word ranges inside occurrences of windows) and ``items``.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null and empty texts have no words;
    repeated rows each keep their row; an empty table gives an empty result; other columns are not read. The items are
    searched in blocks of a bounded size, each in one pass over the documents.
    """
    key_type = docs.schema[key].dataType
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_bytes().alias("_text"))
    blocks = [automaton for _, automaton in automata(items, window, block_words)]
    found = "spans array<array<int>>, items array<string>"
    if len(blocks) == 1:
        whole = rows.mapInArrow(_finder(blocks[0]), f"key {key_type.simpleString()}, n_words long, {found}")
        return whole.withColumnRenamed("key", key)
    # the texts are stored once, with a row number; each block adds what it finds in the rows that have any of it
    stored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate_rows")
    counted = stored.mapInArrow(_counter, f"row long, key {key_type.simpleString()}, n_words long")
    each = reduce(DataFrame.unionByName, [stored.select("row", "_text").mapInArrow(_block_finder(x), f"row long, {found}") for x in blocks])
    hits = each.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = hits.mapInArrow(_merger, f"row long, {found}")
    return counted.join(merged, "row", "left").select(F.col("key").alias(key), "n_words", F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the hash of the item list of :func:`find_spans`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))
    return found.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    ends = [0, *[places[b - 1][1] for _, b in spans]]
    starts = [*[places[a][0] for a, _ in spans], len(text)]
    return "".join(text[x:y] for x, y in zip(ends, starts, strict=True))


def _cut(automaton, text: str, max_length: int, max_coverage: float) -> str | None:
    """The text without its contaminated spans, or null where they cover too much of it. Cutting may join the ends of
    two partial matches, so the rest is searched again until nothing is left."""
    total = cut = 0
    while True:
        words = word_list(text.encode("utf-8", "surrogatepass"))
        total = total or len(words)
        spans = [s for s in automaton.match(words)[0] if s[1] - s[0] >= max_length]
        if not spans:
            return text
        cut += sum(b - a for a, b in spans)
        if cut > max_coverage * total:
            return None
        text = _without(text, spans)


def _marked(automaton):
    """(_row, _spans) of the rows with marked words."""

    def run(batches):
        own = automaton.value
        for batch in batches:
            rows, spans = [], []
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                found = own.match(word_list(text))[0]
                if found:
                    rows.append(row)
                    spans.append([list(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["_row", "_spans"])

    return run


def _cut_once(max_length: int, max_coverage: float):
    """One round of :func:`_cut` with the spans of all blocks; ``_changed`` tells whether anything was cut."""

    def run(batches):
        for batch in batches:
            texts, totals, cuts, changed = [], [], [], []
            cols = batch.select(["_now", "_total", "_cut", "_spans"]).to_pydict()
            for text, total, cut, found in zip(*cols.values(), strict=True):
                spans = [s for s in _merge([tuple(x) for x in found]) if s[1] - s[0] >= max_length]
                total = total or len(word_list(text.encode("utf-8", "surrogatepass")))
                cut += sum(b - a for a, b in spans)
                texts.append((None if cut > max_coverage * total else _without(text, spans)) if spans else text)
                totals.append(total)
                cuts.append(cut)
                changed.append(bool(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(cuts, pa.int64()), pa.array(changed, pa.bool_())],
                names=["_row", "_now", "_total", "_cut", "_changed"],
            )

    return run


def _cut_in_blocks(rows: DataFrame, blocks: list, max_length: int, max_coverage: float) -> DataFrame:
    """(_row, _now): the last text of the rows (_row, text) with passages of any block, null where too much was cut.

    A round collects the spans of all blocks on the same text and cuts once; the rows it changed are searched again by
    all blocks. So results do not depend on how the items are dealt into blocks.
    """
    state = rows.select("_row", F.col("text").alias("_now"), F.lit(0).cast("long").alias("_total"), F.lit(0).cast("long").alias("_cut"))
    settled = None
    while True:
        texts = state.where(F.col("_now").isNotNull()).select("_row", text_bytes("_now").alias("_text"))
        found = reduce(DataFrame.unionByName, [texts.mapInArrow(_marked(x), "_row long, _spans array<array<int>>") for x in blocks])
        found = materialize(found.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans")), "decontaminate_spans")
        once = state.join(found, "_row").mapInArrow(_cut_once(max_length, max_coverage), "_row long, _now string, _total long, _cut long, _changed boolean")
        once = materialize(once.where("_changed").drop("_changed"), "decontaminate_cut")
        # a row cut again later has its last text there
        settled = once.select("_row", "_now") if settled is None else settled.join(once.select("_row"), "_row", "left_anti").unionByName(once.select("_row", "_now"))
        if once.isEmpty():
            return settled
        settled = materialize(settled, "decontaminate_settled")
        state = once


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_length: int = 1,
    max_coverage: float = 0.8,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the passages of ``items``: spans of at least ``max_length`` marked words are cut out of the text;
    a document of which they cover more than ``max_coverage`` is removed.

    All columns stay, whatever their names, ``n_chars`` is counted again where it exists, null and empty texts and texts without a match are
    unchanged, repeated rows are treated alike, an empty item table changes nothing. Items of several blocks are cut by
    the spans of all blocks together; for that the documents are stored once, with a row number.
    """
    names = docs.columns
    row, mark, last_text, changed = unused(docs, "_row", "_clean_text", "_now", "_changed")
    blocks = [automaton for _, automaton in automata(items, window, block_words)]
    if len(blocks) == 1:

        @F.pandas_udf("string")
        def clean(texts, automaton=blocks[0]):
            own = automaton.value
            return texts.map(lambda t: t if t is None else _cut(own, t, max_length, max_coverage))

        rows = docs.withColumn(mark, clean.asNondeterministic()(F.col("text")))
    else:
        stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate_docs")
        texts = stored.select(F.col(row).alias("_row"), "text")
        last = _cut_in_blocks(texts, blocks, max_length, max_coverage).select(F.col("_row").alias(row), F.col("_now").alias(last_text), F.lit(True).alias(changed))
        rows = stored.join(last, row, "left").withColumn(mark, F.when(F.col(changed), F.col(last_text)).otherwise(F.col("text")))
    rows = rows.where(F.col(mark).isNotNull() | F.col("text").isNull())
    new = {"text": F.col(mark)} | ({"n_chars": F.length(mark).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in names])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, pos.m, item_id FROM pos JOIN win ON pos.s = win.s AND pos.m = win.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
who AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS t
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(who.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(who.t, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN who USING (doc_id)
"""
