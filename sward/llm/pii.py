"""Personal data: base patterns for four kinds of identifier, and contextual extraction bootstrapped from them.

The base entities are the seeds. The words around them form lexical patterns; Spark scores patterns by the instances
they extract and instances by the patterns that extract them, for a few rounds. Patterns that end with a high score then
mark identifier-like strings that the base patterns missed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.llm.common import unused
from sward.session import materialize

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = {c: None for c in range(128) if not 48 <= c <= 57}

#: Strings that look like identifiers but need not pass a base pattern: the slots that patterns can fill.
_NUMERIC = re.compile(r"\+?\(?[0-9][0-9().\x20-]{4,}[0-9]")
_SOLID = re.compile(r"[0-9](?:[ .-]?[0-9])++\Z")
_QUAD = re.compile(r"[0-9]{1,3}(?:[ .-]{1,3}[0-9]{1,3}){3}\Z|[0-9]+(?:\.+[0-9]+){3,}\Z")
#: Where runs are split, from the widest separator on.
_PIECES = [re.compile(p) for p in (r"[^ ]+", r"[^ -]+", r"[^ .-]+")]
_PARTS = re.compile(r"[^\s,;|/<>]+")
_EDGE = ",;:|/<>()[]{}\"'"
#: Digits of the longest identifier.
_LONGEST = 19
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?=[\W\d_]*\Z)")
_WORD_AFTER = re.compile(r"[\W\d_]*([^\W\d_]+)")
_REACH = 40

Span = tuple[int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Equal to scanning with the email pattern from the left, but the work starts at each @ and is linear."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """The base entities of a whole text by kind, as (start, end) in code points."""
    if not text:
        return {k: [] for k in KINDS}
    found = {"email": list(_emails(text)) if "@" in text else []}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(_NOT_DIGIT)
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    found["card"] = cards
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_NOT_DIGIT)) <= 15] if "+" in text else []
    return found


def _union(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _beside(a: int, b: int, taken: list[Span], starts: list[int]) -> Iterator[Span]:
    """The parts of (a, b) that touch none of the ``taken`` spans."""
    k = max(0, bisect_left(starts, a) - 1)
    while a < b and k < len(taken) and taken[k][0] < b:
        if taken[k][1] > a:
            if taken[k][0] > a:
                yield a, taken[k][0]
            a = taken[k][1]
        k += 1
    if a < b:
        yield a, b


def candidates(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, seed): the base entities, and other identifier-like strings that touch none of them.

    What stands beside a base entity and what merged runs are made of are candidates of their own, of every kind they
    resemble; the context decides.
    """
    taken = _union(s for spans in base.values() for s in spans)
    starts = [a for a, _ in taken]
    for kind, spans in base.items():
        for a, b in spans:
            yield kind, a, b, True
    for word in _at_words(text) if "@" in text else ():
        for a, b in _beside(*word, taken, starts):
            for c, d in [(a, b)] if (a, b) == word and text.count("@", a, b) == 1 else [m.span() for m in _PARTS.finditer(text, a, b)]:
                while c < d and text[c] in _EDGE:
                    c += 1
                while c < d and text[d - 1] in _EDGE:
                    d -= 1
                if "@" in text[c + 1 : d - 1]:
                    yield "email", c, d, False
    for m in _NUMERIC.finditer(text):
        for gap in _beside(*m.span(), taken, starts):
            a, b = _trimmed(text, *gap)
            if a < b:
                for kind in ("ip", "card", "phone"):
                    for c, d in _of_kind(text, a, b, kind):
                        yield kind, c, d, False


def _trimmed(text: str, a: int, b: int) -> Span:
    """A run from its first digit, with the signs that open it, to its last; pieces that go on as words are left out."""
    if a and text[a - 1].isalnum() and text[a].isdigit():
        while a < b and text[a] not in " -":
            a += 1
    if b < len(text) and text[b].isalnum() and text[b - 1].isdigit():
        while a < b and text[b - 1] not in " -":
            b -= 1
    while b > a and not text[b - 1].isdigit():
        b -= 1
    while a < b and not (text[a].isdigit() or text[a] in "+(" and (text[a + 1].isdigit() or text[a : a + 2] == "+(")):
        a += 1
    return a, b


def _of_kind(text: str, a: int, b: int, kind: str, level: int = 0) -> Iterator[Span]:
    """Strings within a run that resemble the kind: the whole run, or else the best sequences of its pieces that do not
    overlap (such as pass the base pattern first, then the longest, then the first), and the same within other pieces."""
    if _resembles(text[a:b], kind):
        yield a, b
        return
    if level == len(_PIECES):
        return
    pieces = [m.span() for m in _PIECES[level].finditer(text, a, b) if any(map(str.isdigit, m[0]))]
    found = []
    if len(pieces) > 1:
        sizes = [len(text[x:y].translate(_NOT_DIGIT)) for x, y in pieces]
        for i, (x, _) in enumerate(pieces):
            digits, j = 0, i
            while j < len(pieces) and digits + sizes[j] <= _LONGEST:
                digits += sizes[j]
                y = pieces[j][1]
                c, d = _trimmed(text, x, y)
                if c < d and _resembles(text[c:d], kind):
                    found.append((not _passes(text[c:d], kind), i - j, i, j, c, d))
                j += 1
    free = [True] * len(pieces)
    for _, _, i, j, c, d in sorted(found):
        if all(free[i : j + 1]):
            free[i : j + 1] = [False] * (j + 1 - i)
            yield c, d
    for k, (x, y) in enumerate(pieces):
        if free[k]:
            yield from _of_kind(text, *_trimmed(text, x, y), kind, level + 1)


def _passes(s: str, kind: str) -> bool:
    return (0, len(s)) in base_spans(s)[kind]


def _at_words(text: str) -> Iterator[Span]:
    """Unbroken strings with something on both sides of an @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = at + 1
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        if start < at and stop > at + 1:
            yield start, stop
        end = stop
        at = text.find("@", stop)


def _resembles(s: str, kind: str) -> bool:
    """Whether a numeric string has the shape of the kind; a string can have that of several."""
    digits = len(s.translate(_NOT_DIGIT))
    if kind == "ip":
        return bool(_QUAD.match(s))
    if kind == "card":
        return 12 <= digits <= _LONGEST and bool(_SOLID.match(s))
    return 7 <= digits <= 15 and "+" not in s[1:]


def contexts(text: str, a: int, b: int) -> tuple[str, str]:
    """The nearest word on each side within reach, lower-cased; ``^`` and ``$`` where there is none."""
    left = _WORD_BEFORE.search(text[max(0, a - _REACH) : a])
    right = _WORD_AFTER.match(text[b : b + _REACH])
    return left[0].lower() if left else "^", right[1].lower() if right else "$"


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SLOT = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("left", pa.string()), ("right", pa.string())])


def _scan(batches):
    for batch in batches:
        spans, slots = [], []
        for text in batch.column("_text").to_pylist():
            base = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b} for k, name in enumerate(KINDS) for a, b in base[name]])
            own = []
            for kind, a, b, seed in candidates(text, base) if text else ():
                left, right = contexts(text, a, b)
                own.append({"kind": KINDS.index(kind), "start": a, "end": b, "seed": seed, "instance": text[a:b], "left": left, "right": right})
            slots.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_key"), pa.array(spans, pa.list_(_SPAN)), pa.array(slots, pa.list_(_SLOT))], names=["key", "text_key", "base", "slots"])


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One pass over whole texts: base spans and candidate slots with their contexts, stored with a row number."""
    kind = docs.schema[key].dataType.simpleString()
    slot = "struct<kind int, start int, end int, seed boolean, instance string, left string, right string>"
    rows = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("text_key"), F.col("text").alias("_text"))
    found = rows.mapInArrow(_scan, f"key {kind}, text_key long, base array<struct<kind int, start int, end int>>, slots array<{slot}>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii_scan")


def graph(scanned: DataFrame) -> DataFrame:
    """The edges of the pattern-instance graph: (kind, pattern, instance, seed, n). A slot has three patterns: both words,
    the left one, the right one."""
    slots = scanned.select(F.explode("slots").alias("s")).select("s.*")
    patterns = F.array(F.concat_ws(" _ ", "left", "right"), F.concat("left", F.lit(" _")), F.concat(F.lit("_ "), F.col("right")))
    edges = slots.select("kind", "instance", "seed", F.explode(patterns).alias("pattern"))
    return edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))


def bootstrap(edges: DataFrame, rounds: int = 3, least: int = 3, prior: float = 1.0, trust: float = 0.75) -> DataFrame:
    """Scores of patterns: (kind, pattern, score, support).

    Seeds have the value 1, all others start at 0. A round scores each pattern by the mean value of its distinct
    instances, drawn towards 0 by ``prior`` and 0 below ``least`` trusted instances; then each other instance gets the
    chance that one of its trusted patterns is right. The edges are stored; each round is two groupings and two joins on
    keys, and its outcome is written before the next.
    """
    edges = materialize(edges, "pii_edges")
    value = materialize(edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("value")), "pii_values")
    scores = None
    for k in range(rounds):
        weighed = edges.join(value, ["kind", "instance"])
        scores = materialize(
            weighed.groupBy("kind", "pattern")
            .agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_all"), F.sum((F.col("value") >= trust).cast("long")).alias("support"))
            .select("kind", "pattern", "support", F.when(F.col("support") >= least, F.col("_sum") / (F.col("_all") + prior)).otherwise(0.0).alias("score"))
            .where("score > 0"),
            "pii_patterns",
        )
        if k + 1 < rounds:
            trusted = scores.where(F.col("score") >= trust)
            reached = (
                edges.where(~F.col("seed"))
                .join(trusted, ["kind", "pattern"])
                .groupBy("kind", "instance")
                .agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("_value"))
            )
            value = materialize(
                value.join(reached, ["kind", "instance"], "left").select("kind", "instance", F.greatest("value", F.coalesce("_value", F.lit(0.0))).alias("value")),
                "pii_values",
            )
    return scores


def discovered(scanned: DataFrame, scores: DataFrame, trust: float = 0.75) -> DataFrame:
    """(row, found): spans of slots that are no seeds and that a trusted pattern extracts."""
    slots = scanned.where(F.exists("slots", lambda s: ~s["seed"])).select("row", F.explode("slots").alias("s")).select("row", "s.*").where(~F.col("seed"))
    patterns = F.array(F.concat_ws(" _ ", "left", "right"), F.concat("left", F.lit(" _")), F.concat(F.lit("_ "), F.col("right")))
    hits = slots.select("row", "kind", "start", "end", F.explode(patterns).alias("pattern")).join(scores.where(F.col("score") >= trust), ["kind", "pattern"], "left_semi")
    return hits.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))


def extract(docs: DataFrame, key: str = "doc_id", rounds: int = 3, least: int = 3, trust: float = 0.75) -> DataFrame:
    """For every row: ``key``, ``text_key`` (hash of the text), ``base`` and ``spans`` (base and discovered), both sorted
    arrays of (kind number, start, end) in code points, end exclusive.

    Null and empty texts have no spans; repeated rows each keep their row; an empty table gives an empty result; other
    columns are not read.
    """
    scanned = scan(docs, key)
    scores = bootstrap(graph(scanned), rounds, least, 1.0, trust)
    return (
        scanned.select("row", "key", "text_key", F.array_sort("base").alias("base"))
        .join(discovered(scanned, scores, trust), "row", "left")
        .select(F.col("key").alias(key), "text_key", "base", F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<kind int, start int, end int>>")))).alias("spans"))
    )


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def _is_kind(k: int):
    """A test of a span with one parameter: of two, Spark would fill the second with the place in the array."""
    return lambda s: s["kind"] == k


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans of :func:`extract`, and the list of all spans."""
    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(key, *count, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def hidden(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every (kind, start, end) replaced by the name of the kind; of overlapping ones the first names it."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, key: str = "doc_id", rounds: int = 3, least: int = 3, trust: float = 0.75) -> DataFrame:
    """``docs``, all rows and columns, with personal data replaced in the text and ``n_chars`` counted again.

    Base entities are replaced while the texts are read; only the few texts with discovered spans are looked up by key.
    Null and empty texts stay, repeated rows are treated alike, an empty table stays empty; further columns may have any name.
    """
    own_key, text_key, own_spans, hidden_text = unused(docs, "_key", "_text_key", "_spans", "_hidden")
    found = extract(docs, key, rounds, least, trust).where(F.size("spans") > F.size("base"))
    more = materialize(found.select(F.col(key).alias(own_key), F.col("text_key").alias(text_key), _listed("spans").alias(own_spans)).dropDuplicates([own_key, text_key]), "pii_found")

    @F.pandas_udf("string")
    def clean(texts, spans):
        import pandas as pd

        out = []
        for text, known in zip(texts, spans, strict=True):
            if text is None or not text:
                out.append(text)
                continue
            if known is None:
                spans_here = [(kind, a, b) for kind, own in base_spans(text).items() for a, b in own]
            else:
                spans_here = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in known.split(","))]
            out.append(hidden(text, spans_here) if spans_here else text)
        return pd.Series(out, dtype=object)

    joined = docs.join(more, docs[key].eqNullSafe(more[own_key]) & (F.xxhash64("text") == more[text_key]), "left")
    rows = joined.withColumn(hidden_text, clean.asNondeterministic()(F.col("text"), F.col(own_spans)))
    new = {"text": F.col(hidden_text)} | ({"n_chars": F.length(hidden_text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
