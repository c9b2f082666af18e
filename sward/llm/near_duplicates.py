"""Near-duplicate groups by HyperMinHash, with every link confirmed on the full shingle sets.

Each distinct shingle set gets one signature: a register for each of ``REGISTERS`` buckets holds the leading-zero count of
the smallest hash in it and the next mantissa bits. Registers are grouped into bands by a rule that depends on the size of
the set, so that small sets, which cannot differ in many shingles and still be linked, agree in some band for certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.llm.common import Memo, chunks, space_words, text_bytes, unused
from sward.session import discard, materialize

REGISTERS = 256
MANTISSA = 10
BANDS = 42
#: Shingles of two linked sets that share a band, on average, and how often registers are grouped anew so that sets of
#: up to so many shingles agree in some band: (size, groupings).
PER_BAND = 6.5
GROUPINGS = ((5, 8), (24, 3), (60, 8), (120, 6), (1 << 62, 3))
#: Sets of up to so many shingles have more bands than two linked ones can have different shingles.
CERTAIN = 24
#: Registers in use by two sets up to which their estimate says too little to leave a pair out.
FEW = 30
#: Members from which a bucket with several components is not searched by pairs of members.
CROWDED = 24
#: Hubs that the members of a bucket are compared with, after the first, before the rest of a bucket is searched.
HUBS = 2
#: Words of 64 bits, at most, in the map of wanted keys that goes to every task (16 bits a key up to there).
WORDS = 1 << 19
#: What tells sets apart, and texts under one key.
SET, ROW = ("n", "h1", "h2"), ("t1", "t2")
#: Stands for a null key: after all others.
NO_KEY = (1 << 63) - 1

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingle_set(text: bytes | None, k: int, memo: Memo) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; the whole sequence is one shingle where it is shorter."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n < 1:
        n, k = 1, len(h)
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 for an empty bucket, else 1 + (leading zeros, inverted mantissa) of its smallest hash."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(56)).astype(np.int64)
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        rest = (shingles[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)
        part, power = np.frexp(rest.astype(float))
        fraction = np.floor((np.maximum(part, 0.5) - 0.5) * (2 << MANTISSA)).astype(np.int64)
        out[bucket[first]] = 1 + ((52 - power) << MANTISSA) + ((1 << MANTISSA) - 1 - fraction)
    return out


#: The first bits of all registers, then the second ones.
BITS = ("b0", "b1", "b2", "b3", "b4", "b5", "b6", "b7")


def sketch(registers: np.ndarray) -> np.ndarray:
    """Two bits of each register of rows of signatures, as eight numbers: what a join can compare before it makes a row."""
    at = np.arange(REGISTERS, dtype=np.uint64)
    bits = mixed(mixed(registers.astype(np.uint64) * np.uint64(REGISTERS) + at)) * (registers > 0)
    bits = np.concatenate([bits & np.uint64(1), (bits >> np.uint64(1)) & np.uint64(1)], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


#: Parities of a set's shingles by their low bits. With twice as many numbers the code of a join is too long to be compiled
#: to machine code, and the join takes several times as long.
ODD = tuple(f"o{i}" for i in range(8))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For rows of sets, a bit for each value of the low bits: whether an odd number of shingles have it; as numbers of 64 bits.
    A shingle that is in one of two sets only changes one bit, so the rows differ in no more bits than the sets in shingles."""
    slots = 64 * len(ODD)
    bits = np.zeros((len(sets), slots), np.uint8)
    for row, s in zip(bits, sets, strict=True):
        row[:] = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def few_differ(limit: float, a: str = "a", b: str = "b") -> str:
    """Whether the parities of two sets differ in no more bits than linked sets can have different shingles: certain, and for
    sets of up to 300 shingles nearly as sharp as the sets themselves. Names are as in ``alike``."""
    top = round(limit * 100)
    return f"{100 + top} * ({' + '.join(f'bit_count({c}{a} ^ {c}{b})' for c in ODD)}) <= {100 - top} * (n{a} + n{b})"


def alike(limit: float, a: str = "a", b: str = "b") -> str:
    """Whether two sketches differ in no more registers than those of a linked pair can: the mean at the limit and six
    standard errors, and never more than the sets can have different shingles, as each changes one register. ``a`` and
    ``b`` are the ends of the column names; sizes are ``n<a>`` and ``n<b>``."""
    q, top = (1 - limit) * 3 / 4, round(limit * 100)
    differ = " + ".join(f"bit_count(({c}{a} ^ {c}{b}) | ({d}{a} ^ {d}{b}))" for c, d in zip(BITS[:4], BITS[4:], strict=True))
    used = f"({REGISTERS}D * (1 - exp(-least(n{a}, n{b}) / {limit * REGISTERS!r}D)))"
    likely = f"{differ} <= {q!r}D * {used} + 6 * sqrt({q * (1 - q)!r}D * {used}) + 2"
    return f"{100 + top} * ({differ}) <= {100 - top} * (n{a} + n{b}) AND {likely}"


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of signatures, less the share of registers that agree by chance."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 1 / (3 << MANTISSA)
    return np.where(used > 0, (same / np.maximum(used, 1) - chance) / (1 - chance), 0.0)


def slack(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """How far below the limit the estimate of a linked pair can lie: five standard errors, 0.08 at least. The registers in
    use are drawn without replacement from the union, whose size their number tells."""
    used = np.minimum(((a > 0) | (b > 0)).sum(axis=1), REGISTERS - 0.5)
    union = -REGISTERS * np.log(1 - used / REGISTERS)
    error = limit * (1 - limit) / np.maximum(used, 1) * (1 - np.minimum(used / np.maximum(union, 1), 1))
    return np.maximum(0.08, 5 * np.sqrt(error))


def levels(n: int, limit: float) -> list[tuple[int, int, int]]:
    """(level, bands, groupings) of a set of ``n`` shingles.

    Sets of level k have sizes from s^k to s^(k+1) with s = 1/limit, so linked sets are on the same level or neighbours;
    each set joins its own level and the next. On the levels of the smallest sets there are more bands than two linked
    sets can have different shingles, so some band agrees for certain. On the next levels a band holds ``PER_BAND``
    shingles or so, and several groupings make a miss at the limit itself rarer than 1 in 20,000. All sets with ``BANDS``
    bands share one level.
    """
    step = np.log(1 / limit)
    own = int(np.floor(np.log(n) / step + 1e-9))
    found = []
    for level in (own, own + 1):
        largest = int(np.ceil(np.exp((level + 1) * step) - 1e-9)) - 1
        certain = int(2 * largest * (1 - limit) / (1 + limit) + 1e-9) + 1
        bands = certain if largest <= CERTAIN else max(4, round(largest / PER_BAND))
        groupings = next(g for size, g in GROUPINGS if largest <= size)
        found.append((level, bands, groupings if bands > 1 else 1) if bands < BANDS else (-1, BANDS, 1))
    return list(dict.fromkeys(found))


_MOST = max(g for _, g in GROUPINGS)
_ORDERS = [np.arange(REGISTERS)] + [np.random.default_rng(g).permutation(REGISTERS) for g in range(1, _MOST)]


def band_keys(registers: np.ndarray, sizes: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every non-empty band of the signatures."""
    values = mixed(registers.astype(np.uint64) * np.uint64(REGISTERS) + np.arange(REGISTERS, dtype=np.uint64)) * (registers > 0)
    jobs: dict[tuple[int, int, int], list[int]] = {}
    for row, n in enumerate(sizes):
        for job in levels(int(n), limit):
            jobs.setdefault(job, []).append(row)
    rows, keys = [], []
    for (level, bands, groupings), members in jobs.items():
        members = np.array(members)
        for g, order in enumerate(_ORDERS[:groupings]):
            own = values[members][:, order]
            for band in range(bands):
                total = own[:, band::bands].sum(axis=1, dtype=np.uint64)
                some = total != 0
                name = mixed(np.array([((level + 2) * _MOST + g) * (BANDS + 1) + band], np.uint64))
                rows.append(members[some])
                keys.append(mixed(total[some] + name))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _marks(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: the sums of two scrambles of its members."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ _MIX1).sum(dtype=np.uint64).view(np.int64))


def _signed(k: int):
    """Set size, marks and signature of every text; the other columns stay."""

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            sets = [shingle_set(t, k, memo) for t in batch.column("_text").to_pylist()]
            marks = np.array([_marks(s) for s in sets], np.int64).reshape(-1, 2)
            own = [c for c in batch.schema.names if c != "_text"]
            registers = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, REGISTERS), np.uint16)
            bits = sketch(registers)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in own],
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(marks[:, 0]),
                    pa.array(marks[:, 1]),
                    pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets, strict=True)], pa.binary()),
                    *[pa.array(bits[:, i]) for i in range(len(BITS))],
                ],
                names=[*own, "n", "h1", "h2", "sig", *BITS],
            )

    return run


def _banded(limit: float):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            rows, keys = band_keys(regs, batch.column("n").to_numpy(), limit)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(keys)], names=["doc", "key"])

    return run


def _likely(limit: float):
    """Keep the pairs whose signatures are alike enough; with sizes, those that differ in no more registers than linked sets
    can have different shingles."""
    top = round(limit * 100)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            few = ((a > 0) | (b > 0)).sum(axis=1) <= FEW
            keep = few | (estimate(a, b) >= limit - slack(a, b, limit))
            if "na" in batch.schema.names:
                sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                keep &= (100 + top) * (a != b).sum(axis=1) <= (100 - top) * sizes
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def brief(shingles: np.ndarray) -> bytes:
    """The low bits of the shingles: enough to count at least as many common ones as there are, in a part of the space."""
    return shingles.astype(np.uint16 if len(shingles) <= 512 else np.uint32).tobytes()


def _possible(limit: float):
    """Keep the pairs whose brief sets have enough in common; those of linked sets always have."""
    top = round(limit * 100)

    def low(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, np.uint16 if n <= 512 else np.uint32)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                m, n = x["n"], y["n"]
                x, y = low(x["low"], m), low(y["low"], n)
                if x.dtype != y.dtype:
                    x, y = x.astype(np.uint16), y.astype(np.uint16)
                both = min(int(np.isin(x, y).sum()), m, n)
                keep.append(100 * both >= top * (m + n - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(limit: float):
    top, bottom = round(limit * 100), 100

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bottom * both >= top * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_LOW = pa.struct([("n", pa.int64()), ("low", pa.binary())])


def _sets(k: int):
    def run(batches):
        memo = word_hashes()
        for batch in batches:
            sets = [shingle_set(text, k, memo) for text in batch.column("_text").to_pylist()]
            lows = [{"n": len(s), "low": brief(s)} for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(lows, _LOW)], names=["doc", "set", "brief"]
            )

    return run


def _members(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
        sizes = [len(s) for s in sets]
        for a, b in chunks(batch.column("set").to_pylist(), 1 << 22):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("doc").to_numpy()[a:b], sizes[a:b])), pa.array(np.repeat(sizes[a:b], sizes[a:b])), pa.array(np.concatenate(sets[a:b]))],
                names=["doc", "n", "shingle"],
            )


def _parities(batches):
    for batch in batches:
        odd = parities([np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(odd[:, i]) for i in range(len(ODD))]], names=["doc", *ODD])


def sharing_rare(sets: DataFrame, member: DataFrame, limit: float) -> DataFrame:
    """Pairs (a, b) of different roots that can be linked, among the sets of ``member`` (doc, root, sketch).

    Two linked sets share one of their rarest shingles: of n shingles in order of frequency, the first n - limit n + 1.
    What very many sets have in common (a passage, common words) comes last in that order. Of sets that meet at a shingle
    only those become a pair whose sketches are alike, that have enough shingles from there on (``at`` counts those
    before) to be linked, as is so at the first shingle that linked sets share, and whose parities do not tell that they
    differ in too many. Noisy copies of one text share its shingles and have similar sketches, linked or not. So neither a passage that many sets hold
    nor the text that noisy copies go back to makes rows of its own.
    """
    own = sets.select("doc", "set").join(member.select("doc"), "doc")
    items = materialize(own.mapInArrow(_members, "doc long, n long, shingle long"), "nd_items")
    odd = materialize(own.mapInArrow(_parities, f"doc long, {', '.join(f'{c} long' for c in ODD)}"), "nd_odd")
    often = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = items.join(often, "shingle").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    # shingles of one set only come first in the order; they are not in the list, which is that much shorter
    head = F.size("s") + 1 - F.expr(f"(n * {round(limit * 100)} + 99) div 100")
    heads = ranked.where(head > 0).select("doc", "n", F.size("s").alias("c"), F.posexplode(F.slice("s", F.lit(1), head.cast("int"))).alias("at", "s"))
    heads = heads.select("doc", "n", (F.col("n") - F.col("c") + F.col("at")).alias("at"), "s.shingle")
    heads = all_heads = materialize(heads.join(member, "doc"), "nd_heads")
    discard(items)
    mixed_ = heads.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    heads = materialize(heads.join(mixed_, "shingle", "left_semi").join(odd, "doc"), "nd_heads")
    discard(all_heads)
    return _meeting(heads, "shingle", limit)


def _sifted(rows: DataFrame, key: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose ``key`` may be in the stored table ``wanted`` (``left_anti``: the others): all that are, and few more.
    A join by key then moves little more than it needs. Every task gets a map with a bit for each hash of a key, of bounded
    size: with very many wanted keys it tells fewer rows apart."""
    word, bits = unused(rows, "_word", "_bits")
    slots = 64 * min(WORDS, max(1, wanted.count() // 4))

    def bit(name):
        return f"cast(pmod(xxhash64(`{name}`), {slots}L) % 64 AS int)"

    def at(name):
        return f"pmod(xxhash64(`{name}`), {slots}L) div 64"

    own = wanted.columns[0]
    words = wanted.select(F.expr(at(own)).alias(word), F.expr(f"shiftleft(1L, {bit(own)})").alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    return rows.join(F.broadcast(words), F.expr(f"{at(key)} = `{word}` AND shiftright(`{bits}`, {bit(key)}) & 1L = 1L"), how)


def _end(rows: DataFrame, key: str, end: str) -> DataFrame:
    """``rows`` with ``end`` for the name of the set and as the end of the other names."""
    return rows.select(key, F.col("doc").alias(end), *[F.col(c).alias(f"{c}{end}") for c in rows.columns if c not in (key, "doc")])


def _can_link(limit: float) -> str:
    """Whether ends a and b (root, n, sketch) are of different roots and can be linked."""
    return f"roota <> rootb AND 100 * least(na, nb) >= {round(limit * 100)} * greatest(na, nb) AND {alike(limit)}"


def _matched(one: DataFrame, two: DataFrame, key: str, limit: float) -> DataFrame:
    """The rows of ``one`` and ``two`` (key, doc, root, n, sketch) under one key that are of different roots and can be linked."""
    return _end(one, key, "a").join(_end(two, key, "b"), key).where(_can_link(limit))


def _with_partner(rows: DataFrame, limit: float) -> DataFrame:
    """The ``rows`` (key, c, doc, n, sketch) that can be linked with another one of their bucket, and all rows of crowded
    buckets (``c``: members); ``root``: the set itself. Both ends of the join have the same columns, so rows move once."""
    rows = rows.withColumnRenamed("doc", "root")
    own = ["key", "root", "n", *BITS]
    one, two = (rows.where(F.col("c") < CROWDED).select(*[F.col(c).alias(f"{c}{x}") for c in own]) for x in "ab")
    kept = one.join(two, F.expr(f"keya = keyb AND {_can_link(limit)}"), "left_semi").select(*[F.col(f"{c}a").alias(c) for c in own])
    kept = kept.unionByName(rows.where(F.col("c") >= CROWDED).select(*own))
    return kept.withColumn("doc", F.col("root"))


def _meeting(rows: DataFrame, key: str, limit: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, doc, root, n, sketch) under one key that are of different roots and can be linked;
    with a column ``at``, by the shingles from there on, and with parities by those."""
    top = round(limit * 100)
    rows = rows.select(key, "doc", "root", "n", *[c for c in ("at",) if c in rows.columns], *BITS, *[c for c in ODD if c in rows.columns])
    pairs = _matched(rows, rows, key, limit).where("a < b")
    if "at" in rows.columns:
        pairs = pairs.where(f"{100 + top} * least(na - ata, nb - atb) >= {top} * (na + nb)")
    if ODD[0] in rows.columns:
        pairs = pairs.where(few_differ(limit))
    return pairs.select("a", "b")


def _with_hubs(rows: DataFrame, limit: float, seeds: range) -> DataFrame:
    """Different pairs (a, b) of the ``rows`` (key, doc, root, n, sketch) and some hubs of their bucket, where they are of
    different roots and can be linked: as many hubs as ``seeds``, so the comparisons grow with the rows. The join leaves out
    what sketches tell apart; no pair is made of it."""
    own = ["doc", "root", "n", *BITS]
    hubs = rows.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("doc", F.lit(s)).alias("o"), *own)).alias(f"h{s}") for s in seeds])
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"h{s}.{c}") for c in own]) for s in seeds]))).alias("h"))
    hubs = materialize(hubs.select("key", "h.*"), "nd_hubs")
    pairs = materialize(_matched(hubs, rows.select("key", *own), "key", limit).select("a", "b").distinct(), "nd_pairs")
    discard(hubs)
    return pairs


def _with_both(pairs: DataFrame, table: DataFrame, value: str, *others: str) -> DataFrame:
    """The stored ``pairs`` with columns of both ends; of the ``table`` only the rows of ends move."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "nd_ends")
    table = _sifted(table.select("doc", value, *others), "doc", ends)
    one, two = (table.select(F.col("doc").alias(x), F.col(value).alias(f"s{x}"), *[F.col(c).alias(f"{c}{x}") for c in others]) for x in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb", *[f"{c}{x}" for x in "ab" for c in others])


def components(edges: DataFrame) -> DataFrame:
    """(doc, root) for every end of an edge: the smallest one it can reach.

    Large-star and small-star steps: each end's neighbours are tied to the smallest of them, until nothing changes. A step
    is a grouping (with partial minima, so a hub is no hot spot) and a join; its outcome is written before the next.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = materialize(small.where("u <> v").distinct(), "cc")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        before, after = edges.agg(*mark).first(), small.agg(*mark).first()
        edges = small
        if before == after:
            break
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("root")).distinct())


def text_marks() -> list[Column]:
    """128 bits that stand for a text, by two hashes of different seeds."""
    return [F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))]


def _grouped(docs: DataFrame, key: str, k: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """The rows (key, marks of the text, size and marks of the set), and for the marks of every set with shingles the first row
    of its component, by key and then by the marks of the text."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    source = docs.select(doc.alias("key"), *[c.alias(name) for name, c in zip(ROW, text_marks(), strict=True)], text_bytes().alias("_text"))
    signed = materialize(source.mapInArrow(_signed(k), f"key long, t1 long, t2 long, n long, h1 long, h2 long, sig binary, {', '.join(f'{c} long' for c in BITS)}"), "nd_signed")
    mark = list(SET)
    first = F.min(F.struct("key", *ROW)).alias("first")
    classes = signed.where(F.col("n") > 0).groupBy(*mark).agg(first, *[F.first(c).alias(c) for c in ("sig", *BITS)])
    classes = materialize(classes.withColumn("doc", F.monotonically_increasing_id()), "nd_classes")  # doc: number of the class
    rows = materialize(signed.select("key", *ROW, *mark), "nd_rows")
    discard(signed)
    keys = materialize(classes.select("doc", "n", "sig").mapInArrow(_banded(limit), "doc long, key long"), "nd_keys")
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "nd_shared")
    # buckets with several members only, so that sketches are laid beside few rows; texts are fetched for rows with a partner
    bucketed = materialize(keys.join(shared, "key"), "nd_bucketed")
    discard(keys)
    sketched = materialize(bucketed.join(classes.select("doc", "n", *BITS), "doc"), "nd_sketched")
    near = materialize(_with_partner(sketched, limit), "nd_near")
    for table in (shared, bucketed, sketched):
        discard(table)
    needed = classes.join(near.select("doc").distinct(), "doc", "left_semi").select("first.*", "doc")
    needed = materialize(needed, "nd_needed")
    texts = _sifted(source, "key", needed).dropDuplicates(["key", *ROW]).join(needed, ["key", *ROW]).select("doc", "_text")
    sets = materialize(texts.mapInArrow(_sets(k), "doc long, set binary, brief struct<n long, low binary>"), "nd_sets")

    def confirmed(pairs):
        likely = materialize(_with_both(pairs, classes, "sig", "n").mapInArrow(_likely(limit), "a long, b long"), "nd_likely")
        likely = materialize(_with_both(likely, sets, "brief").mapInArrow(_possible(limit), "a long, b long"), "nd_possible")
        return materialize(_with_both(likely, sets, "set").mapInArrow(_linked(limit), "a long, b long"), "nd_links")

    def rooted(table, roots):
        return table.join(roots.select("doc", "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))

    def still_open(table, roots):
        """The rows, with their roots, of buckets that hold several components; ``c``: members of the bucket."""
        member = materialize(rooted(table.drop("root", "c"), roots), "nd_member")
        split = member.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "c")
        out = materialize(member.join(split, "key"), "nd_open")
        for spent in (table, member):
            discard(spent)
        return out

    links = confirmed(_with_hubs(near, limit, range(1)))
    open_ = still_open(near, materialize(components(links), "nd_roots"))
    links = links.unionByName(confirmed(_with_hubs(open_, limit, range(1, 1 + HUBS))))
    open_ = still_open(open_, materialize(components(links), "nd_roots"))
    crowded = open_.where(F.col("c") >= CROWDED).select("doc", "root", *BITS).dropDuplicates(["doc"])
    rare = sharing_rare(sets, materialize(crowded, "nd_crowded"), limit)
    last = _meeting(open_.where(F.col("c") < CROWDED), "key", limit).unionByName(rare).distinct()
    last = confirmed(materialize(last, "nd_pairs"))
    roots = materialize(components(links.unionByName(last)), "nd_roots")
    for table in (open_, sets):
        discard(table)
    tied = materialize(rooted(classes.select("doc", *mark, "first"), roots), "nd_tied")
    smallest = materialize(tied.groupBy("root").agg(F.min("first").alias("first_row")), "nd_smallest")
    discard(classes)
    return rows, tied.select(*mark, "root").join(smallest, "root").select(*mark, "first_row")


def groups(docs: DataFrame, key: str = "doc_id", k: int = 2, limit: float = 0.8) -> DataFrame:
    """For every row: ``key``, ``n_shingles``, ``component_id`` (the smallest key reachable over links, its own included)
    and ``kept`` (the row has that key).

    Two sets are linked if 100 times their intersection is at least 100 ``limit`` times their union. Equal sets are one
    class and are never compared. Then, in every band bucket, rows whose sketch is like no other one's are left out (not in
    crowded ones); members are compared with a hub, then with some more hubs; last, in buckets that still hold several
    components, members of different components; the members of crowded ones by their rarest shingles. So pairs within a group that is connected already are never made, and no pair of bucket members
    that could connect two groups is left out.

    Null, empty and blank texts have no shingles and are linked with nothing; repeated rows share a component; of rows
    with one key and different texts each has the component of its own text; a null key comes after all others; an empty
    table gives an empty result; other columns are not read. The key must be an integer.
    """
    rows, ends = _grouped(docs, key, k, limit)
    out = rows.select("key", *SET).join(ends.select(*SET, F.col("first_row.key").alias("component")), list(SET), "left")
    component = F.coalesce("component", "key")
    shown = [F.nullif(c, F.lit(NO_KEY)).cast(docs.schema[key].dataType) for c in (F.col("key"), component)]
    return out.select(shown[0].alias(key), F.col("n").alias("n_shingles"), shown[1].alias("component_id"), (component == F.col("key")).alias("kept"))


def without_copies(docs: DataFrame, key: str = "doc_id", k: int = 5, limit: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one row for each group of near duplicates: one of the smallest key.

    Rows are told apart by key and text, so of rows with one key (or none) each stays or goes by its own text. Of several
    near copies under the smallest key, or all without a key, one stays. Texts without words stay. Rows that repeat a kept
    key and its text come out once; null and empty tables are fine.
    """
    rows, ends = _grouped(docs, key, k, limit)
    own = ["key", *ROW]
    lost = rows.select(*own, *SET).join(ends, list(SET)).where(F.struct(*own) != F.col("first_row"))
    gone = materialize(lost.select(*own).distinct(), "nd_gone")
    again = materialize(rows.groupBy(*own).count().where("count > 1").select(*own), "nd_again")
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    names = unused(docs, *[f"_{c}" for c in own])
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(name) for name, c in zip(names, [doc, *text_marks()], strict=True)])

    touched = materialize(gone.unionByName(again).select("key").distinct(), "nd_touched")

    def among(some, table, how):
        return some.join(table.select(*[F.col(c).alias(name) for name, c in zip(names, own, strict=True)]), names, how)

    kept = among(_sifted(marked, names[0], touched), gone, "left_anti")
    if not again.isEmpty():
        kept = among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates([key, "text"]))
    # the rows of other keys stay where they are
    return _sifted(marked, names[0], touched, "left_anti").unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
