"""Prefix trie of conversations: which openings are shared, by how many, and what storing them once would save.

A node is a sequence of turns, named by a hash that adds up: a stretch of turns has one wherever it begins, so long
conversations are hashed in pieces over many tasks. Subtree totals follow time-forward processing: nodes in reverse level
order, totals sent to parents through a priority queue that spills; first within shards, then above the roots of all
shards. Openings of one conversation only have known totals and take no part in it.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.session import materialize

#: A prefix of turns x1..xd is the sum of xi * BASE**i modulo the prime, so shared prefixes have one name and pieces add up.
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1B54A32D192ED03A0F5A3C7 % PRIME
#: Turns that a conversation can take from another one.
GRAFT = 8
#: Messages that a queue holds in memory.
HELD = 200_000
CHUNK = 1 << 16


def named(n: int) -> bytes:
    return n.to_bytes(16, "big")


def number(name: bytes) -> int:
    return int.from_bytes(name, "big")


def turn_number(role: str, mark: str) -> int:
    return number(hashlib.sha256(f"{role}\0{mark}".encode()).digest()[:16]) % PRIME


# --- turns and their prefix hashes -----------------------------------------------------------------------------


_PREFIX = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("size", pa.int64())])


def _prefixes(batches):
    """Sorted turns to their places and prefix hashes within the piece of the conversation that lies in this task."""
    conv, at = None, 0
    total, power = 0, 1
    for batch in batches:
        places, befores, afters = [], [], []
        for c, role, mark in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "mark")], strict=True):
            if c != conv:
                conv, at, total, power = c, 0, 0, 1
            befores.append(named(total))
            at, power = at + 1, power * BASE % PRIME
            total = (total + turn_number(role, mark) * power) % PRIME
            places.append(at)
            afters.append(named(total))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(places, pa.int64()), pa.array(befores, pa.binary()), pa.array(afters, pa.binary()), batch.column("size")], schema=_PREFIX)


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, before, after, size): every turn with the hash before and after it within its piece. Turns are dealt out by
    ranges of conversation and place, equal ones by their row number, so no conversation is too long for a task."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("row")]
    near = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    wanted = near.select("conv_id", "role", "mark", "size", F.spark_partition_id().cast("long").alias("part"))
    return materialize(wanted.mapInArrow(_prefixes, "conv_id long, part long, at long, before binary, after binary, size long"), "trie_turns")


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, pieces): of each piece its turns, hash and first turns; a conversation has as many pieces as tasks had it."""
    first = F.when(F.col("at") <= GRAFT, F.struct("at", "after", "size"))
    each = turns.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by("after", "at").alias("total"), F.sort_array(F.collect_list(first)).alias("first"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "total", "first"))).alias("pieces"))


# --- conversations that begin with turns of another one -----------------------------------------------------------


def _heads(own: list[dict], most: int) -> list[tuple[int, int]]:
    """Hash and bytes of the first turns of a conversation, ``most`` at most."""
    out: list[tuple[int, int]] = []
    skipped = total = 0
    for p in own or ():
        for f in p["first"]:
            if skipped + f["at"] <= most:
                out.append(((total + pow(BASE, skipped, PRIME) * number(f["after"])) % PRIME, f["size"]))
        total = (total + pow(BASE, skipped, PRIME) * number(p["total"])) % PRIME
        skipped += p["n"]
        if skipped >= most:
            break
    return out


def _planned(own: list[dict], base: list[dict] | None, h: int) -> dict:
    """What becomes of a conversation whose first ``h`` turns are those of ``base``: the nodes of these turns, and for each
    piece of its own turns how hashes and places change (node = add + times * hash, turns above ``skip`` are kept)."""
    heads, left = _heads(base or [], h), _heads(own, h)
    n = sum(p["n"] for p in own)
    shift = len(heads) - h
    names = [0, *[x for x, _ in heads]]
    top = [{"depth": 0, "node": named(0), "parent": None, "size": 0}]
    top += [{"depth": d + 1, "node": named(names[d + 1]), "parent": named(names[d]), "size": size} for d, (_, size) in enumerate(heads)]
    lines = []
    if n > h:
        start = left[h - 1][0] if h else 0
        scale = pow(BASE, shift, PRIME)
        skipped = total = 0
        for p in own:
            if skipped + p["n"] > h:
                lines.append({"part": p["part"], "skip": h - skipped, "deeper": skipped + shift, "add": named((names[-1] + (total - start) * scale) % PRIME), "times": named(pow(BASE, skipped + shift, PRIME))})
            total = (total + pow(BASE, skipped, PRIME) * number(p["total"])) % PRIME
            skipped += p["n"]
    return {"length": len(heads) + max(0, n - h), "top": top, "lines": lines}


_TOP = pa.list_(pa.struct([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("size", pa.int64())]))
_LINES = pa.list_(pa.struct([("part", pa.int64()), ("skip", pa.int64()), ("deeper", pa.int64()), ("add", pa.binary()), ("times", pa.binary())]))
_PLAN = pa.schema([("conv_id", pa.int64()), ("length", pa.int64()), ("top", _TOP), ("lines", _LINES)])
_PLAN_DDL = "conv_id long, length long, top array<struct<depth long, node binary, parent binary, size long>>, lines array<struct<part long, skip long, deeper long, add binary, times binary>>"


def _plans(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "h", "pieces", "base_pieces")]
        yield pa.RecordBatch.from_pylist([{"conv_id": c} | _planned(own, base, h) for c, h, own, base in zip(*cols, strict=True)], _PLAN)


def plans(known: DataFrame, base: Column | None, h: Column | None) -> DataFrame:
    each = known.withColumn("h", (F.least(h, F.lit(GRAFT)) if h is not None else F.lit(0)).cast("int")).withColumn("_base", base if base is not None else F.col("conv_id"))
    others = known.select(F.col("conv_id").alias("_base"), F.col("pieces").alias("base_pieces"))
    return each.join(others, "_base", "left").select("conv_id", "h", "pieces", "base_pieces").mapInArrow(_plans, _PLAN_DDL)


def _moved(batches):
    for batch in batches:
        node, parent = [], []
        for before, after, add, times in zip(*[batch.column(c).to_pylist() for c in ("before", "after", "add", "times")], strict=True):
            plus, by = number(add), number(times)
            node.append(named((plus + by * number(after)) % PRIME))
            parent.append(named((plus + by * number(before)) % PRIME))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("length"), batch.column("depth"), pa.array(node, pa.binary()), pa.array(parent, pa.binary()), batch.column("size")], names=["conv_id", "length", "depth", "node", "parent", "size"])


def paths(conversations: DataFrame, base: Column | None = None, h: Column | None = None) -> DataFrame:
    """(conv_id, length, depth, node, parent, size): every conversation with every node it passes, from the root on."""
    turns = prefixes(conversations)
    plan = materialize(plans(pieces(turns), base, h), "trie_plans")
    top = plan.select("conv_id", "length", F.explode("top").alias("t")).select("conv_id", "length", "t.depth", "t.node", "t.parent", "t.size")
    lines = plan.select("conv_id", "length", F.explode("lines").alias("l")).select("conv_id", "length", "l.*")
    own = turns.join(lines, ["conv_id", "part"]).where("at > skip").select("conv_id", "length", (F.col("at") + F.col("deeper")).alias("depth"), "before", "after", "add", "times", "size")
    moved = own.mapInArrow(_moved, "conv_id long, length long, depth long, node binary, parent binary, size long")
    return materialize(top.unionByName(moved), "trie_paths")


# --- totals of subtrees -------------------------------------------------------------------------------------------


class SpillingQueue:
    """A priority queue of (level, node, n, leaves, saved) that keeps ``held`` messages in memory; what goes beyond is
    sorted and written to unnamed files of the task, which are read again in blocks and merged."""

    ROW = struct.Struct(">q16sqqq")

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []
        self.spills = 0

    def push(self, message: tuple[int, bytes, int, int, int]) -> None:
        if len(self.heap) >= self.held:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # has no name, so nothing is left of it if the task is lost
        for m in sorted(self.heap):
            file.write(self.ROW.pack(*m))
        file.seek(0)
        self.heap, self.spills = [], self.spills + 1
        self._next(self.spills, self._read(file))

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while block := file.read(self.ROW.size * 1024):
                yield from self.ROW.iter_unpack(block)

    def _next(self, of: int, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, of, run))

    def take(self, level: int, node: bytes) -> tuple[int, int, int, int]:
        """Number of messages to a node and the sums of what they say. Nodes ask in order."""
        count = n = leaves = saved = 0
        key = (level, node)
        while True:
            own = self.heap[0] if self.heap else None
            far = self.runs[0][0] if self.runs else None
            best = own if far is None or own is not None and own <= far else far
            if best is None or best[:2] != key:
                return count, n, leaves, saved
            if best is own:
                heapq.heappop(self.heap)
            else:
                self._next(*heapq.heappop(self.runs)[1:])
            count, n, leaves, saved = count + 1, n + best[2], leaves + best[3], saved + best[4]


_TOTALS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("to_shards", pa.bool_())])
_TOTALS_DDL = "conv_id long, depth long, node binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, to_shards boolean"


def _forward(batches, held):
    """Nodes in reverse level order to their totals; a node's totals go to its parent if that is in the same shard.

    Members that neither end at a node nor go on to a shared child are its children of one conversation each."""
    queue = SpillingQueue(held)
    names = ("conv_id", "depth", "node", "parent", "n_convs", "n_ends", "size", "shard_root", "from_n", "from_children", "from_leaves", "from_saved")
    for batch in batches:
        out = []
        for conv, depth, node, parent, n, ends, size, is_root, *more in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            found = queue.take(-depth, node)
            count, below, leaves, saved = (found[0] + more[1], found[1] + more[0], found[2] + more[2], found[3] + more[3])
            single = n - ends - below
            children = count + single
            leaves = leaves + single if children else 1
            saved += (n - 1) * size
            if not is_root:
                queue.push((1 - depth, parent, n, leaves, saved))
            out.append({"conv_id": conv, "depth": depth, "node": node, "parent": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "to_shards": is_root})
        yield pa.RecordBatch.from_pylist(out, _TOTALS)


def _nothing() -> list[Column]:
    return [F.lit(0).cast("long").alias(c) for c in ("from_n", "from_children", "from_leaves", "from_saved")]


def totals(shared: DataFrame, path: DataFrame, held: int = HELD) -> DataFrame:
    """Children, leaves and savings of the nodes of several conversations.

    A node of at least the square root of all conversations is heavy; heavy nodes are the top of the trie. A light node
    below a heavy one is the root of a shard, so a shard has fewer conversations than that root, however many begin
    alike. Shards are processed in tasks by hash of their root; the sums of their roots then go to the heavy nodes, of
    which there are at most (all turns) / (that square root), in one more pass.
    """
    n = (shared.where("depth = 0").select("n_convs").first() or [0])[0]
    least = max(2, int(n**0.5) + (int(n**0.5) ** 2 < n))
    heavy = shared.where(F.col("n_convs") >= least)
    deepest = heavy.agg(F.max("depth")).first()[0] or 0
    near = path.where((F.col("depth") > 0) & (F.col("depth") <= deepest + 1)).select("conv_id", "depth", "node")
    below = near.join(heavy.where("depth > 0").select("node"), "node", "left_anti")
    shard = below.groupBy("conv_id").agg(F.min_by("node", "depth").alias("shard"))
    light = shared.where(F.col("n_convs") < least).join(shard, "conv_id")
    level = [F.col("depth").desc(), F.col("node")]
    dealt = light.withColumn("shard_root", F.col("node") == F.col("shard")).repartition("shard").sortWithinPartitions(*level)
    forward = partial(_forward, held=held)
    done = materialize(dealt.select("conv_id", "depth", "node", "parent", "n_convs", "n_ends", "size", "shard_root", *_nothing()).mapInArrow(forward, _TOTALS_DDL), "trie_shards")
    sums = (
        done.where("to_shards").groupBy(F.col("parent").alias("node"))
        .agg(F.sum("n_convs").alias("from_n"), F.count(F.lit(1)).alias("from_children"), F.sum("n_leaves").alias("from_leaves"), F.sum("saved_tokens").alias("from_saved"))
    )
    top = heavy.join(sums, "node", "left").na.fill(0, ["from_n", "from_children", "from_leaves", "from_saved"])
    rows = top.withColumn("shard_root", F.col("depth") == 0).repartition(1).sortWithinPartitions(*level)
    above = rows.select("conv_id", "depth", "node", "parent", "n_convs", "n_ends", "size", "shard_root", "from_n", "from_children", "from_leaves", "from_saved").mapInArrow(forward, _TOTALS_DDL)
    return done.unionByName(above)


# --- lists of conversations that end at a node ----------------------------------------------------------------------


_LISTED = pa.schema([("node", pa.binary()), ("task", pa.int64()), ("k", pa.int64()), ("ends_sha256", pa.string()), ("text", pa.string())])
_LISTED_DDL = "node binary, task long, k long, ends_sha256 string, text string"


def _lists(batches):
    """Sorted (node, conv_id) to hashes of the lists that lie within the task, and to pieces of text of the others."""
    node, task, k, ids, size, first = None, 0, 0, [], 0, True
    for batch in batches:
        out = []
        for at, conv, t in zip(*[batch.column(c).to_pylist() for c in ("node", "conv_id", "task")], strict=True):
            if at != node:
                if node is not None:
                    text = ",".join(ids)
                    whole = not first and not k
                    out.append({"node": node, "task": task, "k": k, "ends_sha256": hashlib.sha256(text.encode()).hexdigest() if whole else None, "text": None if whole else text})
                    first = False
                node, task, k, ids, size = at, t, 0, [], 0
            elif size > CHUNK:
                out.append({"node": node, "task": task, "k": k, "ends_sha256": None, "text": ",".join(ids)})
                k, ids, size = k + 1, [], 0
            ids.append(str(conv))
            size += 20
        yield pa.RecordBatch.from_pylist(out, _LISTED)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "task": task, "k": k, "ends_sha256": None, "text": ",".join(ids)}], _LISTED)


_HASHED = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _hash_lists(batches):
    node, sha = None, None
    for batch in batches:
        out = []
        for at, text in zip(*[batch.column(c).to_pylist() for c in ("node", "text")], strict=True):
            if at != node:
                if node is not None:
                    out.append({"node": node, "ends_sha256": sha.hexdigest()})
                node, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        yield pa.RecordBatch.from_pylist(out, _HASHED)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": sha.hexdigest()}], _HASHED)


def ends(path: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the list of conversations that end at a node. Lists are written by ranges of (node,
    conversation); only the text of those that cross a task or are long is brought together, in pieces, to be hashed."""
    at = path.where("depth = length").select("node", "conv_id")
    near = at.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").withColumn("task", F.spark_partition_id().cast("long"))
    listed = materialize(near.mapInArrow(_lists, _LISTED_DDL), "trie_ends")
    rest = listed.where("ends_sha256 IS NULL").repartition("node").sortWithinPartitions("node", "task", "k").select("node", "text")
    return listed.where("ends_sha256 IS NOT NULL").select("node", "ends_sha256").unionByName(rest.mapInArrow(_hash_lists, "node binary, ends_sha256 string"))


# --- the trie -------------------------------------------------------------------------------------------------------


def trie(conversations: DataFrame, base: Column | None = None, h: Column | None = None, held: int = HELD) -> DataFrame:
    """One row for each distinct opening: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    With ``base`` and ``h`` (columns of conv_id) the first ``h`` turns, at most ``GRAFT``, of a conversation are those of
    conversation ``base``. Turns go by number, null ones first, then by role and SHA-256 of the text; repeated rows are
    turns of their own. A null role or text is empty. Rows without a conv_id (an integer) belong to no conversation.
    Texts of any length are read once, for their hash. Other columns, whatever their names, are not read. An empty table
    gives no rows, not even a root.
    """
    path = paths(conversations, base, h)
    keys = path.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_convs"),
        F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"),
    )
    nodes = materialize(keys, "trie_nodes")
    shared = nodes.where("n_convs > 1")
    single = nodes.where("n_convs = 1").select(
        "conv_id", "depth", "node", "parent", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")
    )
    each = totals(shared, path, held).drop("to_shards").unionByName(single)
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    full = each.join(above, "parent", "left").join(ends(path), "node", "left")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with turns of the nearest lower conversation whose number five divides."""
    c = F.col("conv_id")
    return trie(conversations, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9)


ORACLE = """
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(sha256(length(role) || ':' || role || text)) OVER w AS path,
    octet_length(encode(text)) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path),
families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS above
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:CAST(n.depth - 1 AS BIGINT)]),
kids AS (SELECT above AS path, count(*) AS n_children FROM families WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM families f LEFT JOIN kids k ON f.path = k.path),
subtrees AS (
  SELECT p.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens
  FROM full_nodes b JOIN paths p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN subtrees USING (path)
"""
