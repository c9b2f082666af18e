"""Sharding by fixed virtual slots.

A record's key is hashed into one of thousands of slots for good. A small versioned table says which shard holds each
slot; growing or rebalancing edits that table, and only the rows of the edited slots move.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sward.session import materialize, scratch

SLOTS = 8192
#: Parts of a slot that are numbered apart, so that a slot with many copies of a key is not one task.
PARTS = 8
PER_ROW = 16


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of the key written as text; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("int")


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot. It starts with one shard and grows one by one, so the shard count alone decides it."""
    own = [0] * slots
    for _ in range(1, shards):
        own = grown_map(own)
    return own


def grown_map(own: list[int]) -> list[int]:
    """The map with one more shard: it takes the last slots of the fullest shards until it holds its share."""
    n = max(own) + 1
    held: list[list[int]] = [[] for _ in range(n)]
    for slot, shard in enumerate(own):
        held[shard].append(slot)
    new = list(own)
    for _ in range(len(own) // (n + 1)):
        new[max(held, key=len).pop()] = n
    return new


def rebalanced_map(own: list[int], load: dict[int, int], tolerance: float = 1.05) -> list[int]:
    """The map after moving slots from the most to the least loaded shard while that helps and one is above
    ``tolerance`` times the mean. ``load``: bytes by slot."""
    new = list(own)
    shards = range(max(own) + 1)
    total: Counter[int] = Counter({s: 0 for s in shards})
    held: dict[int, list[int]] = {s: [] for s in shards}
    for slot, shard in enumerate(own):
        total[shard] += load.get(slot, 0)
        held[shard].append(slot)
    mean = sum(total.values()) / len(held)
    while True:
        most, least = max(shards, key=total.__getitem__), min(shards, key=total.__getitem__)
        gap = total[most] - total[least]
        fits = [s for s in held[most] if 0 < load.get(s, 0) < gap]
        if total[most] <= tolerance * mean or not fits:
            return new
        slot = min(fits, key=lambda s: (abs(load[s] - gap / 2), s))
        held[most].remove(slot)
        held[least].append(slot)
        total[most] -= load[slot]
        total[least] += load[slot]
        new[slot] = least


def map_table(spark: SparkSession, own: list[int], version: int = 1) -> DataFrame:
    """The map as rows (version, virtual_slot, shard), one for each slot."""
    return spark.createDataFrame([(version, s, k) for s, k in enumerate(own)], "version int, virtual_slot int, shard int")


def store_map(table: DataFrame, folder: str) -> None:
    """Write a version beside the others; a version that is there already is never overwritten."""
    table.write.mode("append").partitionBy("version").parquet(folder)


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows (virtual_slot, shard) of the newest version of a stored map, or of the named one."""
    table = spark.read.parquet(folder)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == version).select("virtual_slot", "shard")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> list[int]:
    """A stored map as a list, to be edited: it has one entry for each slot."""
    rows = stored_map(spark, folder, version).collect()
    own = [0] * len(rows)
    for slot, shard in rows:
        own[slot] = shard
    return own


def sized(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``key``, bytes, checksum and virtual slot of every row. A null text has no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col(key),
        (F.length(text).cast("long") + PER_ROW).alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(key, slots).alias("virtual_slot"),
    )


def slot_load(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows and bytes of each virtual slot that has rows, or of each of its parts."""
    return rows.groupBy("virtual_slot", *parts).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def place(docs: DataFrame, shards: int, key: str = "doc_id", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Shard and place of every row, for ``shards`` shards and for one more.

    Two versions of the slot map are stored in ``folder`` (by default a new one in the shared folder): version 1 for ``shards``
    shards, and version 2, which is version 1 as loaded, edited for one shard more. Rows get their shards by joining both.
    Law ``key``: the key and the shard count alone decide the shard, and one more shard takes rows only into itself; bytes
    are summed for each slot (``slot_bytes``), from which :func:`rebalanced_map` would make the next version.
    ``slot`` numbers the rows of a shard from 0 without gaps: by virtual slot, then key, checksum and size. Rows that
    agree in all of these are numbered in any order. The table of first numbers has a row for each part of a slot at most.
    A null key is a key of its own, a null text is empty, an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shard_map")
    store_map(map_table(spark, initial_map(shards, slots), 1), folder)
    store_map(map_table(spark, grown_map(load_map(spark, folder, 1)), 2), folder)
    both = stored_map(spark, folder, 1).join(stored_map(spark, folder, 2).withColumnRenamed("shard", "grown_shard"), "virtual_slot")
    rows = materialize(sized(docs, key, slots), "sized").withColumn("_part", F.pmod(F.col("text_crc32"), F.lit(PARTS)).cast("int"))
    load = slot_load(rows, "_part").join(F.broadcast(both), "virtual_slot")  # a map has a row for each slot
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard", "virtual_slot")
    offsets = load.select("virtual_slot", "_part", "shard", "grown_shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_first"), F.sum("n_bytes").over(whole).alias("slot_bytes"))
    within = Window.partitionBy("virtual_slot", "_part").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(offsets), ["virtual_slot", "_part"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"),
        "grown_shard",
        "virtual_slot",
        "slot_bytes",
    )


def _oracle(shards: int) -> str:
    """DuckDB form of :func:`place` over ``documents``. The two maps are a fixed function of the shard count."""
    own = initial_map(shards)
    more = grown_map(own)
    return f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
maps AS (SELECT {own} AS own, {more} AS more),
d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {PER_ROW} AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]))) AS text_crc32,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SLOTS} AS virtual_slot
  FROM documents, crc),
m AS (SELECT d.*, own[virtual_slot + 1] AS shard, more[virtual_slot + 1] AS grown_shard FROM d, maps)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, text_crc32 % {PARTS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard, CAST(virtual_slot AS INTEGER) AS virtual_slot,
  CAST(sum(size) OVER (PARTITION BY virtual_slot) AS BIGINT) AS slot_bytes FROM m
"""


ORACLE = _oracle(40)
