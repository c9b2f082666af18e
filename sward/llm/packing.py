"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

A document longer than a sequence fills whole sequences first; what is left of it, and every shorter document, is packed.
Bins are kept in the order of their free space and carry two bitmaps: the sources and the duplicate clusters they hold. A
piece goes to the fullest bin that it fits, and the search goes on to the next fuller-than-needed bin until one is free of
both its source and its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.session import materialize

CAPACITY = 8192
#: Pieces packed together in one task; a table is dealt into as many such cells as it needs.
CELL = 1500


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), in the given order. None stands for no source or no cluster and
    conflicts with nothing."""
    sources: dict[object, int] = {}
    clusters: dict[object, int] = {}
    free: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    placed = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        k = bisect_left(free, (length, -1))
        while k < len(free) and (held[free[k][1]][0] & s or held[free[k][1]][1] & c):
            k += 1
        if k < len(free):
            residual, number = free.pop(k)
            held[number] = (held[number][0] | s, held[number][1] | c)
        else:
            residual, number = capacity, len(held)
            held.append((s, c))
        placed.append((number, capacity - residual))
        insort(free, (residual - length, number))
    return placed


def _pack_cell(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        cols = table.select(["_row", "_length", "_source", "_cluster"]).to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (-cols["_length"][i], cols["_row"][i]))
        placed = best_fit(((cols["_length"][i], cols["_source"][i], cols["_cluster"][i]) for i in order), capacity)
        out = table.select(["_row"]).take(order)
        return out.append_column("_bin", pa.array([f"{cell}-{b}" for b, _ in placed])).append_column("_at", pa.array([o for _, o in placed], pa.int64()))

    return run


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    capacity: int = CAPACITY,
    length: Column | None = None,
    source: Column | None = None,
    cluster: Column | None = None,
    cell: int = CELL,
) -> DataFrame:
    """One row for each piece: ``key``, ``piece`` (from 0), ``start`` and ``length`` within the document, ``bin_id`` and
    ``bin_offset``.

    ``length`` defaults to the UTF-8 bytes of the text and one end mark, ``source`` to the column of that name, ``cluster``
    to a hash of the text. No bin holds more than ``capacity``, nor two pieces of one source or one cluster. Pieces are
    dealt into cells of about ``cell`` by a stored row number, so a hot source, cluster or key is spread over all of them;
    each cell is packed on its own, longest piece first.

    A null text has length 1 and no cluster; a null source conflicts with nothing; repeated rows are separate pieces of one
    cluster; an empty table gives an empty result.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if length is None else length
    source = (F.col("source") if "source" in docs.columns else F.lit(None)) if source is None else source
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text")) if cluster is None else cluster
    rows = docs.select(F.col(key).alias("_key"), length.cast("long").alias("_all"), source.cast("string").alias("_source"), cluster.cast("string").alias("_cluster"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "packing")
    full = F.floor(F.col("_all") / capacity)
    whole = rows.where(F.col("_all") >= capacity).select("_key", "_row", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece"))
    whole = whole.select(
        "_key",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        F.concat(F.lit("w"), F.col("_row"), F.lit("-"), F.col("piece")).alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"),
    )
    rest = rows.select("*", full.cast("long").alias("_full"), (F.col("_all") % capacity).alias("_length")).where("_length > 0")
    cells = max(1, -(-rest.count() // cell))
    dealt = rest.select("_row", "_length", "_source", "_cluster", F.pmod(F.xxhash64("_row"), F.lit(cells)).alias("_cell"))
    placed = dealt.groupBy("_cell").applyInArrow(_pack_cell(capacity), "_row long, _bin string, _at long")
    packed = rest.select("_key", "_row", "_full", "_length").join(placed, "_row").select(
        "_key", F.col("_full").cast("int").alias("piece"), (F.col("_full") * capacity).alias("start"), F.col("_length").alias("length"), F.col("_bin").alias("bin_id"), F.col("_at").alias("bin_offset")
    )
    return whole.unionByName(packed).withColumnRenamed("_key", key)
