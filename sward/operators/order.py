"""Order statistics and ranks that hold for groups of any size.

Two routes, chosen by what bounds the group:

* a window or Spark's own exact ``percentile`` per group, where the group is bounded by the data model: the species of one
  plot-year or study-year, or the time steps of one species series;
* :func:`value_ranges` where nothing bounds it (a whole site, a treatment, the whole table). It groups equal values first
  and stores them in ranges of (group, value) with the number of rows in each range; sums over the ranges give every
  range its offset, and only the ranges that hold a wanted position are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import MAD_SCALE, rescale, safe_div
from sward.session import checkpoint, materialize


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach a per-group table to rows. No hint is given: Spark broadcasts it when it is small, and otherwise joins
    on the keys with skewed partitions split at run time. With no keys the table is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(per_group))  # exactly one row: the bound is in the plan
    return df.join(per_group, list(keys), how)


#: Groups with at least this share of all rows (one in so many) are heavy; there are never more of them than this number.
HEAVY = 256
SPREAD = 1024


def attach_counted(df: DataFrame, per_group: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Attach a stored per-group table, whose column ``rows`` counts the rows of each group, without moving the rows of a heavy
    group to one place.

    Groups with a 256th of all rows or more, 256 at most, are broadcast. Their rows have got their values then, and take
    part in the join of the others under keys spread by a hash of the row, where they meet nothing; light groups are
    joined by key as usual. Rows of a group that the table does not have get NULL."""
    keys = list(keys)
    values = [c for c in per_group.columns if c not in (*keys, rows)]
    total = per_group.agg(F.sum(rows).alias("_total"))
    sized = per_group.crossJoin(F.broadcast(total))  # exactly one row
    is_heavy = F.col(rows) * HEAVY >= F.col("_total")
    heavy = sized.where(is_heavy).select(*keys, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_h_{c}") for c in values])
    none = F.least(F.col(rows), F.lit(0)).cast("int").alias("_spread")  # 0, but no constant: it has to stay a key of the join
    light = sized.where(~is_heavy).select(*keys, none, *[F.col(c).alias(f"_l_{c}") for c in values])
    spread = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SPREAD)).cast("int") + 1).otherwise(0)
    out = df.join(F.broadcast(heavy), keys, "left").withColumn("_spread", spread).join(light, [*keys, "_spread"], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(F.col("_heavy"), F.col(f"_h_{c}")).otherwise(F.col(f"_l_{c}")).alias(c) for c in values])


def meet(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet; the keys of ``other`` are left out."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    on = [df[k].eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(other.withColumnsRenamed(names), on).drop(*names.values())


def value_ranges(df: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values per group with ``cnt`` rows each, stored in ranges (``_part``) of (group, value); and for each group
    and range the rows before it (``_offset``), in it (``_in``) and in the group (``n_total``). NULL values are left out.

    A group is spread over as many ranges as it needs. The second table has at most one row for each group and one more
    for each range."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    near = counts.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col(value).asc())
    stored = materialize(near.withColumn("_part", F.spark_partition_id()), "ranges")
    each = stored.groupBy(*by, "_part").agg(F.sum("cnt").alias("_in"))
    if by:
        group = Window.partitionBy(*by)
        before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offset, total = F.coalesce(F.sum("_in").over(before), F.lit(0)), F.sum("_in").over(group)
        return stored, each.select(*by, "_part", "_in", offset.alias("_offset"), total.alias("n_total"))
    # one group: its ranges, no more than there are tasks, are summed as one array and spread again
    whole = each.agg(F.sort_array(F.collect_list(F.struct("_part", "_in"))).alias("_all")).select(F.explode("_all").alias("_r"), "_all")

    def rows_in(ranges):
        return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, x: a + x["_in"])

    offset = rows_in(F.filter("_all", lambda x: x["_part"] < F.col("_r._part")))
    return stored, whole.select("_r._part", "_r._in", offset.alias("_offset"), rows_in("_all").alias("n_total"))


def _ordered(stored: DataFrame, ranges: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    within = Window.partitionBy(*by, "_part").orderBy(value)
    rows = meet(stored, ranges, [*by, "_part"])
    return rows.withColumn("n_below", F.col("_offset") + F.sum("cnt").over(within) - F.col("cnt"))


def value_positions(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``cnt`` rows, ``n_below`` rows smaller, and ``n_total`` rows in the group. NULL values
    are left out; a NULL key is a group like others."""
    by = list(by)
    return _ordered(*value_ranges(df, by, value), by, value).select(*by, value, "cnt", "n_below", "n_total")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact interpolated quantiles (position ``(n - 1) p``) per group, one column per entry of ``probs``.

    ``bounded=True`` states that a group has few distinct values (the species of one unit) and takes Spark's exact
    ``percentile``. Otherwise the ranges that hold a wanted position, two for each quantile of a group at most, are put in
    order and the others are only counted."""
    by = list(by)
    if bounded:
        found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, [float(p) for p in probs.values()]).alias("_q"))
        return found.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    stored, ranges = value_ranges(df, by, value)
    at = {n: (F.col("n_total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    ends = F.array(*[f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil)])
    wanted = ranges.withColumn("_ends", ends).where(F.exists("_ends", lambda r: (r >= F.col("_offset")) & (r < F.col("_offset") + F.col("_in"))))
    rows = _ordered(stored, wanted, by, value).where(F.exists("_ends", lambda r: (r >= F.col("n_below")) & (r < F.col("n_below") + F.col("cnt"))))

    def value_at(rank):
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("cnt")), F.col(value)))

    aggs = []
    for name, h in at.items():
        aggs += [value_at(F.floor(h)).alias(f"_lo_{name}"), value_at(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_f_{name}")]
    return rows.groupBy(*by).agg(*aggs).select(
        *by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs]
    )


def median_abs_deviation(df: DataFrame, by: Sequence[str], value: str, name: str = "mad") -> DataFrame:
    """1.4826 x median of |x - median(x)| per group.

    The medians (one row per group) are checkpointed before the deviations are formed, so that the second quantile does
    not carry the plan of the first in each of its branches.
    """
    med = checkpoint(exact_quantiles(df, by, value, {"_median": 0.5}))
    dev = attach(df.where(F.col(value).isNotNull()).select(*by, value), med, by, "inner").select(
        *by, F.abs(F.col(value) - F.col("_median")).alias("_dev")
    )
    return exact_quantiles(dev, by, "_dev", {"_mad": 0.5}).select(*by, (F.col("_mad") * MAD_SCALE).alias(name))


def mad_filter(df: DataFrame, col: str, k: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Keep rows with |x| <= k x mad(x). The comparison is with zero, not with the median; NULL rows are dropped."""
    mad = checkpoint(median_abs_deviation(df, by, col, "_mad"))
    return attach(df, mad, by, "inner").where(F.abs(F.col(col)) <= F.lit(k) * F.col("_mad")).drop("_mad")


def min_rank(df: DataFrame, part: Sequence[str], col: str, name: str = "rank", bounded: bool = True) -> DataFrame:
    """Ascending rank with ties at the lowest position. NULLs get NULL.

    ``bounded=True`` ranks each group in one window; the caller states that a group is bounded (species of one
    unit). ``bounded=False`` takes the stored ranges, for groups of any size.
    """
    if bounded:
        w = Window.partitionBy(*part, F.col(col).isNull()).orderBy(col)
        return df.withColumn(name, F.when(F.col(col).isNotNull(), F.rank().over(w)))
    pos = value_positions(df, part, col).select(
        *part, col, (F.col("n_below") + 1).cast("int").alias(name)
    )
    return df.join(pos, [*part, col], "left")


def rescaled_rank(
    df: DataFrame,
    part: Sequence[str],
    col: str,
    zero: str = "rank",
    rank_name: str = "rank",
    rel_name: str = "rel_rank",
) -> DataFrame:
    """Rank within a unit and the rank mapped to [0, 1], under one of four readings of absent (zero) species.

    * ``rank``: zeros are ranked like any value;
    * ``null_min``: as ``rank``, then rows at rank 1 get no relative rank and the others are rescaled among themselves;
    * ``skip``: zeros are left out of the ranking and get relative rank 0;
    * ``shift``: all rows are ranked, zeros get rank 0, and the lowest present species is moved to rank 1; the
      relative rank is rank / largest rank.

    A group is the species of one unit, so a window per unit is bounded by the species pool.
    """
    w = Window.partitionBy(*part)
    if zero == "rank":
        out = min_rank(df, part, col, rank_name)
        r = F.col(rank_name)
        return out.withColumn(rel_name, rescale(r, F.min(r).over(w), F.max(r).over(w)))
    if zero == "null_min":
        out = min_rank(df, part, col, rank_name)
        above = F.when(F.col(rank_name) > 1, F.col(rank_name))
        return out.withColumn(rel_name, rescale(above, F.min(above).over(w), F.max(above).over(w)))
    if zero == "skip":
        out = df.withColumn("_present", F.when(F.col(col) != 0, F.col(col)))
        out = min_rank(out, part, "_present", rank_name).drop("_present")
        r = F.col(rank_name)
        return out.withColumn(rel_name, F.coalesce(rescale(r, F.min(r).over(w), F.max(r).over(w)), F.lit(0.0)))
    if zero == "shift":
        return shifted_rank(df, part, col, col, rank_name, rel_name)
    raise ValueError(f"unknown zero treatment: {zero}")


def shifted_rank(
    df: DataFrame, part: Sequence[str], col: str, absent_where_zero: str, rank_name: str, rel_name: str
) -> DataFrame:
    """Rank with absent species at 0 and the lowest present one at 1; relative rank = rank / largest rank.

    Absence is judged by ``absent_where_zero``, which may differ from the ranked column (e.g. rank biomass, but a
    species is absent when its abundance is zero). NULL values rank last, as they are unknown rather than small.
    """
    w = Window.partitionBy(*part)
    ordered = Window.partitionBy(*part).orderBy(F.col(col).asc_nulls_last())
    raw = F.when(F.col(absent_where_zero) == 0, F.lit(0)).otherwise(F.rank().over(ordered))
    out = df.withColumn("_raw", raw)
    lowest = F.min(F.when(F.col("_raw") != 0, F.col("_raw"))).over(w)
    out = out.withColumn("_lowest", lowest)
    out = out.withColumn(
        rank_name, F.when(F.col("_raw") == 0, F.lit(0)).otherwise(F.col("_raw") - F.col("_lowest") + 1)
    ).drop("_raw", "_lowest")
    return out.withColumn(rel_name, safe_div(F.col(rank_name), F.max(rank_name).over(w)))


def quantile_group(
    df: DataFrame, part: Sequence[str], col: str, n: int = 3, tie: Sequence[str] = (), name: str = "group"
) -> DataFrame:
    """n near-equal groups by ascending value; NULLs get no group, ties are ordered by ``tie``.

    Groups here are the species of a site, hence bounded by its species pool.
    """
    w = Window.partitionBy(*part, F.col(col).isNull()).orderBy(col, *tie)
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.ntile(n).over(w)))


def quantile_class(
    df: DataFrame,
    part: Sequence[str],
    col: str,
    probs: Sequence[float] = (0.2, 0.8),
    labels: Sequence[str] = ("Rare", "Subordinate", "Dominant"),
    min_distinct: int = 3,
    name: str = "class",
) -> DataFrame:
    """Class by the unit's own quantiles, lowest value included; NULL where the unit has too few distinct values.

    A unit is a plot or a survey, so its values are few: quantiles and their number come from one window over it."""
    w = Window.partitionBy(*part)
    q = F.percentile(col, [float(p) for p in probs]).over(w)
    out = df.withColumn("_q", q).withColumn("_nd", F.size(F.collect_set(col).over(w)))
    out = out.withColumns({f"_q{i}": F.col("_q")[i] for i in range(len(probs))}).drop("_q")
    label = F.when(F.col(col).isNull() | (F.col("_nd") < min_distinct), F.lit(None).cast("string"))
    for i, lab in enumerate(labels[:-1]):
        label = label.when(F.col(col) <= F.col(f"_q{i}"), F.lit(lab))
    label = label.otherwise(F.lit(labels[-1]))
    return out.withColumn(name, label).drop("_nd", *[f"_q{i}" for i in range(len(probs))])


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows, repeatable for a seed whatever the partitioning: the n smallest hashes of the row key."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")
