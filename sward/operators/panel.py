"""Panel operators: completion, baselines, differences, losses, runs.

Windows here are over one species in one plot (bounded by the number of surveys) or one plot (bounded by surveys x
species). Anything wider - a site, a study, the whole table - is aggregated and joined back instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import as_col, is_true, na_agg, positive_ln, presence, safe_div
from sward.operators.order import attach_counted, meet
from sward.session import settle


def relative_abundance(
    df: DataFrame,
    unit: Sequence[str],
    value: str,
    scale: float = 1.0,
    na_rm: bool = True,
    live: Column | None = None,
    total: str = "total",
    rel: str = "rel",
) -> DataFrame:
    """Unit total and each species' share of it. With ``live`` only rows meeting it enter the total, and the share of
    the others is 0. A share that cannot be formed (no total) is 0, unless ``na_rm`` is false."""
    w = Window.partitionBy(*unit)
    v = F.when(live, F.col(value)).otherwise(F.lit(0.0)) if live is not None else F.col(value)
    out = df.withColumn(total, na_agg(F.sum, v, True).over(w)) if na_rm else df.withColumn(
        total, F.when(F.count(F.lit(1)).over(w) == F.count(v).over(w), F.sum(v).over(w))
    )
    share = safe_div(v, total) * F.lit(float(scale))
    return out.withColumn(rel, F.coalesce(share, F.lit(0.0)) if na_rm else share)


def baseline(
    df: DataFrame, keys: Sequence[str], time: str, value: str, t0: int = 0, default=None, name: str | None = None
) -> DataFrame:
    """The value at the baseline time on every row of the series; ``default`` where the series has none."""
    v = F.max(F.when(F.col(time) == t0, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(name or f"{value}_t0", v if default is None else F.coalesce(v, F.lit(default)))


def group_total(
    df: DataFrame, part: Sequence[str], value: str, cond: Column | None = None, name: str = "group_total"
) -> DataFrame:
    """Total of a value over the group on each of its rows, of all rows or of those meeting a condition (0 if none do).
    For groups bounded by the data model, such as a plot; wider ones are aggregated and joined."""
    v = F.col(value) if cond is None else F.when(cond, F.col(value))
    return df.withColumn(name, F.coalesce(F.sum(v).over(Window.partitionBy(*part)), F.lit(0.0)))


BLOCK = 64


def species_blocks(df: DataFrame, group: Sequence[str], species: str, block: int = BLOCK) -> DataFrame:
    """The species of each group in blocks of about ``block``: (group, ``_block``, ``_blocks``, ``_list``), stored. ``_head``
    marks one block of each group.

    A species falls into a block by its hash, so blocks of a group, however many species it has, are lists of bounded
    size that can be looked up apart. A NULL species is a species like any other.
    """
    pool = df.select(*group, species).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    pool = pool.withColumn("_blocks", F.ceil(n / F.lit(block)).cast("int"))
    pool = pool.withColumn("_block", F.pmod(F.xxhash64(species), F.col("_blocks")).cast("int"))
    lists = pool.groupBy(*group, "_block", "_blocks").agg(F.collect_list(F.struct(species)).alias("_list"))
    return settle(lists.withColumn("_head", F.lag("_block").over(Window.partitionBy(*group).orderBy("_block")).isNull()), "species_blocks")


def complete_panel(
    df: DataFrame,
    group: Sequence[str],
    unit_time: Sequence[str],
    species: str,
    value: str,
    fill: float = 0.0,
    cluster_by: Sequence[str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Every survey of a group x every species ever seen in that group, absent species at ``fill``, plus ``pa``.

    Duplicate keys are summed first. The grid is never built row by row: the species present in a survey are folded into
    one row for each block of about ``block`` species of its group; a row also stands for the blocks up to the next one that
    has any, and only the last step, inside the scan of those rows, turns blocks into species. The completed panel, the
    large result, is not shuffled, and looking a species up costs the same in a survey of any size. The same plan holds at
    every size: the stored lists are broadcast when they are small, as measured, and otherwise joined by (group, block),
    which spreads the species of a survey and of a hot group over tasks and splits skewed parts at run time.

    NULL species and NULL keys are values like others; a NULL value counts as missing and is filled. Of rows that are stored
    by a subset of the keys nothing moves. ``cluster_by`` (such a subset, e.g. site and plot) places other rows so that
    later windows by any superset of those columns need no further shuffle after the broadcast.
    """
    group, unit_time = list(group), list(unit_time)
    if not unit_time:
        raise ValueError("unit_time must name at least one column")
    survey = [*group, *unit_time]
    lists = species_blocks(df, group, species, block)
    sizes = lists.where("_head").select(*group, "_blocks")
    placed = df.select(*survey, species, F.col(value).alias("_value"))
    placed = placed.repartition(*cluster_by) if cluster_by else placed
    own = F.pmod(F.xxhash64(species), F.col("_blocks")).cast("int").alias("_own")
    facts = meet(placed, sizes, group).groupBy(*survey, species, "_blocks", own).agg(F.sum("_value").alias("_value"))
    folded = facts.groupBy(*survey, "_blocks", "_own").agg(
        F.map_from_entries(F.collect_list(F.when(F.col(species).isNotNull(), F.struct(species, "_value")))).alias("_present"),
        F.max(F.when(F.col(species).isNull(), F.col("_value"))).alias("_unnamed"),
    )
    within = Window.partitionBy(*survey).orderBy("_own")
    start = F.when(F.lag("_own").over(within).isNull(), F.lit(0)).otherwise(F.col("_own"))
    stop = F.coalesce(F.lead("_own").over(within), F.col("_blocks")) - 1
    spans = folded.select(*survey, "_own", "_present", "_unnamed", F.sequence(start, stop).alias("_span"))
    blocks = spans.select(*survey, "_own", "_present", "_unnamed", F.explode("_span").alias("_block"))
    grid = meet(blocks, lists.drop("_blocks", "_head"), [*group, "_block"])
    out = grid.select(*survey, (F.col("_own") == F.col("_block")).alias("_here"), "_present", "_unnamed", F.explode("_list").alias("_one"))
    name = F.col(f"_one.{species}")
    found = F.when(F.col("_here"), F.when(name.isNull(), F.col("_unnamed")).otherwise(F.try_element_at("_present", name)))
    filled = F.coalesce(found, F.lit(float(fill)))
    return out.select(*survey, name.alias(species), filled.alias(value)).withColumn("pa", presence(value))


def keep_groups(
    df: DataFrame,
    keys: Sequence[str],
    min_distinct: Mapping[str, int] | None = None,
    nonzero: str | None = None,
    levels: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows of groups that pass: at least k distinct values of a column, a non-zero total, or exactly k levels.

    Each condition is an aggregate of one row per group, stored with the number of rows of the group, so that rows of a
    group that holds much of the table stay where they are."""
    keys = list(keys)
    # one pass per distinct column keeps each distinct count a plain two-step aggregate
    tests = [F.countDistinct(c) >= k for c, k in (min_distinct or {}).items()] + [F.countDistinct(c) == k for c, k in (levels or {}).items()]
    if nonzero:
        tests.append(F.sum(nonzero) != 0)
    out = df
    for test in tests:
        per = df.groupBy(*keys).agg(test.alias("_ok"), F.count(F.lit(1)).alias("_rows"))
        out = attach_counted(out, settle(per, "group_tests"), keys, "_rows").where("_ok").drop("_ok")
    return out


def drop_bad_records(df: DataFrame, predicate: Column) -> DataFrame:
    """Quarantine: drop rows known to be bad. A predicate that cannot be decided keeps the row."""
    return df.where(~is_true(predicate))


def latest(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows at the last time of their group (ties kept)."""
    last = df.groupBy(*keys).agg(F.max(time).alias(time))
    return df.join(last, [*keys, time], "left_semi")


def unit_table(df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str]) -> DataFrame:
    """One row per unit and time, for columns that are constant on the species rows of a survey."""
    return df.groupBy(*unit, time).agg(*[F.max(c).alias(c) for c in cols])


def first_diff(
    df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str], one_row: bool = False
) -> DataFrame:
    """Change since the previous survey of the unit: ``lag_<col>`` and ``d_<col>``, NULL at the first survey.

    ``one_row`` states that the frame already holds one row per unit and time; its other columns are then kept.
    """
    w = Window.partitionBy(*unit).orderBy(time)
    out = df if one_row else unit_table(df, unit, time, cols)
    out = out.withColumns({f"lag_{c}": F.lag(c).over(w) for c in cols})
    return out.withColumns({f"d_{c}": F.col(c) - F.col(f"lag_{c}") for c in cols})


def log_ratio_change(df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str]) -> DataFrame:
    """ln(x + 1) - ln(previous x + 1) as ``lr_<col>``."""
    w = Window.partitionBy(*unit).orderBy(time)
    out = unit_table(df, unit, time, cols)
    return out.withColumns({f"lr_{c}": F.log1p(c) - F.log1p(F.lag(c).over(w)) for c in cols})


def losses(
    df: DataFrame, keys: Sequence[str], time: str, value: str, at_risk_only: bool = True
) -> DataFrame:
    """Loss transition of a completed series: absent now, present at the previous survey.

    ``lost`` is NULL at the first survey. With ``at_risk_only`` only rows present at the previous survey remain.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    out = df.withColumn("lag_value", F.lag(value).over(w))
    out = out.withColumn(
        "lost",
        F.when(F.col("lag_value").isNotNull(), ((F.col(value) == 0) & (F.col("lag_value") != 0)).cast("int")),
    )
    return out.where(F.col("lag_value") != 0) if at_risk_only else out


def absence_runs(
    df: DataFrame, keys: Sequence[str], time: str, pa: str = "pa", longest: bool = False
) -> DataFrame:
    """Length so far of the current run of absences (0 where present); with ``longest`` its maximum per series."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(pa).over(w)
    out = df.withColumn("_island", island)
    in_island = Window.partitionBy(*keys, "_island").orderBy(time)
    # the island opens with the presence row, except the first one, which has none
    n_absent = F.sum((F.col(pa) == 0).cast("int")).over(in_island)
    out = out.withColumn("cons_abs", F.when(F.col(pa) == 0, n_absent).otherwise(F.lit(0)).cast("int")).drop("_island")
    return out.groupBy(*keys).agg(F.max("cons_abs").alias("cons_abs_max")) if longest else out


def years_since_start(
    df: DataFrame, keys: Sequence[str], year: str, base: int = 0, name: str = "std_year", bounded: bool = False
) -> DataFrame:
    """Years since the first year of the group, counted from ``base``. ``bounded=True`` states that a group is bounded by the
    data model (one series, one plot) and takes a window; other groups are aggregated and attached with heavy ones apart."""
    if bounded:
        return df.withColumn(name, F.col(year) - F.min(year).over(Window.partitionBy(*keys)) + F.lit(base))
    start = df.groupBy(*keys).agg(F.min(year).alias("_start"), F.count(F.lit(1)).alias("_rows"))
    out = attach_counted(df, settle(start, "starts"), keys, "_rows")
    return out.withColumn(name, F.col(year) - F.col("_start") + F.lit(base)).drop("_start")


def first_event(df: DataFrame, unit: Sequence[str], time: str, flag: str | Column) -> DataFrame:
    """The first time the flag holds in a unit: one row per unit, however many rows share that time."""
    return df.where(is_true(as_col(flag))).groupBy(*unit).agg(F.min(time).alias("first_time"))


def before_after(df: DataFrame, events: DataFrame, unit: Sequence[str], time: str) -> DataFrame:
    """Rows of units with an event, flagged ``after_first`` when strictly later than it."""
    return df.join(events, list(unit)).withColumn("after_first", F.col(time) > F.col("first_time"))


def last_k_active(
    df: DataFrame, part: Sequence[str], time: str, value: str, k: int = 3, name: str = "active_last_k"
) -> DataFrame:
    """Whether the series has any non-zero value in its last k surveys, on every row."""
    newest = Window.partitionBy(*part).orderBy(F.col(time).desc())
    out = df.withColumn("_rn", F.row_number().over(newest))
    v = F.sum(F.when(F.col("_rn") <= k, F.col(value))).over(Window.partitionBy(*part)) > 0
    return out.withColumn(name, v).drop("_rn")


def ratio_to(
    df: DataFrame, part: Sequence[str], time: str, value: str, ref: str = "max", name: str = "ratio"
) -> DataFrame:
    """Value relative to its own series: largest (``max``), first non-zero (``first``), first survey (``t0``) or mean of
    the first three surveys (``first3``, NULL for shorter series)."""
    whole = Window.partitionBy(*part)
    ordered = whole.orderBy(time)
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if ref == "max":
        return df.withColumn(name, safe_div(value, F.max(value).over(whole)))
    if ref == "first":
        nonzero = F.when(F.col(value) != 0, F.col(value))
        return df.withColumn(name, safe_div(value, F.first(nonzero, ignorenulls=True).over(full)))
    if ref == "t0":
        return df.withColumn(name, safe_div(value, F.first(value).over(full)))
    if ref == "first3":
        out = df.withColumn("_rn", F.row_number().over(ordered))
        out = out.withColumn("_m", first_k_mean(value, "_rn", whole, 3))
        return out.withColumn(name, safe_div(value, "_m")).drop("_rn", "_m")
    raise ValueError(f"unknown reference: {ref}")


def first_k_mean(value: str, rn: str, whole, k: int = 3) -> Column:
    """Mean of the first k surveys of a series; NULL when fewer than k exist or one of them is NULL."""
    v = F.when(F.col(rn) <= k, F.col(value))
    return F.when(F.count(v).over(whole) == k, F.avg(v).over(whole))


def z_score(df: DataFrame, part: Sequence[str], col: str, log: bool = False, name: str = "z") -> DataFrame:
    """(x - mean) / sd of the series; with ``log`` of ln x over the surveys where the species is present."""
    w = Window.partitionBy(*part)
    x = positive_ln(col) if log else F.col(col)
    out = df.withColumn("_x", x)
    return out.withColumn(name, safe_div(F.col("_x") - F.avg("_x").over(w), F.stddev_samp("_x").over(w))).drop("_x")


def dup_audit(
    df: DataFrame, keys: Sequence[str], year: str, subplot: str, n_records: Column | None = None
) -> DataFrame:
    """Per series: years seen, records stored and subplots used. More records than years means duplicates.

    Records are first counted per (series, year, subplot); the years and subplots of one series are then short sets.
    """
    n = F.count(F.lit(1)) if n_records is None else F.sum(n_records)
    cells = df.groupBy(*keys, year, subplot).agg(n.alias("n"))
    return cells.groupBy(*keys).agg(
        F.size(F.collect_set(year)).alias("n_years"),
        F.sum("n").alias("n_records"),
        F.size(F.collect_set(subplot)).alias("n_subplots"),
    )
