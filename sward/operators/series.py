"""Species series of a study: completed panel, ranks, relative values, losses, richness and biomass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import cut_class, positive_ln, rescale, safe_div
from sward.operators.order import min_rank, shifted_rank
from sward.operators.panel import complete_panel, first_k_mean, years_since_start
from sward.session import settle

SERIES_KEY = ["STUDY_ID", "MEASURE", "GENUS_SPECIES"]
UNIT = ["STUDY_ID", "MEASURE", "YEAR"]


def series_panel(long: DataFrame) -> DataFrame:
    """Values summed over samples and completed with zeros for every species of the study and measure."""
    return complete_panel(
        long.withColumnRenamed("VALUE", "SUM_VALUE"), ["STUDY_ID", "MEASURE"], ["YEAR"], "GENUS_SPECIES", "SUM_VALUE"
    ).drop("pa")


def community_ranks(panel: DataFrame) -> DataFrame:
    """Total, share, rank and relative ranks of each species in its study-year.

    The window holds one row per species of a study-year. Ranking the value gives the ranks of the share, as every share
    in the window has the same denominator.
    """
    w = Window.partitionBy(*UNIT)
    out = panel.withColumn("TOTAL_VALUE", F.sum("SUM_VALUE").over(w))
    out = out.withColumn("REL_VALUE_COMM", safe_div("SUM_VALUE", "TOTAL_VALUE"))
    out = min_rank(out, UNIT, "SUM_VALUE", "ABS_RANK")
    r = F.col("ABS_RANK")
    above = F.when(r > 1, r)
    return out.withColumn("REL_RANK_ALL", rescale(r, F.min(r).over(w), F.max(r).over(w))).withColumn(
        "REL_RANK_TIMEPOINT", rescale(above, F.min(above).over(w), F.max(above).over(w))
    )


def species_panel_metrics(long: DataFrame) -> DataFrame:
    """The full set of per-series measures: community shares and ranks, values relative to the series' own first, largest
    and early values, z-scores, variation of the log value, and activity in the last three years.

    Logs are taken over the years a species is present; an early mean needs three years.
    """
    out = community_ranks(series_panel(long))
    whole = Window.partitionBy(*SERIES_KEY)
    ordered = whole.orderBy("YEAR")
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = whole.orderBy(F.col("YEAR").desc())
    value = F.col("SUM_VALUE")
    nonzero = F.when(value != 0, value)
    out = out.withColumns(
        {
            "_rn": F.row_number().over(ordered),
            "LOG_SUM_VALUE": positive_ln("SUM_VALUE"),
        }
    ).withColumn("_rn_back", F.count(F.lit(1)).over(whole) - F.col("_rn") + 1)
    log = F.col("LOG_SUM_VALUE")
    out = out.withColumns(
        {
            "REL_VALUE_TO_MAX": safe_div(value, F.max(value).over(whole)),
            "REL_VALUE_TO_FIRST": safe_div(value, F.first(nonzero, ignorenulls=True).over(full)),
            "REL_VALUE_TO_T0": safe_div(value, F.first(value).over(full)),
            "REL_VALUE_TO_T0_T3": safe_div(value, first_k_mean("SUM_VALUE", "_rn", whole)),
            "REL_RANK_T0": F.first("REL_RANK_TIMEPOINT").over(full),
            "REL_RANK_T1": F.nth_value("REL_RANK_TIMEPOINT", 2).over(full),
            "REL_RANK_MEAN_T0_TO_T3": first_k_mean("REL_RANK_TIMEPOINT", "_rn", whole),
            "Z_TRANS_VALUE": safe_div(value - F.avg(value).over(whole), F.stddev_samp(value).over(whole)),
            "Z_TRANS_LOG_VALUE": safe_div(log - F.avg(log).over(whole), F.stddev_samp(log).over(whole)),
            "CV_LOG_VALUE": safe_div(F.stddev_samp(log).over(whole), F.avg(log).over(whole)),
            "REL_VALUE_COMM_T0": F.first("REL_VALUE_COMM").over(full),
            "REL_VALUE_COMM_T0_T3": first_k_mean("REL_VALUE_COMM", "_rn", whole),
            "N_YEARS": F.count(F.lit(1)).over(whole),
            "_SPECIES_TOTAL": F.sum(value).over(whole),
            "ACTIVE_FINAL_3_YRS": F.coalesce(
                F.sum(F.when(F.col("_rn_back") <= 3, value)).over(whole) > 0, F.lit(False)
            ),
        }
    )
    # study totals last and by join: a study, unlike a species in a study, is not a bounded group
    totals = (
        long.groupBy(*SERIES_KEY)
        .agg(F.sum("VALUE").alias("_t"))
        .groupBy("STUDY_ID", "MEASURE")
        .agg(F.sum("_t").alias("WHOLE_SERIES_TOTAL"), F.count(F.lit(1)).alias("NUM_SPECIES"))
    )
    return (
        out.join(settle(totals, "series_totals"), ["STUDY_ID", "MEASURE"])
        .withColumn("WHOLE_SERIES_REL_VALUE", safe_div("_SPECIES_TOTAL", "WHOLE_SERIES_TOTAL"))
        .drop("_rn", "_rn_back", "_SPECIES_TOTAL")
    )


def loss_table(panel: DataFrame, keys=SERIES_KEY, year: str = "YEAR", value: str = "SUM_VALUE") -> DataFrame:
    """Per series, from the years after the first: zeros, loss at the end, fraction missing (over all years)."""
    w = Window.partitionBy(*keys).orderBy(year)
    later = panel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > 1)
    return (
        later.groupBy(*keys)
        .agg(
            (F.count(F.lit(1)) + 1).alias("n_year"),
            F.sum((F.col(value) == 0).cast("int")).alias("n_zeros"),
            (F.max_by(value, year) == 0).cast("int").alias("lost_at_end"),
        )
        .withColumn("frac_missing_after_t0", safe_div("n_zeros", "n_year"))
    )


def loss_summary(panel: DataFrame, keys=SERIES_KEY, year: str = "YEAR", value: str = "SUM_VALUE") -> DataFrame:
    """Loss table of the species present in the first year, next to their first-year row."""
    w = Window.partitionBy(*keys).orderBy(year)
    first = panel.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) & (F.col(value) != 0))
    return (
        first.drop("_rn", year)
        .join(loss_table(panel, keys, year, value), list(keys), "left")
        .withColumn("absent_at_some_point", (F.col("frac_missing_after_t0") != 0).cast("int"))
    )


def community_series(panel: DataFrame, min_years: int = 3) -> DataFrame:
    """Zeros, richness and total per study-year with first differences and log ratios, for series of enough years.

    ``panel`` holds one measure (STUDY_ID, YEAR, GENUS_SPECIES, SUM_VALUE), completed, so the number of years of a series
    is that of its study.
    """
    per_year = panel.groupBy("STUDY_ID", "YEAR").agg(
        F.sum((F.col("SUM_VALUE") == 0).cast("int")).alias("z"),
        F.sum((F.col("SUM_VALUE") != 0).cast("int")).alias("s"),
        F.sum("SUM_VALUE").alias("b"),
    )
    w = Window.partitionBy("STUDY_ID").orderBy("YEAR")  # one row per year of a study
    out = per_year.withColumn("n_years", F.count(F.lit(1)).over(Window.partitionBy("STUDY_ID")))
    out = out.where(F.col("n_years") >= min_years)
    out = out.withColumn("std_year", F.col("YEAR") - F.min("YEAR").over(Window.partitionBy("STUDY_ID")))
    return out.withColumns(
        {
            "ds": F.col("s") - F.lag("s").over(w),
            "db": F.col("b") - F.lag("b").over(w),
            "lr_s": F.log1p("s") - F.log1p(F.lag("s").over(w)),
            "lr_b": F.log1p("b") - F.log1p(F.lag("b").over(w)),
        }
    )


def biomass_cv(series: DataFrame) -> DataFrame:
    """Coefficient of variation of the yearly total per study."""
    return series.groupBy("STUDY_ID").agg(safe_div(F.stddev_samp("b"), F.avg("b")).alias("cv_b"))


def abundance_biomass_ranks(panel: DataFrame, min_years: int = 4, strict: bool = False) -> DataFrame:
    """Abundance, biomass and per-capita biomass ranks of species in studies that recorded both.

    A species with no abundance is absent and has rank 0 whatever the column. ``*_t0`` is the relative rank in the first
    year, ``lag_*`` that of the year before; ``lost`` is absence after a non-zero lagged rank. ``strict`` reproduces a
    variant in which the early mean and the lagged rank are both taken of the first-year rank.
    """
    both = panel.select("STUDY_ID", "MEASURE").distinct().groupBy("STUDY_ID").agg(F.count(F.lit(1)).alias("_n"))
    years = panel.select("STUDY_ID", "YEAR").distinct().groupBy("STUDY_ID").agg(F.count(F.lit(1)).alias("_y"))
    good = both.join(years, "STUDY_ID").where((F.col("_n") == 2) & (F.col("_y") >= min_years)).select("STUDY_ID")
    out = (
        panel.join(settle(good, "two_measure_studies"), "STUDY_ID", "left_semi")
        .groupBy("STUDY_ID", "YEAR", "GENUS_SPECIES")
        .pivot("MEASURE", ["Abundance", "Biomass"])
        .agg(F.first("SUM_VALUE"))
        .withColumn("PER_CAPITA", safe_div("Biomass", "Abundance"))
    )
    unit = ["STUDY_ID", "YEAR"]
    names = {"Abundance": "abund", "Biomass": "biomass", "PER_CAPITA": "percapita"}
    for col, tag in names.items():
        out = shifted_rank(out, unit, col, "Abundance", f"{tag}_rank", f"rel_{tag}_rank")
    w = Window.partitionBy(*unit)
    out = out.withColumns(
        {
            "rel_abund": safe_div("Abundance", F.max("Abundance").over(w)),
            "rel_biomass": safe_div("Biomass", F.max("Biomass").over(w)),
        }
    )
    sp = Window.partitionBy("STUDY_ID", "GENUS_SPECIES")
    ordered = sp.orderBy("YEAR")
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_rn", F.row_number().over(ordered))
    for tag in names.values():
        rel = f"rel_{tag}_rank"
        out = out.withColumn(f"{rel}_t0", F.first(rel).over(full))
        source = f"{rel}_t0" if strict else rel
        out = out.withColumns(
            {f"{rel}_first3": first_k_mean(source, "_rn", sp), f"lag_{rel}": F.lag(source).over(ordered)}
        )
    present = F.sum(F.when((F.col("_rn") <= 3) & (F.col("Abundance") != 0), 1).otherwise(0)).over(sp)
    return out.withColumns(
        {
            "lost": F.when(
                F.col("lag_rel_abund_rank").isNotNull(),
                (F.col("Abundance") == 0) & (F.col("lag_rel_abund_rank") != 0),
            ),
            "present_first3": present == 3,
        }
    ).drop("_rn")


def lost_at_end_by_rank(ranks: DataFrame) -> DataFrame:
    """One row per species series: absent in the last year, next to its first-year relative ranks."""
    return ranks.groupBy("STUDY_ID", "GENUS_SPECIES").agg(
        (F.max_by("Abundance", "YEAR") == 0).cast("int").alias("lost_at_end"),
        F.max("rel_abund_rank_t0").alias("rel_abund_rank_t0"),
        F.max("rel_percapita_rank_t0").alias("rel_percapita_rank_t0"),
    ).where(F.col("rel_percapita_rank_t0").isNotNull())


def standard_years(df: DataFrame, base: int = 0) -> DataFrame:
    return years_since_start(df, ["STUDY_ID"], "YEAR", base)


# Facet edges of the trajectories, lowest edge included.
SHARE_FACETS = (0.0, 0.01, 0.2, 0.5, 1.0)
RANK_FACETS = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)


def facet_labels(edges) -> list[str]:
    return [f"{lo:g} to {hi:g}" for lo, hi in zip(edges, edges[1:])]


def abundance_trajectories(metrics: DataFrame, min_years: int = 9) -> DataFrame:
    """Series present in their first three years and long enough, by years since the study began (from 1), with the facet
    of their early share and of their first rank."""
    rows = metrics.where((F.col("REL_VALUE_COMM_T0_T3") > 0) & (F.col("N_YEARS") >= min_years))
    out = years_since_start(rows, ["STUDY_ID"], "YEAR", base=1, name="YEAR_STD")
    return out.withColumns(
        {
            "share_facet": cut_class("REL_VALUE_COMM_T0_T3", SHARE_FACETS, facet_labels(SHARE_FACETS), True),
            "rank_facet": cut_class("REL_RANK_T0", RANK_FACETS, facet_labels(RANK_FACETS), True),
        }
    )
