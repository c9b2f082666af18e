"""Frequency, dominance and rarity classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.functions.semantics import (
    CUTS_STANDARD,
    CUTS_WIDE_DOMINANT,
    CUTS_WIDE_RARE,
    cut_class,
    non_rare,
    safe_div,
)
from sward.operators.order import quantile_group
from sward.operators.panel import baseline, relative_abundance

SPECIES_KEY = ["site_code", "plot", "Taxon"]


def live_cover(cover: DataFrame, cluster: bool = True) -> DataFrame:
    """Live rows with the plot-year total and relative cover. One shuffle by (site, plot) serves every later window and
    grouping by plot, plot-year or plot-species."""
    live = cover.where(F.col("live") == 1)
    if cluster:
        live = live.repartition("site_code", "plot")
    return relative_abundance(
        live, ["site_code", "plot", "year"], "max_cover", total="total_cover", rel="rel_cover"
    )


def rel_freq_space(
    df: DataFrame,
    site: str = "site_code",
    plot: str = "plot",
    species: str = "Taxon",
    time: str = "year_trt",
    denominator: str = "distinct",
) -> DataFrame:
    """Share of a site's baseline plots in which a species occurs, per (site, species) of the whole panel.

    A species never seen at the baseline has frequency 0. ``denominator="max"`` divides by the largest plot number
    instead of the number of distinct plots. Plots are made distinct before they are counted, so that a site holding
    most plots is counted in parallel.
    """
    t0 = F.col(time) == 0
    base = df.where(t0)
    per_species = base.select(site, species, plot).distinct().groupBy(site, species).agg(F.count(F.lit(1)).alias("n_plots_sp"))
    n_plots = F.max(plot) if denominator == "max" else F.count(F.lit(1))
    per_site = base.select(site, plot).distinct().groupBy(site).agg(n_plots.cast("long").alias("n_plots"))
    pool = df.select(site, species).distinct()
    return (
        pool.join(per_species, [site, species], "left")
        .join(per_site, [site], "left")
        .withColumn("n_plots_sp", F.coalesce("n_plots_sp", F.lit(0)))
        .withColumn("n_plots", F.coalesce("n_plots", F.lit(0)))
        .withColumn("rel_freq", safe_div("n_plots_sp", "n_plots"))
    )


def with_dominance(
    live: DataFrame, freq: DataFrame, keys: Sequence[str] = SPECIES_KEY, cuts: Sequence[float] = CUTS_STANDARD
) -> DataFrame:
    """Species rows with baseline share, frequency, dominance index and its class."""
    out = baseline(live, keys, "year_trt", "rel_cover", name="rel_t0")
    out = out.join(freq.select("site_code", "Taxon", "rel_freq"), ["site_code", "Taxon"], "left")
    out = out.withColumn("di", (F.col("rel_t0") + F.col("rel_freq")) / 2)
    return out.withColumn("di_class", cut_class("di", cuts))


def with_class_systems(df: DataFrame) -> DataFrame:
    """All class systems: dominance index, baseline share and frequency, each with its two cut sets."""
    return df.withColumns(
        {
            "di_class": cut_class("di", CUTS_STANDARD),
            "di_class2": cut_class("di", CUTS_WIDE_DOMINANT),
            "rel_class": cut_class("rel_t0", CUTS_STANDARD),
            "rel_class2": cut_class("rel_t0", CUTS_WIDE_RARE),
            "freq_class": cut_class("rel_freq", CUTS_STANDARD),
            "freq_class2": cut_class("rel_freq", CUTS_WIDE_RARE),
        }
    )


def enriched_cover(cover: DataFrame, freq: DataFrame | None = None, cluster: bool = True) -> DataFrame:
    """Live cover with shares, baseline, frequency, dominance index and every class system.

    ``freq`` is the table of :func:`rel_freq_space`, if it exists already; ``cluster=False`` if ``cover`` is stored by
    plot."""
    live = live_cover(cover, cluster)
    if freq is None:
        freq = rel_freq_space(cover.where(F.col("live") == 1))
    return with_class_systems(with_dominance(live, freq))


def dominance_index(cover: DataFrame, cuts: Sequence[float] = CUTS_STANDARD) -> DataFrame:
    """One row per (site, plot, species): baseline share, frequency, dominance index and class.

    Species rows are reduced to one per plot first; site frequencies are counted from that same reduced table, so the
    records are read and shuffled once.
    """
    sp = live_cover(cover).groupBy(*SPECIES_KEY).agg(
        F.max(F.when(F.col("year_trt") == 0, F.col("rel_cover"))).alias("rel_t0")
    )
    n_sp = sp.groupBy("site_code", "Taxon").agg(F.count("rel_t0").alias("_n_sp"))
    n_plots = (
        sp.where(F.col("rel_t0").isNotNull())
        .select("site_code", "plot")
        .distinct()
        .groupBy("site_code")
        .agg(F.count(F.lit(1)).alias("_n_plots"))
    )
    freq = n_sp.join(n_plots, "site_code", "left").select(
        "site_code", "Taxon", safe_div("_n_sp", "_n_plots").alias("rel_freq")
    )
    out = sp.join(freq, ["site_code", "Taxon"]).withColumn("di", (F.col("rel_t0") + F.col("rel_freq")) / 2)
    return out.withColumn("di_class", cut_class("di", cuts))


def di_over_time(live: DataFrame) -> DataFrame:
    """Dominance over time per (site, plot, species): (mean share over the surveys it is in + share of years it is in) / 2.

    ``live`` holds one row per plot, year and species with ``rel_cover``.
    """
    years = live.select("site_code", "plot", "year").distinct().groupBy("site_code", "plot").agg(
        F.count(F.lit(1)).alias("tot_years")
    )
    sp = live.groupBy(*SPECIES_KEY).agg(
        F.avg("rel_cover").alias("mean_rel"), F.countDistinct("year").alias("n_years")
    )
    return (
        sp.join(years, ["site_code", "plot"])
        .withColumn("rel_freq_time", safe_div("n_years", "tot_years"))
        .withColumn("di_time", (F.col("mean_rel") + F.col("rel_freq_time")) / 2)
    )


def site_species_metrics(live: DataFrame, per_cent: bool = True) -> DataFrame:
    """Baseline metrics per (site, species): mean and largest share over plots, plots occupied, frequency, and the
    modified importance index (share + frequency) / 2, also with the plain number of plots in place of the frequency."""
    base = live.where(F.col("year_trt") == 0)
    scale = 100.0 if per_cent else 1.0
    m = base.groupBy("site_code", "Taxon").agg(
        (F.avg("rel_cover") * scale).alias("mean_pt_abundance"),
        (F.max("rel_cover") * scale).alias("max_pt_abundance"),
    )
    f = rel_freq_space(live).select("site_code", "Taxon", "n_plots_sp", "n_plots", "rel_freq")
    share = F.col("mean_pt_abundance") / scale
    return m.join(f, ["site_code", "Taxon"]).withColumns(
        {"abund_metric": (share + F.col("rel_freq")) / 2, "abund_metric_count": (share + F.col("n_plots_sp")) / 2}
    )


def dominance_groups(metrics: DataFrame, n: int = 3) -> DataFrame:
    """Species of each site split into n groups by importance index and by mean baseline abundance."""
    out = quantile_group(metrics, ["site_code"], "abund_metric", n, ["Taxon"], "di_group")
    return quantile_group(out, ["site_code"], "mean_pt_abundance", n, ["Taxon"], "abund_group")


def status_label(df: DataFrame) -> DataFrame:
    """Joint label of dominance class and provenance, and the non-rare flag."""
    return df.withColumn(
        "status", F.concat_ws("_", F.coalesce("di_class", F.lit("NA")), F.coalesce("local_provenance", F.lit("NA")))
    ).withColumn("non_rare", non_rare("di_class"))

