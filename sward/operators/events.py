"""Loss of dominant species: which plots, when, and biomass before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.functions.semantics import positive_ln
from sward.operators.panel import before_after, first_event

PLOT = ["site_code", "plot"]


def surveys(cover: DataFrame) -> DataFrame:
    return cover.select(*PLOT, "year_trt", "trt").distinct()


def dominant_losses(cover: DataFrame, grouping: str = "rel_class", label: str = "Dominant") -> DataFrame:
    """(plot, survey, species) where a dominant species of the plot is missing.

    Each dominant species of a plot carries the short set of surveys it was seen in; the surveys of its plot that are
    not in the set are its losses. Only per-plot and per-species rows are joined, on the plot.
    """
    seen = cover.groupBy(*PLOT, "Taxon").agg(
        F.max((F.col(grouping) == label).cast("int")).alias("_dom"),
        F.collect_set(F.when(F.col("max_cover") > 0, F.col("year_trt"))).alias("_seen"),
    )
    times = cover.groupBy(*PLOT).agg(F.collect_set("year_trt").alias("_times"))
    return (
        seen.where(F.col("_dom") == 1)
        .join(times, PLOT)
        .select(*PLOT, F.explode(F.array_except("_times", "_seen")).alias("year_trt"), "Taxon")
    )


def plot_flags(cover: DataFrame, grouping: str = "rel_class", label: str = "Dominant") -> DataFrame:
    """Per plot with a dominant species: how many it has and whether it ever misses one."""
    dominant = cover.where(F.col(grouping) == label).select(*PLOT, "Taxon").distinct()
    n_dom = dominant.groupBy(*PLOT).agg(F.count(F.lit(1)).alias("n_dominant"))
    lost = dominant_losses(cover, grouping, label).groupBy(*PLOT).agg(F.count(F.lit(1)).alias("n_losses"))
    return (
        n_dom.join(lost, PLOT, "left")
        .withColumn("n_losses", F.coalesce("n_losses", F.lit(0)))
        .withColumn("dom_lost_plot", F.col("n_losses") > 0)
    )


def first_losses(cover: DataFrame, grouping: str = "rel_class", label: str = "Dominant") -> DataFrame:
    """First survey at which a plot misses a dominant species: one row per plot, also when several go at once."""
    return first_event(dominant_losses(cover, grouping, label), PLOT, "year_trt", F.lit(True))


def before_after_loss(
    cover: DataFrame, plot_years: DataFrame, grouping: str = "rel_class", label: str = "Dominant"
) -> DataFrame:
    """Plot-years of plots that lose a dominant species, before or after their first loss, with the live mass and the
    number of classed species rows each plot-year stands for."""
    n_sp = (
        cover.where(F.col(grouping).isNotNull())
        .select(*PLOT, "Taxon")
        .distinct()
        .groupBy(*PLOT)
        .agg(F.count(F.lit(1)).alias("n_species"))
    )
    rows = surveys(cover).join(plot_years.select(*PLOT, "year_trt", "live_mass"), [*PLOT, "year_trt"], "left")
    return (
        before_after(rows, first_losses(cover, grouping, label), PLOT, "year_trt")
        .where(F.col("live_mass").isNotNull())
        .join(n_sp, PLOT)
    )


def biomass_by_loss(rows: DataFrame) -> DataFrame:
    """Sum of log biomass over species rows before and after the first loss."""
    return rows.groupBy("after_first").agg(
        F.sum(positive_ln("live_mass") * F.col("n_species")).alias("sum_log_mass"),
        F.sum("n_species").alias("n_rows"),
    )
