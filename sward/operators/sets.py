"""Row sets that loss models are fitted to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sward.operators.effects import next_survey
from sward.operators.order import rescaled_rank

TRTS = ("Control", "N", "NP", "NPK")
PLOT = ["site_code", "plot"]


def baseline_ranks(live: DataFrame) -> DataFrame:
    """Relative rank of each species by baseline share within its plot."""
    base = live.where((F.col("year_trt") == 0) & F.col("rel_cover").isNotNull())
    return rescaled_rank(base, ["site_code", "trt", "plot"], "rel_cover", rel_name="rel_rank_year0").select(
        *PLOT, "trt", "Taxon", "rel_rank_year0"
    )


def lost_at_end_set(live: DataFrame, trts: Sequence[str] = TRTS) -> DataFrame:
    """Baseline species of each plot: absent at the plot's last survey or not, against baseline rank.

    A species is lost when its own last record is older than the plot's last survey; both are windows inside the plot.
    """
    last = F.max("year_trt").over(Window.partitionBy(*PLOT))
    seen = F.max(F.when(F.col("rel_cover") > 0, F.col("year_trt"))).over(Window.partitionBy(*PLOT, "Taxon"))
    rows = live.withColumns({"_last": last, "_seen": seen})
    base = rows.where((F.col("year_trt") == 0) & F.col("rel_cover").isNotNull())
    ranked = rescaled_rank(base, ["site_code", "trt", "plot"], "rel_cover", rel_name="rel_rank_year0")
    return ranked.where(F.col("trt").isin(*trts) & (F.col("_last") > 0)).select(
        *PLOT,
        "trt",
        "Taxon",
        F.col("_last").alias("year_trt"),
        "rel_rank_year0",
        (~F.col("_seen").eqNullSafe(F.col("_last"))).cast("int").alias("lost_at_end"),
    )


def lagged_loss_set(live: DataFrame, trts: Sequence[str] = TRTS) -> DataFrame:
    """Species at risk: rank among the present species of a survey, and whether the next survey of the plot misses it.

    Built from presences and the list of all surveys of a plot, those without any cover included. Several rows of one
    species in a survey are averaged first. A species of relative rank 0 (the lowest of a survey) is not at risk, as in the completed
    panel, where rank 0 also stands for absence.
    """
    once = live.groupBy(*PLOT, "trt", "Taxon", "year_trt").agg(F.avg("rel_cover").alias("rel_cover"))
    ranked = rescaled_rank(
        next_survey(once).where(F.col("rel_cover") > 0),
        ["site_code", "trt", "plot", "year_trt"],
        "rel_cover",
        zero="skip",
        rel_name="rel_rank_lag",
    )
    seen_next = F.lead("year_trt").over(Window.partitionBy(*PLOT, "Taxon").orderBy("year_trt"))
    rows = ranked.withColumn("_seen_next", seen_next)
    return (
        rows.where(
            F.col("trt").isin(*trts) & F.col("next_survey").isNotNull() & (F.col("rel_rank_lag") != 0)
        )
        .withColumn("lost", (~F.col("_seen_next").eqNullSafe(F.col("next_survey"))).cast("int"))
        .select(*PLOT, "trt", "Taxon", F.col("next_survey").alias("year_trt"), "rel_rank_lag", "lost")
    )


def plot_year_bef(plot_years: DataFrame, trts: Sequence[str] = TRTS) -> DataFrame:
    """Biomass and richness of treated plot-years, as they are and as log10(x + 1)."""
    return plot_years.where(F.col("trt").isin(*trts) & (F.col("year_trt") != 0)).select(
        *PLOT,
        "year_trt",
        "trt",
        "rich",
        "live_mass",
        F.log10(F.col("rich") + 1).alias("log_rich"),
        F.log10(F.col("live_mass") + 1).alias("log_mass"),
    )
