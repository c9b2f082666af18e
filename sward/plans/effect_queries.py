"""Queries on absence, loss and treatment effects, dominant-species events, turnover and modelling sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sward import operators as op
from sward.plans import shared
from sward.sources import roles

SPECIES = ["site_code", "plot", "Taxon"]
GROUPINGS = ("di_group", "abund_group")


def years_absent(spark, sf):
    return op.years_absent(shared.enriched(spark, sf), shared.metrics(spark, sf)).select(
        *SPECIES, "trt", "length", "years_present", "yrs_absent", "pretrt_cover", "abund_metric"
    )


def prop_years_absent(spark, sf):
    return op.prop_years_absent(shared.enriched(spark, sf), shared.metrics(spark, sf)).select(
        *SPECIES, "trt", "years_present", "prop_years_present", "prop_years_absent", "abund_metric"
    )


def prop_years_absent_diff(spark, sf):
    rows = op.prop_years_absent(shared.enriched(spark, sf), shared.metrics(spark, sf))
    return op.vs_control(rows, ["site_code", "Taxon"], "prop_years_absent").select(
        *SPECIES, "trt", "prop_years_absent", "prop_years_absent_ctl", "prop_years_absent_diff"
    )


def absence_vs_control(spark, sf):
    return op.absence_vs_control(shared.enriched(spark, sf), shared.metrics(spark, sf)).select(
        "site_code",
        "Taxon",
        "trt",
        "years_present",
        "prop_years_absent",
        "prop_years_absent_ctl",
        "prop_years_absent_diff",
        "dom_group",
    )


def absence_bar_stats(spark, sf):
    rows = op.absence_vs_control(shared.enriched(spark, sf), shared.metrics(spark, sf))
    return op.bar_stats(rows, "prop_years_absent_diff", ["trt", "dom_group"])


def absent_vs_present_control(spark, sf):
    return op.absent_vs_present_control(shared.enriched(spark, sf), shared.metrics(spark, sf)).select(
        "site_code", "Taxon", "trt", "di_group", "present", "prop_years_absent"
    )


def losses_by_group(spark, sf):
    return op.losses_by_group(shared.enriched(spark, sf), shared.metrics(spark, sf))


def losses_fixed_length(spark, sf):
    rows = op.losses_by_group(shared.enriched(spark, sf), shared.metrics(spark, sf), length=6)
    return op.bar_stats(rows, "prop_loss", ["trt", "di_group", "year_trt"])


def final_year_abundance(spark, sf):
    return op.final_abundance(shared.enriched(spark, sf), t_final=6).select(
        *SPECIES, "trt", "years_present", "pretrt_cover", "final_cover"
    )


def prop_lost_by_year(spark, sf):
    return op.prop_lost_sparse(shared.enriched(spark, sf), "di_class")


def prop_lost_by_abundance_class(spark, sf):
    return op.prop_lost_sparse(shared.enriched(spark, sf), "rel_class")


def species_counts_by_year(spark, sf):
    rows = op.prop_lost_sparse(shared.enriched(spark, sf), "di_class")
    return rows.groupBy("year_trt", "di_class").agg(F.sum("n").alias("num_taxon"))


def _with_plot_years(spark, sf):
    comb = shared.plot_years(spark, sf).select("site_code", "plot", "year_trt", "rich", "live_mass")
    return shared.enriched(spark, sf).join(comb, ["site_code", "plot", "year_trt"], "left")


def pct_diff_from_control(spark, sf):
    return op.metric_diff_by_group(_with_plot_years(spark, sf), "rich", "di_class")


def pct_diff_last_year(spark, sf):
    return op.metric_diff_by_group(shared.enriched(spark, sf), "rel_cover", "di_class", last_year=True)


def pct_diff_without_outliers(spark, sf):
    return op.metric_diff_by_group(shared.enriched(spark, sf), "max_cover", "freq_class", remove_outliers=True)


def pct_diff_box(spark, sf):
    diffs = op.metric_diff_by_group(shared.enriched(spark, sf), "max_cover", "freq_class")
    return op.box_stats(diffs, "diff", ["trt", "freq_class"])


def biomass_diff_by_year(spark, sf):
    comb = shared.plot_years(spark, sf).where(F.col("year_trt") != 0)
    means = comb.groupBy("site_code", "year_trt", "trt").agg(F.avg("live_mass").alias("m"))
    return op.pct_diff_wide(means, ["site_code", "year_trt"], "m")


def biomass_diff_bar_stats(spark, sf):
    return op.bar_stats(biomass_diff_by_year(spark, sf), "diff", ["year_trt", "trt"])


def _absent_by_group(rows, spark, sf, value):
    """Mean of an absence measure per (site, treatment, group) as relative difference from control, both groupings."""
    m = shared.metrics(spark, sf).select("site_code", "Taxon", *GROUPINGS)
    long = rows.join(m, ["site_code", "Taxon"]).unpivot(
        ["site_code", "trt", value], list(GROUPINGS), "grouping", "grp"
    )
    means = long.groupBy("site_code", "grouping", "grp", "trt").agg(F.avg(value).alias("m"))
    return op.pct_diff_wide(means, ["site_code", "grouping", "grp"], "m", scale=1.0)


def absent_years_diff_by_group(spark, sf):
    rows = op.years_absent(shared.enriched(spark, sf)).where(F.col("length") > 2)
    rows = rows.withColumn("prop_absent", F.col("yrs_absent") / F.col("length"))
    return _absent_by_group(rows, spark, sf, "prop_absent")


def absence_run_diff_by_group(spark, sf):
    after = shared.panel(spark, sf).where(F.col("year_trt") > 0)
    runs = op.absence_runs(after, ["site_code", "plot", "trt", "Taxon"], "year_trt", longest=True)
    return _absent_by_group(runs, spark, sf, "cons_abs_max")


def plot_year_biomass_richness(spark, sf):
    return op.plot_year_bef(shared.plot_years(spark, sf))


def biomass_richness_means(spark, sf):
    rows = shared.plot_years(spark, sf).where(F.col("year_trt") != 0)
    return rows.groupBy("site_code", "year_trt", "trt").agg(
        F.avg("rich").alias("mean_rich"),
        F.avg("live_mass").alias("mean_mass"),
        F.min("rich").alias("min_rich"),
        F.max("rich").alias("max_rich"),
        F.count(F.lit(1)).alias("n"),
    )


# --- events, turnover -------------------------------------------------------------------------------------------


def _core(spark, sf):
    """Core species of a plot: dominant by frequency at the site and present in the plot's baseline."""
    rows = shared.enriched(spark, sf)
    return rows.withColumn("core_class", F.when(F.col("rel_t0").isNotNull(), F.col("freq_class")))


def dominant_loss_events(spark, sf):
    return op.dominant_losses(_core(spark, sf), "core_class")


def dominant_loss_plots(spark, sf):
    return op.plot_flags(_core(spark, sf), "core_class")


def first_dominant_loss(spark, sf):
    return op.first_losses(_core(spark, sf), "core_class")


def dominant_loss_events_by_abundance(spark, sf):
    """Surveys that miss a species which was dominant in the plot's baseline by its share of cover."""
    return op.dominant_losses(shared.mosaic(spark, sf), "rel_class")


def dominant_loss_plots_by_abundance(spark, sf):
    """Plots with a species dominant by share of cover: how many, and whether one is ever missed."""
    return op.plot_flags(shared.mosaic(spark, sf), "rel_class")


def before_after_loss_by_abundance(spark, sf):
    """Cover of all species before and after the first loss of one dominant by share of cover."""
    rows = shared.mosaic(spark, sf)
    mass = rows.groupBy("site_code", "plot", "year_trt").agg(F.sum("max_cover").alias("live_mass"))
    return op.before_after_loss(rows, mass, "rel_class")


def years_absent_subplots(spark, sf):
    """Years absent where a survey has several subplots: a survey counts by the share of rows that have the species."""
    return op.years_absent(shared.mosaic(spark, sf)).select(*SPECIES, "trt", "length", "years_present", "yrs_absent", "pretrt_cover")


def lagged_loss_set_subplots(spark, sf):
    """Species at risk where surveys have subplots and some surveys found nothing."""
    return op.lagged_loss_set(shared.mosaic(spark, sf), roles.MOSAIC_TRTS)


def absence_ratio_fenced(spark, sf):
    """Relative difference to control in the mean fraction of years absent, by site and abundance class, with fences and
    nutrients alone and together."""
    rows = shared.mosaic(spark, sf)
    classes = rows.groupBy(*SPECIES).agg(F.max("rel_class").alias("rel_class"))
    absent = op.years_absent(rows).join(classes.where(F.col("rel_class").isNotNull()), SPECIES)
    means = absent.groupBy("site_code", "rel_class", "trt").agg(F.avg("yrs_absent").alias("absent"))
    out = op.vs_control(means.where(F.col("trt").isin("Control", "NPK", "Fence", "NPK+Fence")), ["site_code", "rel_class"], "absent", how="ratio")
    return out.where(F.col("absent_diff").isNotNull()).select("site_code", "rel_class", "trt", "absent", "absent_ctl", "absent_diff")


def before_after_loss(spark, sf):
    return op.before_after_loss(_core(spark, sf), shared.plot_years(spark, sf), "core_class")


def biomass_by_loss_flag(spark, sf):
    return op.biomass_by_loss(before_after_loss(spark, sf))


def turnover_first_year(spark, sf):
    return op.turnover(shared.enriched(spark, sf), ["site_code", "plot"], "year", "Taxon")


def turnover_previous_year(spark, sf):
    return op.turnover(shared.enriched(spark, sf), ["site_code", "plot"], "year", "Taxon", "previous")


def turnover_by_site(spark, sf):
    return op.turnover(shared.enriched(spark, sf), ["site_code"], "year", "Taxon")


# --- modelling sets ---------------------------------------------------------------------------------------------


def baseline_rank(spark, sf):
    return op.baseline_ranks(shared.enriched(spark, sf))


def lost_at_end_set(spark, sf):
    return op.lost_at_end_set(shared.enriched(spark, sf))


def lagged_loss_set(spark, sf):
    return op.lagged_loss_set(shared.enriched(spark, sf))


def prop_lost_by_treatment(spark, sf):
    return op.prop_by(op.lost_at_end_set(shared.enriched(spark, sf)), "lost_at_end", ["trt"])


def prop_lagged_lost_by_treatment(spark, sf):
    return op.prop_by(op.lagged_loss_set(shared.enriched(spark, sf)), "lost", ["trt"])


def rank_readings(spark, sf):
    """The four readings of absent species in a rank, side by side."""
    unit = ["site_code", "plot", "year_trt"]
    out = shared.panel(spark, sf)
    for zero in ("rank", "null_min", "skip", "shift"):
        out = op.rescaled_rank(out, unit, "rel_cover", zero, f"rank_{zero}", f"rel_{zero}")
    return out.select(
        *unit, "Taxon", *[f"{a}_{z}" for z in ("rank", "null_min", "skip", "shift") for a in ("rank", "rel")]
    )


QUERIES = {
    f.__name__: f
    for f in (
        years_absent,
        prop_years_absent,
        prop_years_absent_diff,
        absence_vs_control,
        absence_bar_stats,
        absent_vs_present_control,
        losses_by_group,
        losses_fixed_length,
        final_year_abundance,
        prop_lost_by_year,
        prop_lost_by_abundance_class,
        species_counts_by_year,
        pct_diff_from_control,
        pct_diff_last_year,
        pct_diff_without_outliers,
        pct_diff_box,
        biomass_diff_by_year,
        biomass_diff_bar_stats,
        absent_years_diff_by_group,
        absence_run_diff_by_group,
        plot_year_biomass_richness,
        biomass_richness_means,
        dominant_loss_events,
        dominant_loss_plots,
        dominant_loss_events_by_abundance,
        dominant_loss_plots_by_abundance,
        before_after_loss_by_abundance,
        years_absent_subplots,
        lagged_loss_set_subplots,
        absence_ratio_fenced,
        first_dominant_loss,
        before_after_loss,
        biomass_by_loss_flag,
        turnover_first_year,
        turnover_previous_year,
        turnover_by_site,
        baseline_rank,
        lost_at_end_set,
        lagged_loss_set,
        prop_lost_by_treatment,
        prop_lagged_lost_by_treatment,
        rank_readings,
    )
}
