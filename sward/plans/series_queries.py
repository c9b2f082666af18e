"""Queries on abundance and biomass series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sward import operators as op
from sward.functions import semantics as sem
from sward.plans import shared
from sward.sources import roles


def fixed_location_studies(spark, sf):
    return op.fixed_locations(roles.series_locations(spark, sf))


def fixed_among_travellers(spark, sf):
    """Studies that stayed at one place where many did not, with the totals of their series."""
    fixed = op.fixed_locations(roles.travelling_locations(spark, sf))
    totals = roles.series(spark, sf).groupBy("STUDY_ID").agg(F.sum("Abundance").alias("abundance"), F.countDistinct("YEAR").alias("n_years"))
    return fixed.join(totals, "STUDY_ID")


def fixed_series_totals(spark, sf):
    """Yearly totals of the studies that stayed at one place."""
    return shared.series(spark, sf).groupBy("STUDY_ID", "YEAR").agg(
        F.sum("Abundance").alias("abundance"), F.sum("Biomass").alias("biomass"), F.count(F.lit(1)).alias("n")
    )


def sample_coverage(spark, sf):
    return op.sample_coverage(shared.series(spark, sf), roles.series_meta(spark, sf))


def incidence_coverage(spark, sf):
    return op.incidence_coverage(shared.series(spark, sf), roles.series_meta(spark, sf))


def coverage_consistency(spark, sf):
    """Singletons counted by the estimator and on their own: no sample may disagree."""
    series, meta = shared.series(spark, sf), roles.series_meta(spark, sf)
    keys = ["STUDY_ID", "YEAR", "SAMPLE_DESC"]
    ones = op.coverage_ops.counted(series, meta).where(F.col("Abundance") == 1)
    ones = ones.groupBy(*keys).agg(F.count(F.lit(1)).alias("ones"))
    both = op.sample_coverage(series, meta).join(ones, keys, "left").withColumn("ones", F.coalesce("ones", F.lit(0)))
    return op.mismatches(both, "f1", "ones")


def coverage_overall(spark, sf):
    return op.overall(op.sample_coverage(shared.series(spark, sf), roles.series_meta(spark, sf)), "chat_corrected")


def coverage_filtered(spark, sf):
    return op.long_measures(op.with_sample_counts(shared.kept_series(spark, sf))).select(
        "STUDY_ID", "YEAR", "SAMPLE_DESC", "GENUS_SPECIES", "MEASURE", "VALUE", "chat_corrected", "min_samples"
    )


def sample_counts(spark, sf):
    return op.sample_counts(shared.kept_series(spark, sf))


def kept_ratio(spark, sf):
    kept = shared.kept_series(spark, sf).where(F.col("YEAR") > op.coverage_ops.YEAR_FLOOR)
    return op.kept_ratio(shared.series(spark, sf), kept, "STUDY_ID")


def series_completed(spark, sf):
    return shared.series_panel(spark, sf)


def community_ranks(spark, sf):
    return op.community_ranks(shared.series_panel(spark, sf))


def species_panel_metrics(spark, sf):
    return op.species_panel_metrics(shared.long_series(spark, sf))


def loss_summary(spark, sf):
    ranked = op.community_ranks(shared.series_panel(spark, sf))
    return op.loss_summary(ranked).select(
        *op.SERIES_KEY,
        "SUM_VALUE",
        "REL_RANK_TIMEPOINT",
        "n_year",
        "n_zeros",
        "lost_at_end",
        "frac_missing_after_t0",
        "absent_at_some_point",
    )


def _biomass(spark, sf):
    return shared.series_panel(spark, sf).where(F.col("MEASURE") == "Biomass")


def bef_series(spark, sf):
    return op.community_series(_biomass(spark, sf))


def biomass_timeseries(spark, sf):
    return op.community_series(_biomass(spark, sf), min_years=4).select(
        "STUDY_ID", sem.key_label("STUDY_ID", F.lit("Biomass")).alias("series"), "YEAR", "z", "s", "b", "n_years",
        F.log1p("b").alias("log_b"), sem.years_label("n_years").alias("length_label"),
    )


def log_ratio_change(spark, sf):
    return op.community_series(_biomass(spark, sf)).where(F.col("lr_s").isNotNull()).select(
        "STUDY_ID", "YEAR", "std_year", "lr_s", "lr_b"
    )


def biomass_cv(spark, sf):
    return op.biomass_cv(op.community_series(_biomass(spark, sf)))


def abundance_biomass_ranks(spark, sf):
    return op.abundance_biomass_ranks(shared.series_panel(spark, sf))


def abundance_biomass_ranks_strict(spark, sf):
    """The variant whose early means and lags are taken of the first-year rank."""
    return op.abundance_biomass_ranks(shared.series_panel(spark, sf), strict=True).select(
        "STUDY_ID",
        "YEAR",
        "GENUS_SPECIES",
        "rel_abund_rank_t0",
        "rel_abund_rank_first3",
        "lag_rel_abund_rank",
        "lag_rel_percapita_rank",
        "lost",
    )


def abundance_trajectories(spark, sf):
    """Mean share and rank over time by facet of the early share and of the first rank."""
    rows = op.abundance_trajectories(op.species_panel_metrics(shared.long_series(spark, sf)), min_years=7)
    return rows.groupBy("MEASURE", "share_facet", "rank_facet", "YEAR_STD").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("REL_VALUE_COMM").alias("mean_share"),
        F.avg("REL_RANK_TIMEPOINT").alias("mean_rank"),
    )


def lost_at_end_by_rank(spark, sf):
    return op.lost_at_end_by_rank(op.abundance_biomass_ranks(shared.series_panel(spark, sf)))


def standard_years(spark, sf):
    years = shared.series(spark, sf).select("STUDY_ID", "YEAR").distinct()
    one = op.standard_years(years, 1).withColumnRenamed("std_year", "std_year_1")
    return op.standard_years(years).join(one, ["STUDY_ID", "YEAR"])


def studies_with_both_measures(spark, sf):
    """Studies that recorded two measures in more than three years."""
    rows = shared.long_series(spark, sf)
    kept = op.keep_groups(rows, ["STUDY_ID"], min_distinct={"YEAR": 4}, levels={"MEASURE": 2})
    return kept.groupBy("STUDY_ID", "MEASURE").agg(
        F.sum("VALUE").alias("total"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        fixed_location_studies,
        fixed_among_travellers,
        fixed_series_totals,
        sample_coverage,
        incidence_coverage,
        coverage_consistency,
        coverage_overall,
        coverage_filtered,
        sample_counts,
        kept_ratio,
        series_completed,
        community_ranks,
        species_panel_metrics,
        loss_summary,
        bef_series,
        biomass_timeseries,
        log_ratio_change,
        biomass_cv,
        abundance_biomass_ranks,
        abundance_biomass_ranks_strict,
        abundance_trajectories,
        lost_at_end_by_rank,
        standard_years,
        studies_with_both_measures,
    )
}
