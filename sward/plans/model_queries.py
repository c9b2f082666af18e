"""Queries on trends, loss models and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sward import operators as op
from sward.plans import shared
from sward.plans.effect_queries import before_after_loss
from sward.session import materialize
from sward.sources import roles

TRTS = ("Control", "N", "NP", "NPK")  # fixed values: factor levels, the first is the reference level


def _class_cover(spark, sf):
    preds = {k: v for k, v in op.class_predicates("di_class").items() if k == "sub_nat"}
    return op.cover_by(shared.enriched(spark, sf), ["site_code", "plot", "year_trt"], "rel_cover", preds)


def _bef(spark, sf):
    rows = shared.series_panel(spark, sf).where(F.col("MEASURE") == "Biomass")
    return op.community_series(rows).withColumn("log_b", F.log1p("b"))


def _at_risk(spark, sf):
    return shared.at_risk(spark, sf)


def _series_losses(spark, sf):
    ranked = op.community_ranks(shared.series_panel(spark, sf))
    return op.loss_summary(ranked).where(F.col("n_year") >= 3)


def fe_trend(spark, sf):
    return op.fe_trend(_class_cover(spark, sf), "cover_sub_nat", "year_trt", ["site_code"])


def site_slopes(spark, sf):
    return op.site_slopes(_class_cover(spark, sf), "cover_sub_nat", "year_trt", "site_code")


def ols_by_study(spark, sf):
    return op.ols_by(_bef(spark, sf), ["STUDY_ID"], "log_b", "std_year")


def ols_overall(spark, sf):
    return op.ols_by(shared.enriched(spark, sf), [], "rel_cover", "di")


def abundance_biomass_line(spark, sf):
    """Log biomass against log abundance of species, one line per study."""
    ranks = shared.pair_ranks(spark, sf)
    rows = ranks.select("STUDY_ID", F.log1p("Abundance").alias("log_a"), F.log1p("Biomass").alias("log_b"))
    return op.ols_by(rows, ["STUDY_ID"], "log_b", "log_a")


def quadratic_trend(spark, sf):
    comb = shared.plot_years(spark, sf).where(F.col("year_trt") != 0)
    means = comb.groupBy("site_code", "year_trt", "trt").agg(F.avg("live_mass").alias("m"))
    return op.quad_by(op.pct_diff_wide(means, ["site_code", "year_trt"], "m"), ["trt"], "diff", "year_trt")


def residual_autocorrelation(spark, sf):
    return op.residual_autocorrelation(_bef(spark, sf), ["STUDY_ID"], "YEAR", "log_b", "std_year")


def binned_trend(spark, sf):
    rows = op.plot_year_bef(shared.plot_years(spark, sf))
    return op.binned_trend(rows, "rich", "log_mass", 2.0, ["trt"])


def binned_trend_limited(spark, sf):
    """The trend over plot-years whose log biomass lies in a window, cut before smoothing."""
    rows = op.plot_year_bef(shared.plot_years(spark, sf)).withColumn("ln_mass", F.ln("live_mass"))
    return op.binned_trend(rows.where(F.col("ln_mass").between(13.0, 15.0)), "rich", "ln_mass", 2.0, ["trt"])


def rank_density(spark, sf):
    ranks = shared.pair_ranks(spark, sf)
    return op.bin2d(ranks, "rel_abund_rank", "rel_biomass_rank", 0.1, 0.1)


def loss_by_rank_bin(spark, sf):
    return (
        op.equal_width_class(_at_risk(spark, sf), "rel_rank_lag", 4)
        .groupBy("bin", "trt")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("lost").alias("prop_lost"))
    )


def logit_by_site(spark, sf):
    return op.logit_by(_at_risk(spark, sf), ["site_code"], "lost", "rel_rank_lag")


def logit_by_study(spark, sf):
    """Absence at some point against first-year rank, per study and measure."""
    return op.logit_by(
        _series_losses(spark, sf), ["STUDY_ID", "MEASURE"], "absent_at_some_point", "REL_RANK_TIMEPOINT"
    )


def pooled_logit(spark, sf):
    return op.pooled_logit(_at_risk(spark, sf), "lost", "rel_rank_lag")


def weighted_fraction_logit(spark, sf):
    """Fraction of years missing, weighted by the length of the series, of species missing at some point."""
    rows = _series_losses(spark, sf).where(F.col("absent_at_some_point") == 1)
    return op.logit_by(rows, ["MEASURE"], "frac_missing_after_t0", "REL_RANK_TIMEPOINT", w="n_year")


def hurdle_logit(spark, sf):
    """Missing at some point or not, weighted by the length of the series, per measure."""
    return op.logit_by(
        _series_losses(spark, sf), ["MEASURE"], "absent_at_some_point", "REL_RANK_TIMEPOINT", w="n_year"
    )


def rank_trajectory_model(spark, sf):
    """Rank over time with the first-year rank and their product, pooled straight-line model."""
    rows = op.abundance_trajectories(op.species_panel_metrics(shared.long_series(spark, sf)), min_years=7)
    rows = materialize(rows.select("YEAR_STD", "REL_RANK_T0", "REL_RANK_TIMEPOINT").na.drop(), "trajectories")
    data, terms = op.design(rows, "YEAR_STD", also=["REL_RANK_T0"])
    return op.coefficient_table(op.pooled_glm(data, "REL_RANK_TIMEPOINT", terms, family="gaussian"))


def two_stage_effect(spark, sf):
    return op.two_stage_effect(logit_by_site(spark, sf).where("converged"))


def two_stage_trend(spark, sf):
    return op.two_stage_effect(ols_by_study(spark, sf))


def slope_vs_cv(spark, sf):
    """Per-study slopes drawn toward their mean, next to the variation of biomass."""
    bef = _bef(spark, sf)
    slopes = op.shrunken_slopes(op.ols_by(bef, ["STUDY_ID"], "log_b", "std_year"), ["STUDY_ID"])
    return op.biomass_cv(bef).join(slopes, "STUDY_ID", "left")


def prediction_grid(spark, sf):
    """Loss curve of every site on an even grid of ranks."""
    coef = logit_by_site(spark, sf).select("site_code", "b0", "b1", "v00", "v01", "v11")
    return op.predict_grid(coef, op.even(spark, "rel_rank_lag", 0.0, 1.0, 100), "rel_rank_lag")


def trend_prediction_grid(spark, sf):
    """Straight-line biomass trend of every study over ten years, with its interval."""
    coef = ols_by_study(spark, sf).where(F.col("b1").isNotNull()).select("STUDY_ID", "b0", "b1", "v00", "v01", "v11")
    return op.predict_grid(coef, op.even(spark, "std_year", 0.0, 9.0, 10), "std_year", link="identity")


def site_rank_grid(spark, sf):
    """All combinations of the sites of the panel, a grid of ranks and the treatments."""
    sites = shared.cover(spark, sf).select("site_code").distinct()
    return op.grid(sites, op.even(spark, "rel_rank", 0.0, 1.0, 5), op.values(spark, "trt", TRTS))


def adjusted_means(spark, sf):
    rows = before_after_loss(spark, sf).withColumn("log_mass", F.ln("live_mass"))
    return op.adjusted_means(rows, "log_mass", "after_first", "year_trt")


def explained_variance(spark, sf):
    rows = _at_risk(spark, sf).select("lost", "rel_rank_lag")
    fit = op.pooled_logit(rows, "lost", "rel_rank_lag").select("b0", "b1")
    eta = rows.crossJoin(F.broadcast(fit)).select((F.col("b0") + F.col("b1") * F.col("rel_rank_lag")).alias("eta"))
    return op.explained_variance(eta, "eta", two_stage_effect(spark, sf), op.LOGIT_RESIDUAL)


def centred_rank(spark, sf):
    """Centring of a covariate by its overall mean."""
    rows = _at_risk(spark, sf)
    mean = rows.agg(F.avg("rel_rank_lag").alias("_m"))
    return rows.crossJoin(F.broadcast(mean)).select(
        "site_code", "plot", "Taxon", "year_trt", (F.col("rel_rank_lag") - F.col("_m")).alias("rank_centred")
    )


def coefficient_table(spark, sf):
    """Pooled loss model with treatment and its interaction with rank, full-rank design."""
    rows, terms = op.design(_at_risk(spark, sf), "rel_rank_lag", "trt", TRTS)
    return op.coefficient_table(op.pooled_glm(rows, "lost", terms))


def coefficient_table_with_year(spark, sf):
    """The same with treatment year and its interaction with treatment."""
    rows, terms = op.design(_at_risk(spark, sf), "rel_rank_lag", "trt", TRTS, also=["year_trt"])
    for t in TRTS[1:]:
        rows = rows.withColumn(f"year_trt_x_trt_{t}", F.col("year_trt") * F.col(f"trt_{t}"))
        terms.append(f"year_trt_x_trt_{t}")
    return op.coefficient_table(op.pooled_glm(rows, "lost", terms))


def aicc_table(spark, sf):
    """Loss at the next survey against rank: alone, with treatment year, and with their product."""
    rows = _at_risk(spark, sf)
    fits = {}
    for name, also, interact in (
        ("rank", [], False),
        ("rank + year", ["year_trt"], False),
        ("rank * year", ["year_trt"], True),
    ):
        data, terms = op.design(rows, "rel_rank_lag", also=also, interact=interact)
        fits[name] = op.pooled_glm(data, "lost", terms)
    return op.information_table(fits)


def pair_rank_loss(spark, sf):
    """Loss against lagged abundance rank, lagged size rank and their product, pooled over studies."""
    ranks = shared.pair_ranks(spark, sf)
    rows = ranks.where((F.col("lag_rel_abund_rank") != 0) & F.col("lost").isNotNull())
    rows = rows.withColumn("lost", F.col("lost").cast("int"))
    data, terms = op.design(rows, "lag_rel_abund_rank", also=["lag_rel_percapita_rank"])
    return op.coefficient_table(op.pooled_glm(data, "lost", terms))


def location_spread(spark, sf):
    """Spread of the locations of every study, kept or not."""
    return op.fixed_locations(roles.series_locations(spark, sf), cutoff=None)


QUERIES = {
    f.__name__: f
    for f in (
        fe_trend,
        site_slopes,
        ols_by_study,
        ols_overall,
        abundance_biomass_line,
        quadratic_trend,
        residual_autocorrelation,
        binned_trend,
        binned_trend_limited,
        rank_density,
        loss_by_rank_bin,
        logit_by_site,
        logit_by_study,
        pooled_logit,
        weighted_fraction_logit,
        hurdle_logit,
        rank_trajectory_model,
        two_stage_effect,
        two_stage_trend,
        slope_vs_cv,
        prediction_grid,
        trend_prediction_grid,
        site_rank_grid,
        adjusted_means,
        explained_variance,
        centred_rank,
        coefficient_table,
        coefficient_table_with_year,
        aicc_table,
        pair_rank_loss,
        location_spread,
    )
}
