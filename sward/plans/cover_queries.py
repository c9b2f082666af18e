"""Queries on the cover panel: shares, classes, richness, completion, differences, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sward import operators as op
from sward.functions import semantics as sem
from sward.plans import shared
from sward.sources import files, roles

ROW = ["site_code", "plot", "year", "Taxon"]
SPECIES = ["site_code", "plot", "Taxon"]
PLOT_YEAR = ["site_code", "plot", "year"]
SYSTEMS = ("di_class", "di_class2", "rel_class", "rel_class2", "freq_class", "freq_class2")


def relative_cover(spark, sf):
    return op.live_cover(roles.cover(spark, sf)).select(*ROW, "total_cover", "rel_cover")


def relative_cover_all(spark, sf):
    """Totals over dead and live records next to the live ones; a dead record has no live share."""
    rows = shared.cover(spark, sf)
    out = op.relative_abundance(rows, PLOT_YEAR, "max_cover", total="total_all", rel="rel_all")
    out = op.relative_abundance(
        out, PLOT_YEAR, "max_cover", live=F.col("live") == 1, total="total_live", rel="rel_live"
    )
    return out.select(*ROW, "live", "total_all", "rel_all", "total_live", "rel_live")


def cut_classes(spark, sf):
    return shared.enriched(spark, sf).select(*SPECIES, *SYSTEMS).distinct()


def six_number_summary(spark, sf):
    return op.six_num(shared.enriched(spark, sf), ["max_cover", "rel_cover", "rel_t0", "rel_freq", "di"])


def bar_stats(spark, sf):
    return op.bar_stats(shared.enriched(spark, sf), "rel_cover", ["trt", "year_trt"])


def mad_filter(spark, sf):
    return op.mad_filter(shared.enriched(spark, sf).select(*ROW, "max_cover"), "max_cover", k=3.0)


def histogram(spark, sf):
    return op.histogram(shared.enriched(spark, sf), "rel_cover", 20, ["trt"])


def box_stats(spark, sf):
    rows = shared.enriched(spark, sf).where(F.col("di_class").isNotNull())
    return op.box_stats(rows, "rel_cover", ["trt", "di_class"])


def crosstab_live(spark, sf):
    return op.crosstab(roles.cover_records(spark, sf), "Taxon", "live", [0, 1])


def recode_categories(spark, sf):
    new = {"NULL": "UNKNOWN", "INT": "INTRODUCED", "NAT": "NATIVE"}  # fixed values: readable category names
    rows = shared.cover(spark, sf).withColumn("provenance", sem.recode("local_provenance", new))
    rows = rows.withColumn("introduced_only", sem.recode("local_provenance", {"INT": "INTRODUCED"}, keep_other=False))
    return rows.groupBy("provenance", "introduced_only").agg(
        F.count(F.lit(1)).alias("n"), F.sum("max_cover").alias("cover")
    )


def tolerant_cast(spark, sf):
    text = F.when(F.col("local_provenance") == "NULL", "NULL").otherwise(F.col("max_cover").cast("string"))
    rows = shared.cover(spark, sf).withColumn("as_number", sem.to_number(text))
    return rows.groupBy("Taxon").agg(
        F.count(F.lit(1)).alias("n"), F.count("as_number").alias("n_number"), F.sum("as_number").alias("cover")
    )


def global_summary(spark, sf):
    return op.overall(shared.enriched(spark, sf), "rel_cover")


def panel_size(spark, sf):
    """Species and sites of the study: distinct values by grouping, counted as one row."""
    rows = shared.enriched(spark, sf)
    sp = rows.select("Taxon").distinct().agg(F.count(F.lit(1)).alias("num_species"))
    st = rows.select("site_code").distinct().agg(F.count(F.lit(1)).alias("num_sites"))
    return sp.crossJoin(F.broadcast(st))


def equal_width_bins(spark, sf):
    rows = shared.enriched(spark, sf).where(F.col("rel_t0").isNotNull())
    return op.equal_width_class(rows, "rel_t0", 4).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("rel_t0").alias("lowest"), F.max("rel_t0").alias("highest")
    )


def quantile_classes(spark, sf):
    base = shared.enriched(spark, sf).where(F.col("year_trt") == 0).select(*SPECIES, "di")
    return op.quantile_class(base, ["site_code", "plot"], "di")


def strict_sums(spark, sf):
    """Sum of baseline shares per plot-year, ignoring species without a baseline and not ignoring them."""
    return shared.enriched(spark, sf).groupBy(*PLOT_YEAR).agg(
        F.sum("rel_t0").alias("known"), sem.strict_agg(F.sum, "rel_t0").alias("strict")
    )


# --- completion, baselines, differences --------------------------------------------------------------------------


def complete_panel(spark, sf):
    return shared.panel(spark, sf)


def baseline_abundance(spark, sf):
    rows = shared.enriched(spark, sf).select(*ROW, "year_trt", "rel_cover")
    out = op.baseline(rows, SPECIES, "year_trt", "rel_cover")
    out = op.baseline(out, SPECIES, "year_trt", "rel_cover", default=0.0, name="rel_cover_t0_or_0")
    return out.drop("year_trt")


def site_min_years(spark, sf):
    rows = shared.enriched(spark, sf)
    kept = op.keep_groups(rows, SPECIES, min_distinct={"year_trt": 5}, nonzero="max_cover")
    return kept.select(*ROW)


def first_differences(spark, sf):
    rich = op.richness_by(
        shared.enriched(spark, sf), ["site_code", "plot", "year"], "Taxon", _classes("di_class")
    )
    cols = [f"sr_{c}" for c in _classes("di_class")]
    return op.first_diff(rich, ["site_code", "plot"], "year", cols, one_row=True)


def _classes(system):
    preds = op.class_predicates(system)
    return {k: preds[k] for k in ("domspp", "rarespp", "subordspp", "non_rare")}


def species_cover_change(spark, sf):
    """Change of a species' relative cover since its plot's previous survey of it."""
    rows = shared.enriched(spark, sf).select(*ROW, "rel_cover")
    return op.first_diff(rows, SPECIES, "year", ["rel_cover"], one_row=True)


def baseline_total_cover(spark, sf):
    """Baseline cover of the whole plot on each of its rows, 0 for plots without a baseline."""
    rows = shared.enriched(spark, sf).select(*ROW, "year_trt", "max_cover")
    return op.group_total(rows, ["site_code", "plot"], "max_cover", F.col("year_trt") == 0, "total_cover_t0").drop("year_trt")


def duplicate_audit(spark, sf):
    return op.dup_audit(roles.cover_records(spark, sf), SPECIES, "year", "subplot")


def multi_subplot_plots(spark, sf):
    """Site-years in which some species of a plot was recorded in several subplots."""
    rows = roles.cover_records(spark, sf)
    audit = op.dup_audit(rows, [*SPECIES, "year"], "year_trt", "subplot").where(F.col("n_subplots") > 1)
    return audit.groupBy("site_code", "year").agg(F.count(F.lit(1)).alias("n_species_plots"))


def facet_classes(spark, sf):
    """Quarter-width classes of baseline share with the lowest edge included."""
    labels = ("0 to .25", ".25 to .5", ".5 to .75", ".75 to 1")  # fixed values: facet labels
    rows = shared.enriched(spark, sf)
    facet = sem.cut_class(F.coalesce("rel_t0", F.lit(0.0)), (0.0, 0.25, 0.5, 0.75, 1.0), labels, include_lowest=True)
    return rows.groupBy(facet.alias("facet"), "trt").agg(F.count(F.lit(1)).alias("n"), F.avg("rel_cover").alias("mean"))


def latest_rows(spark, sf):
    return op.latest(shared.enriched(spark, sf), SPECIES, "year").select(*ROW, "max_cover")


def quarantine(spark, sf):
    bad = (F.col("site_code") == "S1") & (F.col("plot") % 7).isin(0, 3) & (F.col("year_trt") == 0)
    kept = op.drop_bad_records(shared.cover(spark, sf), bad)
    return kept.groupBy("site_code", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("max_cover").alias("cover"))


def years_since_start(spark, sf):
    rows = shared.enriched(spark, sf).select(*ROW)
    return op.years_since_start(op.years_since_start(rows, SPECIES, "year", bounded=True), SPECIES, "year", 1, "std_year_1", bounded=True)


def relative_to_own_series(spark, sf):
    out = shared.panel(spark, sf)
    for ref in ("max", "first", "t0", "first3"):
        out = op.ratio_to(out, SPECIES, "year_trt", "rel_cover", ref, f"ratio_{ref}")
    return out.select(*SPECIES, "year_trt", "ratio_max", "ratio_first", "ratio_t0", "ratio_first3")


def z_scores(spark, sf):
    out = op.z_score(shared.panel(spark, sf), SPECIES, "rel_cover")
    out = op.z_score(out, SPECIES, "rel_cover", log=True, name="z_log")
    return out.select(*SPECIES, "year_trt", "z", "z_log")


def last_three_active(spark, sf):
    out = op.last_k_active(shared.panel(spark, sf), SPECIES, "year_trt", "rel_cover")
    return out.groupBy(*SPECIES).agg(F.max("active_last_k").alias("active"))


def absence_run_steps(spark, sf):
    return op.absence_runs(shared.panel(spark, sf), SPECIES, "year_trt").select(
        *SPECIES, "year_trt", "pa", "cons_abs"
    )


def max_absence_run(spark, sf):
    after = shared.panel(spark, sf).where(F.col("year_trt") > 0)
    return op.absence_runs(after, SPECIES, "year_trt", longest=True)


def loss_transitions(spark, sf):
    return op.losses(shared.panel(spark, sf), SPECIES, "year_trt", "rel_cover").select(
        *SPECIES, "year_trt", "lag_value", "lost"
    )


def log_ratio_richness(spark, sf):
    comb = shared.plot_years(spark, sf)
    return op.log_ratio_change(comb, ["site_code", "plot"], "year_trt", ["rich", "live_mass"])


# --- dominance and richness --------------------------------------------------------------------------------------


def rel_freq_space(spark, sf):
    live = shared.cover(spark, sf).where(F.col("live") == 1)
    by_max = op.rel_freq_space(live, denominator="max").select(
        "site_code", "Taxon", F.col("rel_freq").alias("rel_freq_max")
    )
    return op.rel_freq_space(live).join(by_max, ["site_code", "Taxon"])


def dominance_index(spark, sf):
    return op.dominance_index(roles.cover(spark, sf))


def richness_by_class(spark, sf):
    """Richness per class, clean and with one level more where some species of the survey has no class."""
    preds = _classes("di_class")
    undecided = {f"open_{k}": p.isNull() for k, p in preds.items()}
    out = op.richness_by(shared.enriched(spark, sf), PLOT_YEAR, "Taxon", {**preds, **undecided})
    level = [(F.col(f"sr_{k}") + F.least(F.col(f"sr_open_{k}"), F.lit(1))).alias(f"na_sr_{k}") for k in preds]
    return out.select(*PLOT_YEAR, *[f"sr_{k}" for k in preds], *level)


def class_profile(spark, sf):
    """Richness and cover by class and provenance in one pass."""
    preds = op.class_predicates("di_class")
    return op.profile_by(
        shared.enriched(spark, sf), PLOT_YEAR, "Taxon", "rel_cover", preds, {**preds, **op.provenance_predicates()}
    )


def richness_by_class_provenance(spark, sf):
    return op.richness_by(shared.enriched(spark, sf), PLOT_YEAR, "Taxon", op.class_predicates("di_class"))


def richness_class_systems(spark, sf):
    """Every class system crossed with provenance in one pass: 78 counts per plot-year."""
    preds = {f"{s}_{k}": p for s in SYSTEMS for k, p in op.class_predicates(s).items()}
    return op.richness_by(shared.enriched(spark, sf), PLOT_YEAR, "Taxon", preds)


def cover_by_class(spark, sf):
    preds = {**op.class_predicates("di_class"), **op.provenance_predicates()}
    return op.cover_by(shared.enriched(spark, sf), PLOT_YEAR, "rel_cover", preds)


def strict_cover_by_class(spark, sf):
    preds = {k: p for k, p in op.class_predicates("di_class").items() if k in ("domspp", "rarespp", "rare")}
    return op.cover_by(shared.enriched(spark, sf), PLOT_YEAR, "rel_cover", preds, na_rm=False)


def di_over_time(spark, sf):
    return op.di_over_time(shared.enriched(spark, sf))


def lifespan_richness(spark, sf):
    preds = op.lifespan_predicates()
    two = {k: preds[k] for k in ("annual", "peren")}
    out = op.profile_by(shared.enriched(spark, sf), PLOT_YEAR, "Taxon", "rel_cover", preds, two)
    changed = op.first_diff(out, ["site_code", "plot"], "year", ["sr_annual", "sr_peren"], one_row=True)
    return changed.drop("lag_sr_annual", "lag_sr_peren")


def status_counts(spark, sf):
    return op.status_label(shared.enriched(spark, sf)).groupBy("status", "non_rare").agg(
        F.count(F.lit(1)).alias("n"), F.max(sem.class_order("di_class")).alias("class_code")
    )


def site_species_metrics(spark, sf):
    return op.site_species_metrics(shared.enriched(spark, sf))


def dominance_ntile(spark, sf):
    return shared.metrics(spark, sf).select("site_code", "Taxon", "abund_metric", "di_group", "abund_group")


def wide_ingest_roundtrip(spark, sf):
    """Species to columns (names with a prefix, zero where absent), then the wide ingest back to rows."""
    numbers = sorted({50 // p for p in range(1, 51)})  # the species numbers the size classes can give
    ids = ["site_code", "plot", "year", "year_trt"]
    wide = (
        shared.cover(spark, sf)
        .groupBy(*ids)
        .pivot("Taxon", [f"T{k}" for k in numbers])
        .agg(F.sum("max_cover"))
        .select(*ids, *[F.coalesce(F.col(f"T{k}"), F.lit(0.0)).alias(f"sp.T{k}") for k in numbers])
    )
    return files.ingest_wide(wide, ids)


def richness_compare(spark, sf):
    live = shared.cover(spark, sf).where(F.col("live") == 1)
    analysed = op.keep_groups(live, ["site_code"], min_distinct={"year_trt": 5})
    return op.richness_compare(analysed, shared.plot_years(spark, sf), live)


def title_search(spark, sf):
    return roles.titles(spark, sf).where(F.col("TITLE").contains("ring")).distinct()


def sample_plots(spark, sf):
    plots = shared.cover(spark, sf).select("site_code", "plot").distinct()
    return op.sample_n(plots, 10, ["site_code", "plot"], seed=7)


def top_species(spark, sf):
    """The ten most abundant species rows of the baseline."""
    base = shared.enriched(spark, sf).where(F.col("year_trt") == 0)
    order = [F.col("max_cover").desc(), "plot", "Taxon"]
    return base.select("site_code", "plot", "Taxon", "max_cover").orderBy(*order).limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        relative_cover,
        relative_cover_all,
        cut_classes,
        six_number_summary,
        bar_stats,
        mad_filter,
        histogram,
        box_stats,
        crosstab_live,
        recode_categories,
        tolerant_cast,
        global_summary,
        panel_size,
        equal_width_bins,
        quantile_classes,
        strict_sums,
        complete_panel,
        baseline_abundance,
        site_min_years,
        first_differences,
        species_cover_change,
        baseline_total_cover,
        duplicate_audit,
        multi_subplot_plots,
        facet_classes,
        latest_rows,
        quarantine,
        years_since_start,
        relative_to_own_series,
        z_scores,
        last_three_active,
        absence_run_steps,
        max_absence_run,
        loss_transitions,
        log_ratio_richness,
        rel_freq_space,
        dominance_index,
        richness_by_class,
        class_profile,
        richness_by_class_provenance,
        richness_class_systems,
        cover_by_class,
        strict_cover_by_class,
        di_over_time,
        lifespan_richness,
        status_counts,
        site_species_metrics,
        dominance_ntile,
        wide_ingest_roundtrip,
        richness_compare,
        title_search,
        sample_plots,
        top_species,
    )
}
