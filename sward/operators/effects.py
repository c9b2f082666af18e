"""Absence and loss of species, and differences between treatments and their control.

The questions here are about absences, which are not stored. Most of them can be answered from the presences and the
list of surveys alone (a species is absent from every survey of its plot that holds no record of it), so the completed
panel is not built: it would be larger by the ratio of a site's species to a plot's species.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import corrected_div, pct_diff, safe_div
from sward.operators.order import mad_filter
from sward.operators.panel import latest
from sward.session import settle

CONTROL = "Control"
TREATMENTS = ("N", "NP", "NPK")


def site_length(live: DataFrame) -> DataFrame:
    """Length of the experiment at each site: its largest treatment year. Stored, as it is joined to species rows."""
    return settle(live.groupBy("site_code").agg(F.max("year_trt").alias("length")), "site_length")


def treated_plots(live: DataFrame) -> DataFrame:
    """Plots with surveys after the baseline, with their treatment."""
    return live.where(F.col("year_trt") > 0).select("site_code", "plot", "trt").distinct()


def vs_control(
    df: DataFrame, keys: Sequence[str], value: str, trt: str = "trt", control: str = CONTROL, how: str = "diff"
) -> DataFrame:
    """Treatment rows next to the control value of the same keys.

    ``how``: ``diff`` = t - c, ``ratio`` = (t - c) / c with NULL for a zero control, ``corrected`` = the same with 0/0 as
    0 and x/0 as 1. Several control rows per key (control plots of a site) are averaged first, so a treatment row is
    never multiplied.
    """
    ctl = (
        df.where(F.col(trt) == control).groupBy(*keys).agg(F.avg(value).alias(f"{value}_ctl"))
    )
    out = df.where(F.col(trt) != control).join(ctl, list(keys), "left")
    t, c = F.col(value), F.col(f"{value}_ctl")
    diff = {"diff": t - c, "ratio": safe_div(t - c, c), "corrected": corrected_div(t - c, c)}[how]
    return out.withColumn(f"{value}_diff", diff)


def metric_diff_by_group(
    df: DataFrame,
    metric: str,
    grouping: str,
    keys: Sequence[str] = ("site_code",),
    treatments: Sequence[str] = TREATMENTS,
    remove_outliers: bool = False,
    last_year: bool = False,
    scale: float = 100.0,
) -> DataFrame:
    """Per cent difference from control of the mean of a metric, per key, class and treatment.

    Baseline rows and rows without a class are left out. ``last_year`` keeps only each plot's last survey,
    ``remove_outliers`` drops differences beyond 5 median absolute deviations.
    """
    data = latest(df, ["site_code", "plot"], "year_trt") if last_year else df
    data = data.where((F.col("year_trt") != 0) & F.col(grouping).isNotNull())
    means = data.where(F.col("trt").isin(CONTROL, *treatments)).groupBy(*keys, grouping, "trt").agg(
        F.avg(metric).alias("m")
    )
    out = pct_diff_wide(means, [*keys, grouping], "m", treatments, scale)
    return mad_filter(out, "diff") if remove_outliers else out


def pct_diff_wide(
    means: DataFrame, keys: Sequence[str], value: str, treatments: Sequence[str] = TREATMENTS, scale: float = 100.0
) -> DataFrame:
    """Treatment means to columns, difference from control, back to one row per (keys, treatment)."""
    wide = means.groupBy(*keys).pivot("trt", [CONTROL, *treatments]).agg(F.first(value))
    diffs = wide.select(*keys, *[pct_diff(t, CONTROL, scale).alias(t) for t in treatments])
    return diffs.unpivot([F.col(k) for k in keys], [F.col(t) for t in treatments], "trt", "diff").where(
        F.col("diff").isNotNull()
    )


def _baseline_species(live: DataFrame, *extra) -> DataFrame:
    """Species of a plot's baseline in plots surveyed afterwards, with years present and length, from one grouping."""
    # presence is averaged over the rows (subplots) of a survey before it is summed over years
    surveys = live.groupBy("site_code", "plot", "Taxon", "year_trt").agg(
        F.max("rel_cover").alias("rel_cover"), F.avg((F.col("rel_cover") > 0).cast("int")).alias("_present")
    )
    species = surveys.groupBy("site_code", "plot", "Taxon").agg(
        F.max(F.when(F.col("year_trt") == 0, F.col("rel_cover"))).alias("pretrt_cover"),
        F.coalesce(F.sum(F.when(F.col("year_trt") > 0, F.col("_present"))), F.lit(0.0)).alias("years_present"),
        *extra,
    )
    return (
        species.where(F.col("pretrt_cover").isNotNull())
        .join(treated_plots(live), ["site_code", "plot"])
        .join(site_length(live), "site_code")
        .where(F.col("length") > 0)
        .withColumn("yrs_absent", safe_div(F.col("length") - F.col("years_present"), "length"))
    )


def years_absent(live: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Fraction of treatment years a baseline species is absent from its plot, with its baseline cover.

    One row per (site, plot, species) present at the baseline in a plot that was surveyed afterwards. Several rows of one
    survey (subplots) count by the share of them that have the species.
    """
    out = _baseline_species(live)
    return out.join(metrics, ["site_code", "Taxon"]) if metrics is not None else out


def prop_years_absent(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """Proportion of treatment years present and absent per plot and species, for species present at least once after
    the baseline and known from the site's baseline."""
    return (
        live.where((F.col("year_trt") > 0) & (F.col("rel_cover") > 0))
        .groupBy("site_code", "plot", "trt", "Taxon")
        .agg(F.count(F.lit(1)).alias("years_present"))
        .join(metrics.select("site_code", "Taxon", "abund_metric"), ["site_code", "Taxon"])
        .join(site_length(live), "site_code")
        .withColumn("prop_years_present", safe_div("years_present", "length"))
        .withColumn("prop_years_absent", 1 - F.col("prop_years_present"))
    )


def site_presence(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """Species present in any plot of a treatment per site and treatment year (baseline species only)."""
    return (
        live.where((F.col("year_trt") > 0) & (F.col("rel_cover") > 0))
        .select("site_code", "Taxon", "year_trt", "trt")
        .distinct()
        .join(metrics.select("site_code", "Taxon"), ["site_code", "Taxon"], "left_semi")
    )


def site_absence(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """Proportion of years a species is absent from a whole treatment of a site; never present counts as 1."""
    present = site_presence(live, metrics).groupBy("site_code", "Taxon", "trt").agg(
        F.count(F.lit(1)).alias("years_present")
    )
    arms = live.where(F.col("year_trt") > 0).select("site_code", "trt").distinct()
    return (
        metrics.select("site_code", "Taxon", "abund_metric", "di_group", "abund_group")
        .join(arms, "site_code")
        .join(present, ["site_code", "Taxon", "trt"], "left")
        .withColumn("years_present", F.coalesce("years_present", F.lit(0)))
        .join(site_length(live), "site_code")
        .withColumn("prop_years_absent", 1 - safe_div("years_present", "length"))
    )


def group_label(c: str):
    """Names of the three dominance groups, lowest first."""
    return F.when(F.col(c) == 1, "rare").when(F.col(c) == 2, "intermediate").when(F.col(c) == 3, "common")


def absence_vs_control(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """Relative difference to control in the proportion of years absent; species always absent from the controls are
    gains, not losses, and are dropped."""
    out = vs_control(site_absence(live, metrics), ["site_code", "Taxon"], "prop_years_absent", how="corrected")
    return out.where(F.col("prop_years_absent_ctl") < 1).withColumn("dom_group", group_label("di_group"))


def treatment_presence(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """For every species and year present in the control of a site: present (1) or absent (0) in each treatment that was
    surveyed that year."""
    present = site_presence(live, metrics)
    in_control = present.where(F.col("trt") == CONTROL).drop("trt")
    arms = (
        live.where((F.col("year_trt") > 0) & (F.col("trt") != CONTROL))
        .select("site_code", "year_trt", "trt")
        .distinct()
    )
    seen = present.withColumn("_seen", F.lit(1))
    return (
        in_control.join(arms, ["site_code", "year_trt"])
        .join(seen, ["site_code", "Taxon", "year_trt", "trt"], "left")
        .withColumn("pa", F.coalesce("_seen", F.lit(0)))
        .drop("_seen")
        .join(metrics.select("site_code", "Taxon", "abund_metric", "di_group"), ["site_code", "Taxon"], "left")
    )


def absent_vs_present_control(live: DataFrame, metrics: DataFrame) -> DataFrame:
    """Proportion of years a species is absent from a treatment, over the years it is present in the control."""
    return (
        treatment_presence(live, metrics)
        .groupBy("site_code", "Taxon", "trt", "abund_metric", "di_group")
        .agg(F.sum("pa").alias("present"))
        .join(site_length(live), "site_code")
        .withColumn("prop_years_absent", safe_div(F.col("length") - F.col("present"), "length"))
    )


def losses_by_group(
    live: DataFrame, metrics: DataFrame, max_time: int | None = None, length: int | None = None
) -> DataFrame:
    """Species lost and kept per site, year, treatment and dominance group; optionally only surveys before treatment year
    ``max_time`` and only sites of one length."""
    early = F.lit(True) if max_time is None else F.col("year_trt") < max_time
    out = (
        treatment_presence(live, metrics)
        .where(F.col("di_group").isNotNull() & early)
        .groupBy("site_code", "year_trt", "trt", "di_group")
        .agg(
            F.sum((F.col("pa") == 0).cast("int")).alias("n_loss"),
            F.sum((F.col("pa") == 1).cast("int")).alias("n_kept"),
        )
        .withColumn("prop_loss", safe_div("n_loss", F.col("n_loss") + F.col("n_kept")))
    )
    if length is None:
        return out
    return out.join(site_length(live).where(F.col("length") == length).select("site_code"), "site_code", "left_semi")


def final_abundance(live: DataFrame, t_final: int = 9) -> DataFrame:
    """Cover in the final year of species present at the baseline, 0 where the plot was surveyed without them."""
    surveyed = live.where(F.col("year_trt") == t_final).select("site_code", "plot").distinct()
    at_end = F.coalesce(F.max(F.when(F.col("year_trt") == t_final, F.col("rel_cover"))), F.lit(0.0))
    return _baseline_species(live, at_end.alias("final_cover")).join(surveyed, ["site_code", "plot"], "left_semi")


def prop_lost(panel: DataFrame, grouping: str, trt: str = "trt", time: str = "year_trt", pa: str = "pa") -> DataFrame:
    """Mean, sd, n and se of the share of species absent, per time, treatment and class, from a completed panel."""
    gone = 1 - F.col(pa)
    return (
        panel.where((F.col(time) > 0) & F.col(grouping).isNotNull())
        .groupBy(time, trt, grouping)
        .agg(
            F.avg(gone).alias("mean_prop_lost"),
            F.stddev_samp(gone).alias("sd_prop_lost"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("se_prop_lost", F.col("sd_prop_lost") / F.sqrt("n"))
    )


def prop_lost_sparse(live: DataFrame, grouping: str, trts: Sequence[str] = (CONTROL, *TREATMENTS)) -> DataFrame:
    """The table of :func:`prop_lost` from presences alone, for the plots of the given treatments.

    A survey contributes as many rows as its plot has species of the class, so counts per plot and class replace the
    completed panel; the sd of a 0/1 variable follows from its mean and n. Everything is keyed by plot first, so only
    small per-plot counts are joined.
    """
    plot = ["site_code", "plot"]
    live = live.where(F.col("trt").isin(*trts))
    rows = live.where(F.col(grouping).isNotNull())
    classed = rows.select(*plot, "Taxon", grouping).distinct().groupBy(*plot, grouping).agg(
        F.count(F.lit(1)).alias("n_species")
    )
    surveys = live.where(F.col("year_trt") > 0).select(*plot, "year_trt", "trt").distinct()
    grid = (
        surveys.join(classed, plot)
        .groupBy("year_trt", "trt", grouping)
        .agg(F.sum("n_species").alias("n"))
    )
    present = (
        rows.where((F.col("year_trt") > 0) & (F.col("rel_cover") > 0))
        .groupBy("year_trt", "trt", grouping)
        .agg(F.count(F.lit(1)).alias("_present"))
    )
    p = F.col("mean_prop_lost")
    return (
        grid.join(present, ["year_trt", "trt", grouping], "left")
        .withColumn("mean_prop_lost", 1 - safe_div(F.coalesce("_present", F.lit(0)), "n"))
        .withColumn("sd_prop_lost", F.when(F.col("n") > 1, F.sqrt(p * (1 - p) * F.col("n") / (F.col("n") - 1))))
        .withColumn("se_prop_lost", F.col("sd_prop_lost") / F.sqrt("n"))
        .drop("_present")
    )


def next_survey(live: DataFrame, plot: Sequence[str] = ("site_code", "plot"), time: str = "year_trt") -> DataFrame:
    """Attach the time of the plot's next survey to every row (NULL at its last). The frame runs over later times only
    and grows with each step, so a plot is read once."""
    later = Window.partitionBy(*plot).orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, -1)
    return live.withColumn("next_survey", F.min(time).over(later))
