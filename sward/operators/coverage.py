"""Sample coverage, fixed locations and the coverage-filtered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.semantics import is_true, safe_div
from sward.session import materialize, settle

# Thresholds of the series preparation.
MIN_COVERAGE = 0.8
LOCATION_CUTOFF = 0.3
YEAR_FLOOR = 1880


def coverage(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Sample coverage from species counts (or incidences) per sample.

    ``chat`` is the estimate from singletons and doubletons, ``chat_corrected`` the same with one doubleton assumed when
    there is none, ``sc`` the estimate that corrects for the unseen species.
    """
    c = F.col(n)
    out = df.groupBy(*keys).agg(
        F.sum((c == 1).cast("int")).alias("f1"),
        F.sum((c == 2).cast("int")).alias("f2"),
        F.sum(c).cast("double").alias("n_total"),
    )
    return out.withColumns(estimates())


def estimates() -> dict[str, Column]:
    """Coverage estimates from the columns f1, f2 and n_total."""
    f1, f2, total = F.col("f1").cast("double"), F.col("f2").cast("double"), F.col("n_total")
    rest = (total - 1) * f1

    def estimate(denominator_extra):
        return 1 - safe_div(f1, total) * safe_div(rest, rest + denominator_extra)

    f0 = safe_div(total - 1, total) * F.when(f2 > 0, safe_div(f1 * f1, 2 * f2)).otherwise(f1 * (f1 - 1) / 2)
    return {
        "chat": estimate(2 * f2),
        "chat_corrected": F.when(f2 > 0, estimate(2 * f2)).otherwise(estimate(F.lit(2.0))),
        "sc": F.when(f1 == 0, F.lit(1.0)).otherwise(
            1 - safe_div(f1, total) * safe_div(total * f0, total * f0 + f1)
        ),
    }


def counted(series: DataFrame, meta: DataFrame) -> DataFrame:
    """Series rows of studies that counted individuals."""
    kinds = meta.select("STUDY_ID", "ABUNDANCE_TYPE")
    t = F.col("ABUNDANCE_TYPE")
    return series.join(kinds, "STUDY_ID").where((t != "Presence/Absence") & (t != "<NA>"))


def weighed(series: DataFrame, meta: DataFrame) -> DataFrame:
    """Series rows of studies without an abundance type: those recorded biomass."""
    kinds = meta.select("STUDY_ID", "ABUNDANCE_TYPE")
    return series.join(kinds, "STUDY_ID").where(F.col("ABUNDANCE_TYPE").isNull())


def sample_coverage(series: DataFrame, meta: DataFrame) -> DataFrame:
    rows = counted(series, meta).where(F.col("Abundance") > 0)
    return coverage(rows, ["STUDY_ID", "YEAR", "SAMPLE_DESC"], "Abundance")


def incidence_coverage(series: DataFrame, meta: DataFrame) -> DataFrame:
    """Coverage of biomass studies, with the number of samples a species is in as its count."""
    incidence = (
        weighed(series, meta)
        .groupBy("STUDY_ID", "YEAR", "GENUS_SPECIES")
        .agg(F.sum(F.when(F.col("Biomass") == 0, 0).otherwise(1)).alias("incidence"))
    )
    return coverage(incidence, ["STUDY_ID", "YEAR"], "incidence")


def fixed_locations(
    df: DataFrame,
    study: str = "STUDY_ID",
    year: str = "YEAR",
    lat: str = "LATITUDE",
    lon: str = "LONGITUDE",
    cutoff: float | None = LOCATION_CUTOFF,
) -> DataFrame:
    """Studies whose mean, largest and smallest coordinates all vary little between years; every study for ``cutoff=None``,
    with a spread of NULL where it has one year."""
    per_year = df.groupBy(year, study).agg(
        *[
            fn(c).alias(f"{name}_{tag}")
            for c, name in ((lat, "lat"), (lon, "lon"))
            for fn, tag in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))
        ]
    )
    cols = [c for c in per_year.columns if c not in (year, study)]
    sds = per_year.groupBy(study).agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in cols])
    if cutoff is None:
        return sds
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.col(f"sd_{c}") < cutoff)
    return sds.where(keep)


def sample_counts(df: DataFrame) -> DataFrame:
    """Fewest and most samples per year of each study, and their ratio."""
    per_year = (
        df.select("STUDY_ID", "YEAR", "SAMPLE_DESC").distinct().groupBy("STUDY_ID", "YEAR").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_year.groupBy("STUDY_ID")
        .agg(F.min("n").alias("min_samples"), F.max("n").alias("max_samples"))
        .withColumn("prop", safe_div("min_samples", "max_samples"))
    )


def coverage_rows(series: DataFrame, meta: DataFrame, min_cov: float = MIN_COVERAGE) -> DataFrame:
    """Series rows of well-covered samples: counts by sample, biomass by year, the two sets one under the other.

    A sample holds one row per species, so its coverage is formed in a window and needs no join; a study-year may hold
    any number of samples, so the yearly coverage is grouped and joined.
    """
    keys = ["STUDY_ID", "YEAR", "SAMPLE_DESC"]
    w = Window.partitionBy(*keys)
    n = F.when(F.col("Abundance") > 0, F.col("Abundance"))
    counts = counted(series, meta).withColumns(
        {
            "f1": F.sum((n == 1).cast("int")).over(w),
            "f2": F.sum((n == 2).cast("int")).over(w),
            "n_total": F.sum(n).over(w).cast("double"),
        }
    )
    good = F.col("chat_corrected") >= min_cov
    counts = counts.withColumns(estimates()).where(good)
    by_year = settle(incidence_coverage(series, meta).where(good), "year_coverage")
    biomass = weighed(series, meta).join(by_year, ["STUDY_ID", "YEAR"])
    return counts.unionByName(biomass, allowMissingColumns=True)


def with_sample_counts(kept: DataFrame, year_floor: int = YEAR_FLOOR) -> DataFrame:
    """Kept rows after the year floor, with the sample counts of their study. ``kept`` is read twice: store it first."""
    return kept.join(settle(sample_counts(kept), "sample_counts"), "STUDY_ID").where(F.col("YEAR") > year_floor)


def coverage_filter(
    series: DataFrame, meta: DataFrame, min_cov: float = MIN_COVERAGE, year_floor: int = YEAR_FLOOR
) -> DataFrame:
    """Long form of the kept rows (MEASURE, VALUE) without measures a study never recorded."""
    kept = materialize(coverage_rows(series, meta, min_cov), "kept")
    return long_measures(with_sample_counts(kept, year_floor))


def long_measures(wide: DataFrame) -> DataFrame:
    """Abundance and Biomass columns to (MEASURE, VALUE) rows; a measure that sums to zero in a study is dropped."""
    totals = settle(
        wide.groupBy("STUDY_ID").agg(F.sum("Abundance").alias("_a"), F.sum("Biomass").alias("_b")), "study_totals"
    )
    ids = [c for c in wide.columns if c not in ("Abundance", "Biomass")]
    long = wide.join(totals, "STUDY_ID").unpivot(
        [F.col(c) for c in [*ids, "_a", "_b"]], [F.col("Abundance"), F.col("Biomass")], "MEASURE", "VALUE"
    )
    total = F.when(F.col("MEASURE") == "Abundance", F.col("_a")).otherwise(F.col("_b"))
    return long.where(is_true(total != 0)).drop("_a", "_b")
