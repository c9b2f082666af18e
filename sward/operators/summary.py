"""Summary statistics, counts and their shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.semantics import as_col, is_true, safe_div
from sward.operators.order import attach, exact_quantiles
from sward.session import settle


def bar_stats(df: DataFrame, value: str | Column, by: Sequence[str]) -> DataFrame:
    """N, mean, standard deviation and standard error per group; sd and se of a single row are NULL."""
    v = as_col(value)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
        .withColumn("se", F.col("sd") / F.sqrt("n"))
    )


def prop_by(df: DataFrame, flag: str, by: Sequence[str]) -> DataFrame:
    """Counts of flag 0 and 1 per group and the share of ones; rows with an unknown flag are left out."""
    f = F.col(flag).cast("int")
    return (
        df.groupBy(*by)
        .agg(
            F.sum((f == 0).cast("int")).alias("n0"),
            F.sum((f == 1).cast("int")).alias("n1"),
        )
        .withColumn("prop", safe_div("n1", F.col("n0") + F.col("n1")))
    )


def six_num(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count, one row per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.sum(F.col("value").isNull().cast("int")).alias("n_null"),
    )
    q = exact_quantiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basic.join(q, "column", "left").select("column", "min", "q1", "median", "mean", "q3", "max", "n_null")


def _limits(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))


def _bin(col: str, n: int) -> Column:
    """Bin number 1..n over [_lo, _hi]; the largest value belongs to the last bin."""
    step = (F.col("_hi") - F.col("_lo")) / n
    return F.when(F.col(col).isNull(), F.lit(None)).otherwise(
        F.least(F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("_lo"), step)), F.lit(0)), F.lit(n - 1)) + 1
    ).cast("int")


def equal_width_class(df: DataFrame, col: str, n: int, name: str = "bin") -> DataFrame:
    """Equal-width interval number over the range of the data."""
    return attach(df, _limits(df, col), []).withColumn(name, _bin(col, n)).drop("_lo", "_hi")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin (empty bins left out), optionally per group; bins are shared by all groups."""
    b = attach(df.where(F.col(col).isNotNull()).select(*by, col), _limits(df, col), []).withColumn(
        "bin", _bin(col, bins)
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    return (
        b.groupBy(*by, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + step * (F.col("bin") - 1)).alias("lo"),
            (F.col("_lo") + step * F.col("bin")).alias("hi"),
            "n",
        )
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Box-plot table: quartiles, the most extreme values within 1.5 box lengths of the box, and the outlier count."""
    q = settle(exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "quartiles")
    span = (F.col("q3") - F.col("q1")) * whisker
    inside = (F.col(value) >= F.col("q1") - span) & (F.col(value) <= F.col("q3") + span)
    rows = attach(df.where(F.col(value).isNotNull()), q, by, "inner")
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("lo_whisker"),
        F.max(F.when(inside, F.col(value))).alias("hi_whisker"),
        F.sum((~inside).cast("int")).alias("n_out"),
    )


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence, prefix: str = "n_") -> DataFrame:
    """Two-way counts with the column values given, so that the width of the result is fixed."""
    return df.groupBy(a).agg(
        *[F.sum(is_true(F.col(b) == v).cast("int")).alias(f"{prefix}{v}") for v in b_values]
    )


def kept_ratio(before: DataFrame, after: DataFrame, study: str) -> DataFrame:
    """Share of rows and of studies that a filter kept, as one row."""
    def counts(df, tag):
        per = df.groupBy(study).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.sum("n").alias(f"rows_{tag}"), F.count(F.lit(1)).alias(f"studies_{tag}"))

    return (
        counts(before, "before")
        .crossJoin(F.broadcast(counts(after, "after")))
        .select(
            "rows_before",
            F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
            safe_div(F.coalesce("rows_after", F.lit(0)), "rows_before").alias("row_ratio"),
            safe_div("studies_after", "studies_before").alias("study_ratio"),
        )
    )


def mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows disagree between two columns computed in two ways: 0 is a pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(is_true(F.col(a) != F.col(b)).cast("int")).alias("n_mismatch"))


def overall(df: DataFrame, value: str) -> DataFrame:
    """Global mean and standard deviation of a column and the rows behind them."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def binned_trend(df: DataFrame, x: str, y: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Local mean of y with its standard error in bins of x (a smoothed trend as a table)."""
    b = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(
        "bin", F.floor(F.col(x) / F.lit(width)).cast("long")
    )
    out = bar_stats(b, y, [*by, "bin"])
    return out.select(*by, "bin", (F.col("bin") * width).alias("x_lo"), "n", "mean", "sd", "se")


def bin2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Counts on a grid of two axes."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            F.floor(F.col(x) / F.lit(x_width)).cast("long").alias("x_bin"),
            F.floor(F.col(y) / F.lit(y_width)).cast("long").alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def richness_compare(
    raw: DataFrame, published: DataFrame, all_rows: DataFrame, family: str = "Family"
) -> DataFrame:
    """Richness of a plot-year by three definitions next to the published one, where any two disagree.

    ``raw``: live rows kept for the analysis; ``all_rows``: live rows of the source. Rows of species whose family is the
    text "NULL" are not counted.
    """
    named = raw.where(F.col(family) != "NULL")
    unit = ["year_trt", "site_code", "plot"]
    records = named.groupBy(*unit, "trt").agg(F.sum("n_records").alias("richness_records"))
    taxa = named.select(*unit, "Taxon").distinct().groupBy(*unit).agg(F.count(F.lit(1)).alias("richness_taxa"))
    source = (
        all_rows.where(F.col(family) != "NULL")
        .select(*unit, "Taxon")
        .distinct()
        .groupBy(*unit)
        .agg(F.count(F.lit(1)).alias("richness_source"))
    )
    return (
        published.select(*unit, "rich")
        .join(records, unit)
        .join(taxa, unit)
        .join(source, unit)
        .where(
            (F.col("richness_records") != F.col("rich"))
            | (F.col("richness_taxa") != F.col("rich"))
            | (F.col("richness_records") != F.col("richness_taxa"))
        )
    )
