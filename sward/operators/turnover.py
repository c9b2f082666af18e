"""Species appearing and disappearing between surveys of a unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turnover(
    df: DataFrame, unit: Sequence[str], time: str, species: str, reference: str = "first"
) -> DataFrame:
    """Appearances, disappearances and total species of each survey against the first (or the previous) one.

    A species is shared when its own first (previous) survey is the unit's first (previous) survey, so sets are never
    built and nothing is joined: species are counted by (survey, own reference survey), and the unit's reference survey
    is found among its few surveys.
    """
    unit = list(unit)
    rows = df.select(*unit, time, species).distinct()
    by_species = Window.partitionBy(*unit, species)
    by_unit = Window.partitionBy(*unit)
    surveys = by_unit.orderBy(time)
    if reference == "first":
        own = F.min(time).over(by_species)
        unit_ref = F.min(time).over(by_unit)
        n_ref = F.first("n_now").over(surveys)
    elif reference == "previous":
        own = F.lag(time).over(by_species.orderBy(time))
        unit_ref = F.max(time).over(surveys.rangeBetween(Window.unboundedPreceding, -1))
        n_ref = F.lag("n_now").over(surveys)
    else:
        raise ValueError(f"unknown reference: {reference}")
    # at most surveys x surveys rows per unit from here
    counts = rows.withColumn("_own", own).groupBy(*unit, time, "_own").agg(F.count(F.lit(1)).alias("_n"))
    per_time = (
        counts.withColumn("_ref", unit_ref)
        .groupBy(*unit, time, "_ref")
        .agg(
            F.sum("_n").alias("n_now"),
            F.sum(F.when(F.col("_own") == F.col("_ref"), F.col("_n")).otherwise(0)).alias("n_common"),
        )
        .withColumn("n_ref", n_ref)
    )
    return per_time.where(F.col("_ref") < F.col(time)).select(
        *unit,
        time,
        (F.col("n_now") - F.col("n_common")).alias("appear"),
        (F.col("n_ref") - F.col("n_common")).alias("disappear"),
        (F.col("n_now") + F.col("n_ref") - F.col("n_common")).alias("total"),
    )
