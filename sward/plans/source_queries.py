"""Queries over scans and sinks: tables are written to the shared folder and read back as a user would."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.plans import shared
from sward.session import scratch
from sward.sources import read_table, read_version, scan_csv, scan_report, write_csv, write_table, write_version

#: What a field survey's file looks like: numbers as text, the NA token, and marks that are no numbers.
FIELD_DDL = "site_code string, plot int, year int, Taxon string, live int, max_cover double"


def _field_file(spark, sf) -> str:
    """Cover records as a CSV file with missing and unreadable covers."""
    rows = shared.cover(spark, sf)
    text = F.when(F.col("Taxon") == "T7", None).when(F.col("plot") % 11 == 0, "n.d.").otherwise(F.col("max_cover").cast("string"))
    path = scratch(spark, "field")
    write_csv(rows.select("site_code", "plot", "year", "Taxon", "live", text.alias("max_cover")), path)
    return path


def field_scan(spark, sf):
    """The field file, typed; which columns of a row could not be read."""
    rows = scan_csv(spark, _field_file(spark, sf), FIELD_DDL)
    return rows.select("site_code", "plot", "year", "Taxon", "live", "max_cover", F.concat_ws(",", "_unread").alias("unread"))


def field_scan_report(spark, sf):
    """How many values of each column of the field file are missing, and how many could not be read."""
    return scan_report(scan_csv(spark, _field_file(spark, sf), FIELD_DDL))


def csv_roundtrip(spark, sf):
    """Plot-year biomass through the CSV sink and back, missing values as the NA token."""
    rows = shared.plot_years(spark, sf).select("site_code", "plot", "year_trt", "trt", F.when(F.col("plot") % 5 != 0, F.col("live_mass")).alias("live_mass"))
    folder = scratch(spark, "csv")
    return read_version(spark, folder, write_version(rows, folder, "csv"))


def saved_table_roundtrip(spark, sf):
    """Shares of the prepared table, saved by site and read back narrowed and filtered."""
    folder = scratch(spark, "saved")
    write_table(shared.enriched(spark, sf).select("site_code", "plot", "year", "Taxon", "rel_cover", "di"), folder, ["site_code"])
    return read_table(spark, folder, ["site_code", "plot", "year", "Taxon", "rel_cover"]).where("site_code = 'S1'")


def _both(spark, folder: str, numbers: list[int]) -> DataFrame:
    each = [read_version(spark, folder, n).withColumn("version", F.lit(n)) for n in numbers]
    return reduce(DataFrame.unionByName, each)


def table_versions(spark, sf):
    """Two versions of the presence table: all surveys, then those after the start. Both stay readable."""
    rows = shared.enriched(spark, sf).select("site_code", "plot", "year_trt", "Taxon")
    folder = scratch(spark, "presence")
    numbers = [write_version(rows, folder, partition_by=["site_code"]), write_version(rows.where("year_trt > 0"), folder, partition_by=["site_code"])]
    return _both(spark, folder, numbers).groupBy("version", "site_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Taxon").alias("n_species"))


def result_versions(spark, sf):
    """A result table in two versions: cover by treatment with and without the species never dominant."""
    rows = shared.enriched(spark, sf)
    folder = scratch(spark, "result")

    def result(df):
        return df.groupBy("trt", "year_trt").agg(F.sum("max_cover").alias("cover"), F.count(F.lit(1)).alias("n"))

    numbers = [write_version(result(rows), folder), write_version(result(rows.where("di_class = 'Dominant'")), folder)]
    return _both(spark, folder, numbers)


QUERIES = {f.__name__: f for f in (field_scan, field_scan_report, csv_roundtrip, saved_table_roundtrip, table_versions, result_versions)}
