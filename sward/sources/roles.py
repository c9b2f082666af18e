"""Community roles bound to a star schema of sales tables.

The test tables carry no ecology, so roles are bound to ``lineitem``, ``part`` and ``supplier``: a supplier is a
plot (or a sampling location), a part size class is a species, the ship year is the survey year. All operators
take their column names as arguments or use the role names below; nothing else depends on this binding.

Raw records are grouped to one row per plot, year, species and live flag *before* the supplier columns are joined,
so that only the part join sees raw rows and the later shuffle carries grouped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_YEAR = 1995
PANEL_UNIT = ["site_code", "plot", "year", "year_trt", "trt"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site_code() -> Column:
    return F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string"))


def _trt() -> Column:
    k = F.col("l_suppkey") % 4
    return F.when(k == 0, "Control").when(k == 1, "N").when(k == 2, "NP").otherwise("NPK")


def _species_columns() -> dict[str, Column]:
    t = F.col("tnum")
    return {
        "Taxon": F.concat(F.lit("T"), t.cast("string")),
        "Family": F.when(t % 4 == 0, "NULL").otherwise(F.concat(F.lit("F"), (t % 4).cast("string"))),
        "local_provenance": F.when(t % 3 == 0, "NAT").when(t % 3 == 1, "INT").otherwise("NULL"),
        "local_lifespan": F.when(t % 5 == 0, "ANNUAL")
        .when(t % 5 == 1, "PERENNIAL")
        .when(t % 5 == 2, "BIENNIAL")
        .when(t % 5 == 3, "INDETERMINATE")
        .otherwise("NULL"),
    }


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with their species number; the only place where raw rows are joined."""
    line = _table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_tax",
        (F.col("l_returnflag") != "R").cast("int").alias("live"),
        F.year("l_shipdate").alias("year"),
    )
    part = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.floor(F.lit(50) / F.col("p_size")).cast("int").alias("tnum")
    )
    return line.join(part, "l_partkey")


def _plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal", _site_code().alias("site_code")
    )


def _panel_columns() -> dict[str, Column]:
    return {
        "plot": F.col("l_suppkey"),
        "year_trt": F.col("year") - BASE_YEAR,
        "trt": _trt(),
        **_species_columns(),
    }


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover panel: one row per (site, plot, year, species, live) with the number of raw records behind it."""
    grouped = (
        _records(spark, sf_dir)
        .groupBy("l_suppkey", "year", "tnum", "live")
        .agg(
            F.sum("l_quantity").alias("max_cover"),
            F.sum("l_extendedprice").alias("mass"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )
    return (
        grouped.join(_plots(spark, sf_dir), "l_suppkey")
        .withColumns(_panel_columns())
        .select(
            *PANEL_UNIT,
            "Taxon",
            "Family",
            "local_provenance",
            "local_lifespan",
            "live",
            "max_cover",
            "mass",
            "n_records",
        )
    )


def cover_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover panel before any grouping, with the subplot of each record (duplicate audit, raw scans)."""
    return (
        _records(spark, sf_dir)
        .join(_plots(spark, sf_dir), "l_suppkey")
        .withColumns(_panel_columns())
        .select(
            *PANEL_UNIT,
            F.col("l_linenumber").alias("subplot"),
            "Taxon",
            "Family",
            "local_provenance",
            "local_lifespan",
            "live",
            F.col("l_quantity").alias("max_cover"),
        )
    )


#: Treatments of the mosaic panel.
MOSAIC_TRTS = ("Control", "N", "K", "NPK", "Fence", "NPK+Fence")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second cover panel, at subplot grain: six treatments, three subplots to a plot, in every plot one species that holds
    most of the cover but is missing from some surveys, and surveys in which nothing was found at all."""
    plot, year = F.col("l_suppkey"), F.col("year")
    leading = F.col("tnum") == 1 + plot % 3
    found = F.when(((year + plot) % 5 == 0) | (leading & ((year + plot) % 4 == 0)), 0.0).otherwise(F.col("l_quantity") * F.when(leading, 60.0).otherwise(1.0))
    records = _records(spark, sf_dir).withColumns({"subplot": (F.col("l_linenumber") % 3).cast("int"), "found": found})
    grouped = records.groupBy("l_suppkey", "year", "subplot", "tnum").agg(F.sum("found").alias("max_cover"))
    trt = F.element_at(F.array(*[F.lit(t) for t in MOSAIC_TRTS]), (plot % 6 + 1).cast("int"))
    return grouped.join(_plots(spark, sf_dir), "l_suppkey").select(
        "site_code", plot.alias("plot"), "subplot", "year", (year - BASE_YEAR).alias("year_trt"), trt.alias("trt"), F.concat(F.lit("T"), F.col("tnum").cast("string")).alias("Taxon"), "max_cover"
    )


def plot_years_from(cover_rows: DataFrame) -> DataFrame:
    """Plot-year attributes: live mass and published richness, key (site, plot, year_trt)."""
    per_species = cover_rows.groupBy("site_code", "plot", "year_trt", "trt", "Taxon").agg(F.sum("mass").alias("mass"))
    return per_species.groupBy("site_code", "plot", "year_trt", "trt").agg(
        F.sum("mass").alias("live_mass"), F.count(F.lit(1)).alias("rich")
    )


def plot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot_years_from(cover(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance series grouped to (study, year, sample, species) with both measures."""
    grouped = (
        _records(spark, sf_dir)
        .groupBy("l_suppkey", "year", "tnum")
        .agg(F.sum("l_quantity").alias("Abundance"), F.sum("l_extendedprice").alias("Biomass"))
    )
    return grouped.join(_plots(spark, sf_dir), "l_suppkey").select(
        F.col("s_nationkey").alias("STUDY_ID"),
        F.col("year").alias("YEAR"),
        F.col("l_suppkey").cast("string").alias("SAMPLE_DESC"),
        F.concat(F.lit("T"), F.col("tnum").cast("string")).alias("GENUS_SPECIES"),
        "Abundance",
        "Biomass",
    )


def series_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of each record of a series (study, year, latitude, longitude)."""
    line = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("YEAR"), "l_tax")
    return line.join(_plots(spark, sf_dir), "l_suppkey").select(
        F.col("s_nationkey").alias("STUDY_ID"),
        "YEAR",
        (F.col("s_acctbal") / 1000).alias("LATITUDE"),
        (F.col("l_tax") * 10).alias("LONGITUDE"),
    )


def travelling_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records where every third study moves north from year to year and every fifth east."""
    rows = series_locations(spark, sf_dir)
    since = F.col("YEAR") - 1992
    return rows.withColumns(
        {
            "LATITUDE": F.col("LATITUDE") + F.when(F.col("STUDY_ID") % 3 == 0, since * 0.4).otherwise(0.0),
            "LONGITUDE": F.col("LONGITUDE") + F.when(F.col("STUDY_ID") % 5 == 1, since * 0.5).otherwise(0.0),
        }
    )


def series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study metadata: the abundance type is NULL for biomass studies."""
    k = F.col("n_nationkey") % 5
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("STUDY_ID"),
        F.when(k == 1, "Presence/Absence").when(k > 1, "Count").alias("ABUNDANCE_TYPE"),
        F.col("n_name").alias("TITLE"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("TITLE"))
