"""Scans, sinks and the wide species-by-site ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sward.functions.semantics import to_number


def read_panel_csv(
    spark: SparkSession, path: str, schema: str, na: str = "NA", numeric: Sequence[str] = ()
) -> DataFrame:
    """CSV scan with an explicit schema; the NA token becomes NULL, ``numeric`` text columns a tolerant double.

    The literal text "NULL" is a category in these tables and is kept as it is.
    """
    df = spark.read.schema(schema).option("header", True).option("nullValue", na).csv(path)
    return df.withColumns({c: to_number(c) for c in numeric}) if numeric else df


def scan_csv(spark: SparkSession, path: str, schema: str, na: str = "NA") -> DataFrame:
    """Permissive CSV scan: every line gives a row. The NA token is missing; what a type cannot hold is missing too and is told
    apart by ``_unread``, the names of the columns whose text could not be read. ``_line`` holds a line that has too many or
    too few fields, else NULL."""
    wanted = StructType.fromDDL(schema)
    text = StructType([StructField(f.name, StringType()) for f in wanted] + [StructField("_line", StringType())])
    raw = spark.read.schema(text).option("header", True).option("nullValue", na).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in wanted}
    unread = [F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()]
    return raw.select(*[v.alias(c) for c, v in typed.items()], F.array_compact(F.array(*unread)).alias("_unread"), "_line")


def scan_report(df: DataFrame) -> DataFrame:
    """What a :func:`scan_csv` could not read: one row per column with its rows, missing values (unread ones included) and
    unread values, and how many lines had too many or too few fields."""
    cols = [c for c in df.columns if c not in ("_unread", "_line")]
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_line").alias("n_bad_lines"),
        *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[F.sum(F.array_contains("_unread", c).cast("long")).alias(f"_u{i}") for i, c in enumerate(cols)],
    )
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing"), F.col(f"_u{i}").alias("n_unread")) for i, c in enumerate(cols)])
    return sums.select("n_rows", "n_bad_lines", F.inline(each))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Saved-table scan, narrowed to the columns asked for so that the Parquet reader prunes the rest."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, na: str = "NA") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", na).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink. Partition columns should be low-cardinality (site, measure), never plot or species."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def ingest_wide(
    df: DataFrame, ids: Sequence[str], prefix: str = "sp.", species: str = "Taxon", value: str = "max_cover"
) -> DataFrame:
    """Species-as-columns to one row per present species: unpivot, drop zeros, strip the name prefix."""
    wide = [f"`{c}`" for c in columns_like(df, prefix=prefix)]
    long = df.unpivot([F.col(c) for c in ids], [F.col(c) for c in wide], species, value)
    return long.where(F.col(value) != 0).withColumn(
        species, F.expr(f"substr({species}, {len(prefix) + 1})")
    )
