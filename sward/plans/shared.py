"""Prepared tables that many queries start from, written once per session to the shared folder.

The grouped cover table is far smaller than the raw records and feeds nearly every query, several of them more than
once. It is written as Parquet, stored by plot, so that every later grouping or window by plot, plot-year or
plot-species starts without a shuffle and reads only the columns it needs. ``release`` deletes the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward import operators as op
from sward.session import at_most, bucket_count, cleanup, evict, materialize, settle
from sward.sources import roles

PLOT = ("site_code", "plot")
Folder = tuple[str, str]
_KEPT: dict[Folder, dict[str, DataFrame]] = {}
_SEEN: dict[Folder, int] = {}
_STALE: dict[Folder, list[DataFrame]] = {}


def _listing(spark: SparkSession, sf_dir: str) -> int:
    """Hash of path, size and time of every file in the folder: another value as soon as a table is rewritten."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def fresh(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The prepared tables of a folder. Once the folder's files have changed they are set aside, and those set aside before
    are deleted: a frame that was handed out before one change can still be read, not one from before two."""
    at = (spark.sparkContext.applicationId, sf_dir)
    now = _listing(spark, sf_dir)
    if _SEEN.get(at) != now:
        for old in _STALE.pop(at, []):
            evict(old)
        _STALE[at] = list(_KEPT.pop(at, {}).values())
        _SEEN[at] = now
    return _KEPT.setdefault(at, {})


def keep(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], bucket_by: Sequence[str] = (), **how
) -> DataFrame:
    own = fresh(spark, sf_dir)
    if name not in own:
        table = materialize(build(), name, bucket_by, **how)
        own = fresh(spark, sf_dir)
        own[name] = table
    return own[name]


def release(spark: SparkSession) -> None:
    for kept in (_KEPT, _SEEN, _STALE):
        for at in [k for k in kept if k[0] == spark.sparkContext.applicationId]:
            del kept[at]
    cleanup(spark)


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(spark, sf_dir, "cover", lambda: roles.cover(spark, sf_dir), PLOT)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live cover with shares, baseline, dominance index and classes.

    The frequency table is written and counted first. While it is small it is broadcast, the cover rows stay in the
    buckets they were stored in, and nothing is shuffled; otherwise it is joined by key and the rows are placed again.
    """
    if "enriched" in fresh(spark, sf_dir):
        return fresh(spark, sf_dir)["enriched"]
    rows = cover(spark, sf_dir)
    freq = keep(spark, sf_dir, "freq", lambda: op.rel_freq_space(rows.where(F.col("live") == 1)))
    small = at_most(freq, 200_000)
    return keep(
        spark,
        sf_dir,
        "enriched",
        lambda: op.enriched_cover(rows, F.broadcast(freq) if small else freq, cluster=False),
        PLOT,
        buckets=bucket_count(roles.cover(spark, sf_dir)),
        placed=small,
    )


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subplot-level cover with shares, baseline share and abundance class, stored by plot."""

    def build():
        rows = op.relative_abundance(roles.mosaic(spark, sf_dir), ["site_code", "plot", "subplot", "year"], "max_cover").withColumnRenamed("rel", "rel_cover")
        rows = op.baseline(rows, [*PLOT, "Taxon"], "year_trt", "rel_cover", name="rel_t0")
        return rows.withColumn("rel_class", op.cut_class("rel_t0"))

    return keep(spark, sf_dir, "mosaic", build, PLOT)


def plot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.plot_years_from(cover(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline metrics and dominance groups per (site, species)."""
    return keep(
        spark, sf_dir, "metrics", lambda: op.dominance_groups(op.site_species_metrics(enriched(spark, sf_dir)))
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed cover panel. The rows are stored by plot already, so nothing needs placing."""
    return op.complete_panel(
        enriched(spark, sf_dir), ["site_code"], ["plot", "year_trt", "trt"], "Taxon", "rel_cover"
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series rows of the studies that stayed at one place, stored by sample; all later steps start from them."""

    def build():
        fixed = settle(op.fixed_locations(roles.series_locations(spark, sf_dir)).select("STUDY_ID"), "fixed_studies")
        return roles.series(spark, sf_dir).join(fixed, "STUDY_ID", "left_semi")

    return keep(spark, sf_dir, "series", build, ("STUDY_ID", "YEAR", "SAMPLE_DESC"))


def kept_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of well-covered samples."""
    return keep(
        spark, sf_dir, "kept", lambda: op.coverage_rows(series(spark, sf_dir), roles.series_meta(spark, sf_dir))
    )


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage-filtered series in long form, summed over samples."""

    def build():
        kept = op.long_measures(op.with_sample_counts(kept_series(spark, sf_dir)))
        return kept.groupBy("STUDY_ID", "MEASURE", "YEAR", "GENUS_SPECIES").agg(F.sum("VALUE").alias("VALUE"))

    return keep(spark, sf_dir, "long_series", build)


def series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed species series of every study and measure."""
    return keep(spark, sf_dir, "series_panel", lambda: op.series_panel(long_series(spark, sf_dir)))


def at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling rows of loss between surveys; the iterative fits read it many times."""
    return keep(spark, sf_dir, "at_risk", lambda: op.lagged_loss_set(enriched(spark, sf_dir)))


def pair_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(
        spark, sf_dir, "pair_ranks", lambda: op.abundance_biomass_ranks(series_panel(spark, sf_dir))
    )
