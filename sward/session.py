"""Session, checkpoint and prepared-table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "sward") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.driver.memory", os.environ.get("SWARD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session without one gets a temporary
    folder; on a cluster a machine-local folder would be lost with its machine, so it is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="sward-")
    return _LOCAL[sc.applicationId]


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs a re-read, not a re-run."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


BUCKET_BYTES = 64 << 20


def bucket_count(df: DataFrame) -> int:
    """One bucket per 64 MB of source files, at least one per core and at most the session's shuffle partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, size // BUCKET_BYTES)))


def materialize(
    df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int | None = None, placed: bool = False
) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Unlike a checkpoint the result is columnar: later reads prune columns, push filters down and know the true size, so
    Spark picks broadcast joins by measured size. With ``bucket_by`` the rows are stored by the hash of those columns
    and later groupings and windows by any superset of them need no shuffle. ``placed`` states that the rows come from a
    table of the same ``buckets`` and have not moved since, so they are written where they are. :func:`cleanup` deletes
    what was written.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    tag = uuid.uuid4().hex[:12]
    path = f"{shared_folder(spark)}/sward-{app}/{name}-{tag}"
    _WRITTEN.setdefault(app, []).append(path)
    if not bucket_by:
        df.write.parquet(path)
        return spark.read.parquet(path)
    n = buckets or bucket_count(df)
    table = f"sward_{name}_{tag}"
    _TABLES.setdefault(app, []).append(table)
    rows = df if placed else df.repartition(n, *bucket_by)
    rows.write.format("parquet").bucketBy(n, *bucket_by).option("path", path).saveAsTable(table)
    return spark.table(table)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder within the shared folder, deleted by :func:`cleanup`."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/sward-{app}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(app, []).append(path)
    return path


def settle(df: DataFrame, name: str = "small") -> DataFrame:
    """Store a table of one row per group before it is joined to rows.

    The planner takes an aggregate to be as large as its input and would shuffle the rows for it; stored, its size is
    measured, so it is broadcast exactly when it is small and joined by key when it is not.
    """
    return materialize(df, name)


def discard(df: DataFrame) -> None:
    """Delete a table stored with :func:`materialize` (without buckets) that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def evict(df: DataFrame) -> None:
    """Delete a table stored with :func:`materialize`, with its entry in the catalog if it was stored by buckets."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    for file in df.inputFiles()[:1]:
        name, tag = file.rsplit("/", 2)[-2].rsplit("-", 1)
        if (table := f"sward_{name}_{tag}") in _TABLES.get(app, []):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            _TABLES[app].remove(table)
    discard(df)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most ``rows`` rows; reads no more than one row beyond the limit per partition."""
    return df.limit(rows + 1).count() <= rows


def cleanup(spark: SparkSession) -> None:
    """Delete the tables this session wrote with :func:`materialize`."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
