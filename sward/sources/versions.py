"""Versioned results: a write becomes visible as a whole or not at all, and earlier versions stay readable."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_versions"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that nobody else has created; the file system decides between two writers."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        fs.create(p, False).close()
    except Exception as e:  # the other writer was first
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, p = _fs(spark, f"{folder}/{_MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def write_version(df: DataFrame, folder: str, fmt: str = "parquet", partition_by: Sequence[str] = (), na: str = "NA") -> int:
    """Write ``df`` as the next version of a table in ``folder`` and return its number.

    Rows are written to a folder of their own first. Then a version number is claimed, and a manifest that names the folder
    and the schema is moved into place: readers see it whole or not at all. A write that fails, or a driver that is lost,
    leaves files that no manifest names. Partition columns should be low-cardinality (site, measure), never plot or species.
    """
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("nullValue", na)
    (w.partitionBy(*partition_by) if partition_by else w).save(f"{folder}/{data}")
    number = max(versions(spark, folder), default=0) + 1
    while not _claim(spark, f"{folder}/{_MANIFESTS}/{number}.claim"):
        number += 1
    text = json.dumps({"version": number, "data": data, "format": fmt, "na": na, "schema": json.loads(df.schema.json())})
    fs, aside = _fs(spark, f"{folder}/{_MANIFESTS}/.{data}")
    out = fs.create(aside, True)
    out.write(text.encode())
    out.close()
    if not fs.rename(aside, _fs(spark, f"{folder}/{_MANIFESTS}/{number}.json")[1]):
        raise OSError(f"version {number} could not be committed")
    return number


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or the named one, with the schema it was written with."""
    from pyspark.sql.types import StructType

    known = versions(spark, folder)
    number = known[-1] if version is None and known else version
    if number not in known:
        raise ValueError(f"no version {version} in {folder}: there are {known}")
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{_MANIFESTS}/{number}.json").collect())  # one small file
    made = json.loads(text)
    r = spark.read.format(made["format"]).schema(StructType.fromJson(made["schema"]))
    if made["format"] == "csv":
        r = r.option("header", True).option("nullValue", made["na"])
    return r.load(f"{folder}/{made['data']}")
