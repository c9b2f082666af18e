"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.session import shared_folder

#: ASCII bytes that are not digits, letters or part of a longer UTF-8 character become spaces, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once in a session: a zip in the shared folder that Spark hands on."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted((root / "sward").rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    path = f"{shared_folder(spark)}/sward-{sc.applicationId}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(data.getvalue())
    stream.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the executors can import this package from then on."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts))


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def word_list(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split() if text else []


class Memo(dict):
    """A dictionary that fills itself by a function and is emptied when it outgrows ``limit``, so memory is bounded."""

    def __init__(self, fn, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def chunks(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``size`` bytes each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"") + 16
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def bounded_sample(rows: DataFrame, key: str, label: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of each label value (all of a value with fewer), chosen by a hash of the key."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    at = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(at < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
