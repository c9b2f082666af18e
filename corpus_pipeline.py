"""A training-corpus pipeline over ``documents``: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed documents. The models and the benchmark come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sward.llm import decontaminate, near_duplicates, packing, pii, quality
from sward.llm.common import read
from sward.session import materialize

#: Words in a shingle and least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of the ``documents`` table."""
    model = quality.train(read(spark, sf_dir, "documents"), quality.training_rows(read(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return near_duplicates.without_copies(docs, k=SHINGLE, limit=SIMILAR)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by the names of their kinds."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: Trained and iterative stages have no SQL form; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
