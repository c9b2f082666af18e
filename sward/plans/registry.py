"""All queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.plans import (
    cover_oracles,
    cover_queries,
    effect_oracles,
    effect_queries,
    model_oracles,
    model_queries,
    series_oracles,
    series_queries,
    source_oracles,
    source_queries,
)

_MODULES = [
    (cover_queries, cover_oracles),
    (effect_queries, effect_oracles),
    (series_queries, series_oracles),
    (model_queries, model_oracles),
    (source_queries, source_oracles),
]


DIGITS = 9  # significant digits of a double
TIES_UP = 1 + 1e-12  # so that an exact tie (cents over 64) does not hang on the last bit of a sum
SMALLEST = 12  # and the last decimal place at most: what is left below comes from the order of summation


def presented(df: DataFrame) -> DataFrame:
    """Output form: doubles rounded to the same number of significant digits whatever their size, all integers of one
    width. Both apply to the final projection only."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = c.cast("double")
            places = F.least(F.lit(SMALLEST), F.lit(DIGITS - 1) - F.floor(F.log10(F.abs(x))))
            scale = F.pow(F.lit(10.0), places)
            c = F.when(x == 0, F.lit(0.0)).when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x * scale * TIES_UP) / scale + 0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _present(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _present(fn) for m, _ in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for _, o in _MODULES for name, text in o.ORACLES.items()}
