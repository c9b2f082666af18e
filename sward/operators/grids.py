"""Parameter grids and predictions on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.functions.semantics import inverse_logit


def even(spark: SparkSession, name: str, low: float, high: float, n: int) -> DataFrame:
    """n evenly spaced numbers from low to high."""
    step = (high - low) / (n - 1)
    return spark.range(n).select((F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias(name))


def values(spark: SparkSession, name: str, items) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in items])).alias(name))


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of the axes. Axes after the first must be short lists made by :func:`even` or :func:`values`,
    whose size is stated in the call; the first one may be a table (e.g. one row per study) of any size."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def predict_grid(coefficients: DataFrame, axis: DataFrame, x: str, link: str = "logit", z: float = 1.96) -> DataFrame:
    """Fit and interval of ``b0 + b1 x`` on a grid, for every row of coefficients (v00, v01, v11: their covariance).

    The interval is the closed-form one on the scale of the link, mapped back.
    """
    g = grid(coefficients, axis)
    xc = F.col(x)
    eta = F.col("b0") + F.col("b1") * xc
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("v00") + 2 * xc * F.col("v01") + xc * xc * F.col("v11")))
    back = inverse_logit if link == "logit" else (lambda c: c)
    return g.select(
        *[c for c in coefficients.columns if c not in ("b0", "b1", "v00", "v01", "v11")],
        x,
        back(eta).alias("fit"),
        back(eta - z * se).alias("lwr"),
        back(eta + z * se).alias("upr"),
    )
