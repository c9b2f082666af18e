"""One test per reading of missing values, zero denominators, ties and edges."""

import math

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from sward.functions import semantics as sem


def column(spark, values, expr, ddl="x double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_class_edges(spark):
    got = column(spark, [0.0, 0.2, 0.21, 0.8, 0.81, 1.0, 1.01, None], sem.cut_class("x"))
    assert got == [None, "Rare", "Subordinate", "Subordinate", "Dominant", "Dominant", None, None]


def test_class_lowest_included(spark):
    got = column(spark, [0.0, 0.5, 1.0], sem.cut_class("x", (0, 0.5, 1), ("low", "high"), include_lowest=True))
    assert got == ["low", "low", "high"]


def test_class_needs_matching_labels():
    with pytest.raises(ValueError):
        sem.cut_class("x", (0, 1), ("a", "b"))


def test_non_rare_never_null(spark):
    assert column(spark, ["Rare", "Subordinate", "Dominant", None], sem.non_rare("x"), "x string") == [
        False,
        True,
        True,
        False,
    ]


def test_strict_sum(rows):
    df = rows("g string, x double", [("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)])
    got = df.groupBy("g").agg(sem.na_agg(F.sum, "x").alias("c"), sem.na_agg(F.sum, "x", False).alias("s"))
    assert as_dict(got, "g", "c") == {"a": 1.0, "b": 3.0}
    assert as_dict(got, "g", "s") == {"a": None, "b": 3.0}


def test_safe_and_corrected_division(rows):
    df = rows("i int, n double, d double", [(0, 1.0, 2.0), (1, 1.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0)])
    got = df.select("i", sem.safe_div("n", "d").alias("s"), sem.corrected_div("n", "d").alias("c"))
    assert as_dict(got, "i", "s") == {0: 0.5, 1: None, 2: None, 3: None}
    assert as_dict(got, "i", "c") == {0: 0.5, 1: 1.0, 2: 0.0, 3: None}


def test_log_of_absence_is_null(spark):
    assert column(spark, [0.0, 1.0], sem.positive_ln("x")) == [None, 0.0]


def test_rescale_zero_range(rows):
    df = rows("x double, lo double, hi double", [(7.0, 7.0, 7.0)])
    assert df.select(sem.rescale("x", "lo", "hi")).first()[0] == 0.5


def test_tolerant_number(spark):
    assert column(spark, ["1.5", "NULL", None], sem.to_number("x"), "x string") == [1.5, None, None]


def test_recode(spark):
    vals = ["NULL", "INT", "x"]
    assert column(spark, vals, sem.recode("x", {"NULL": "UNK"}), "x string") == ["UNK", "INT", "x"]
    assert column(spark, vals, sem.recode("x", {"NULL": "UNK"}, keep_other=False), "x string") == ["UNK", None, None]


def test_labels_and_logit(spark):
    assert column(spark, [5], sem.years_label("x"), "x int") == ["5 years"]
    assert column(spark, ["a", None], sem.key_label("x", F.lit(1)), "x string") == ["a_1", "NA_1"]
    assert math.isclose(column(spark, [0.0], sem.inverse_logit("x"))[0], 0.5)


def test_pct_diff_zero_control(rows):
    df = rows("t double, c double", [(3.0, 2.0), (1.0, 0.0)])
    assert [r[0] for r in df.select(sem.pct_diff("t", "c")).collect()] == [50.0, None]
