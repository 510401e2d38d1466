"""Expressions and cleaning on hand-made edge frames."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import expr
from riskframe.operators import clean
from riskframe.operators.aggregate import aggregate
from riskframe.operators.encode import categories, factorize, one_hot

INF = float("inf")


def test_safe_ratio(spark):
    rows = [(1, 4.0, 2.0), (2, 3.0, 0.0), (3, -3.0, 0.0), (4, 0.0, 0.0), (5, None, 1.0), (6, 1.0, None), (7, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r["k"]: r["r"] for r in df.select("k", expr.safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {1: 2.0, 2: INF, 3: -INF, 4: None, 5: None, 6: None, 7: 0.0}


def test_clamp_positive_makes_missing_zero(spark):
    df = spark.createDataFrame([(1, 3.0), (2, -1.0), (3, None), (4, 0.0)], "k int, x double")
    assert [r[0] for r in df.orderBy("k").select(expr.clamp_positive(F.col("x"))).collect()] == [3.0, 0, 0, 0]


def test_not_equal_keeps_missing(spark):
    df = spark.createDataFrame([("XNA",), (None,), ("F",)], "g string")
    assert {r[0] for r in df.where(expr.differs(F.col("g"), "XNA")).collect()} == {None, "F"}


def test_to_double(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,), ("nan",), ("",)], "t string")
    assert [r[0] for r in df.select(expr.to_double(F.col("t"))).collect()] == [1.5, None, None, None, None]
    assert [r[0] for r in df.select(expr.to_double(F.col("t"), 0.0)).collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a"), (5, "c/d: e"), (6, "b")], "k int, c string")
    codes = [r["c"] for r in factorize(df, ["c"], ["k"]).orderBy("k").collect()]
    assert codes == [0, 1, -1, 1, 2, 0]
    wide = one_hot(df, null_category=True)
    assert wide.columns == ["k", "c_a", "c_b", "c_c/d: e", "c_nan"]
    assert [tuple(r)[1:] for r in wide.orderBy("k").collect()][2] == (0, 0, 0, 1)
    with pytest.raises(ValueError):
        categories(df, ["c"], limit=2)


def test_all_missing_group_and_single_row(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0)], "k int, v double")
    got = {r["k"]: r for r in aggregate(df, "k", {"v": ["sum", "mean", "var", "median", "size", "nunique"]}).collect()}
    assert (got[1]["v_SUM"], got[1]["v_MEAN"], got[1]["v_MEDIAN"], got[1]["v_SIZE"], got[1]["v_NUNIQUE"]) == (0.0, None, None, 2, 0)
    assert got[2]["v_VAR"] is None and got[2]["v_MEDIAN"] == 5.0


def test_empty_slice_is_missing_not_zero(spark):
    df = spark.createDataFrame([(1, "A", None), (2, "B", 3.0)], "k int, c string, v double")
    got = {
        r["k"]: r
        for r in aggregate(df, "k", {"v": ["sum", "size", "nunique"]}, slices={"A_": F.col("c") == "A"}).collect()
    }
    assert (got[1]["A_v_SUM"], got[1]["A_v_SIZE"], got[1]["A_v_NUNIQUE"]) == (0.0, 1, 0)
    assert (got[2]["A_v_SUM"], got[2]["A_v_SIZE"], got[2]["A_v_NUNIQUE"]) == (None, None, None)


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, v double")
    with pytest.raises(ValueError):
        aggregate(df, "k", {"v": ["mode"]})
    with pytest.raises(ValueError):
        clean.impute(df.withColumn("w", F.lit(None).cast("double")), "k", "mode")


def test_column_filter_runs_before_row_filter(spark):
    # b is 50% complete and goes first; then only rows below half the threshold go.
    rows = [(i, 1.0 if i != 9 else None, None if i % 2 else 1.0, 1 if i != 9 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, a double, b double, TARGET int")
    step = clean.drop_sparse_columns(df, "TARGET", 80)
    assert step.columns == ["k", "a", "TARGET"]
    assert clean.drop_sparse_rows(step, 80).count() == 9
    assert clean.drop_sparse_columns(df, "TARGET", 50).columns == df.columns  # strictly below


def test_low_variation(spark):
    rows = [(1.0, 5.0, INF, -1.0, 10.0), (2.0, 5.0, 1.0, 1.0, 10.1), (9.0, 5.0, 2.0, 0.0, 9.9)]
    df = spark.createDataFrame(rows, "a double, flat double, inf double, zero_mean double, low double")
    assert clean.drop_low_variation(df, "t", 0.05).columns == ["a"]
    assert clean.drop_low_variation(df, "t", None).columns == df.columns


def test_outliers_keep_incomplete_rows(spark):
    rows = [(float(i), 1.0 if i != 3 else None, 0) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    kept = {r["a"] for r in clean.remove_outliers(df, 2.0, "y").collect()}
    assert 3.0 in kept and 0.0 not in kept and 100.0 not in kept
    none = spark.createDataFrame([(None, 1.0, 0), (2.0, None, 1)], "a double, b double, y int")
    assert clean.remove_outliers(none, 2.0, "y").count() == 0


def test_clean_and_impute_order(spark):
    rows = [(i, float(i) if i % 10 else None, 1.0, None if i % 4 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a double, flat double, TARGET int")
    out = clean.clean_and_impute(df, "TARGET", 60)
    assert out.columns == ["k", "a", "TARGET"]
    assert out.count() == 30 and dict(out.dtypes)["TARGET"] == "int"
    # the median is taken over all 36 present values, unlabelled rows included
    values = sorted(float(i) for i in range(40) if i % 10)
    assert {r["a"] for r in out.where("k = 10").collect()} == {(values[17] + values[18]) / 2}


def test_sanitize(spark):
    df = spark.createDataFrame([(1, 1.0), (2, INF), (3, None), (4, -INF), (5, 3.0), (6, math.nan)], "k int, a double")
    assert [r["a"] for r in clean.sanitize(df, keep=["k"]).orderBy("k").collect()] == [1.0, 2.0, 2.0, 2.0, 3.0, 2.0]
