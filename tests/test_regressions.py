"""NULLs, ties, empty bins and single groups in the profile, rate, split and moment operators."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.columns import band, below_band
from cohortlab.operators import linear, moments, profile, quantiles, rates, sampling


def test_gram_uses_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0), (4.0, 4.0), (5.0, None)], "x double, y double")
    fit = linear.ols(moments.gram(df, ["x"], "y")[None])
    assert fit.coef[0] == pytest.approx(1.0) and fit.intercept == pytest.approx(0.0)


def test_null_stratum_is_a_stratum(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(90)], "id long, s string")
    got = {r["s"]: r["n"] for r in sampling.stratified_split(df, "id", "s", 0.3, 7).where("is_test").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {None: 9, "a": 9, "b": 9}
    assert sampling.stratified_sample(df, "id", "s", 30, 7).where("in_sample").count() == 30


def test_quantiles_and_boxes_of_a_null_group(spark):
    df = spark.createDataFrame([(None if i < 5 else "g", float(i)) for i in range(10)], "k string, v double")
    got = {r["k"]: r["value"] for r in quantiles.exact_quantiles(df, ["v"], [0.5], by=["k"]).collect()}
    assert got == {None: 2.0, "g": 7.0}
    assert {r["k"]: r["n"] for r in profile.box_stats(df, ["v"], by=["k"]).collect()} == {None: 5, "g": 5}


def test_modes_take_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert [(r["value"], r["n"]) for r in quantiles.exact_modes(df, ["v"]).collect()] == [("a", 2)]


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "v", 5).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}


def test_extremes_of_one_group_and_of_ties(spark):
    one = spark.createDataFrame([("a", 1.0), ("z", None)], "g string, v double")
    assert sorted((r["which"], r["g"]) for r in rates.extremes(one, "v", "g").collect()) == [("highest", "a"), ("lowest", "a")]
    ties = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "g string, v double")
    assert {r["g"] for r in rates.extremes(ties, "v", "g").collect()} == {"a"}
    assert rates.extremes(one.limit(0), "v", "g").count() == 0


def test_null_has_no_band(spark):
    df = spark.createDataFrame([(None,), (0.9,)], "r double")
    got = df.select(band("r", ((0.5, "high"), (None, "low"))).alias("b"), below_band("r", [(0.5, "low")], "fair").alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("high", "fair")]
