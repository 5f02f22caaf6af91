import math

from pyspark.sql import functions as F

from cohortlab.functions.columns import band, clip_lower, hash_prefix, in_test_split, map_values, ratio_feature, strip_ws, title_case


def test_title_case_matches_python_title(spark):
    vals = ["full-time", "o'neil", "2ND", " PHD\t", "4-NOT SPECIFIED", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(title_case(strip_ws("s"))).collect()]
    assert got == [v.strip().title() if v is not None else None for v in vals]


def test_strip_removes_tabs_but_trim_does_not(spark):
    df = spark.createDataFrame([("  a\t",)], "s string")
    r = df.select(strip_ws("s").alias("a"), F.trim("s").alias("b")).collect()[0]
    assert r["a"] == "a" and r["b"] != "a"


def test_clip_keeps_null_and_nan_semantics(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (None,)], "x double")
    got = [r[0] for r in df.select(clip_lower("x", 0.0)).collect()]
    assert got == [0.0, 0.0, 2.0, None]
    # greatest() would turn NULL into the bound
    assert df.select(F.greatest("x", F.lit(0.0))).collect()[3][0] == 0.0


def test_band_first_match_and_inclusive(spark):
    df = spark.createDataFrame([(0.6,), (0.5,), (0.31,), (0.1,)], "r double")
    bands = ((0.5, "strong"), (0.3, "moderate"), (None, "weak"))
    assert [r[0] for r in df.select(band("r", bands)).collect()] == ["strong", "moderate", "moderate", "weak"]
    assert [r[0] for r in df.select(band("r", bands, inclusive=True)).collect()] == ["strong", "strong", "moderate", "weak"]


def test_map_values_keep_unmapped(spark):
    df = spark.createDataFrame([("A",), ("b",), (None,)], "s string")
    got = [r[0] for r in df.select(map_values("s", {"A": "x"})).collect()]
    assert got == ["x", "b", None]


def test_ratio_feature_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 0.2)], "a double, b double")
    got = [r[0] for r in df.select(ratio_feature("a", "b", offset=1.0)).collect()]
    assert got[0] is None and math.isclose(got[1], 2.0 / 1.2)
    fl = [r[0] for r in df.select(ratio_feature("a", "b", floor=0.5)).collect()]
    assert fl == [2.0, 4.0]


def test_hash_split_fraction_and_stability(spark):
    assert hash_prefix(0.3) == "4ccccccc"
    df = spark.range(20000).withColumn("t", in_test_split("id", 0.3, 42))
    a = df.where("t").count()
    b = df.repartition(13).where("t").count()
    assert a == b and abs(a / 20000 - 0.3) < 0.02
