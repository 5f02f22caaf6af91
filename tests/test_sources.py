"""CSV reading with NA tokens and malformed lines; set operators; densities and histograms of several columns."""

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from cohortlab.operators import profile
from cohortlab.operators.joins import compare_sets
from cohortlab.sources.tables import read_entities


def test_malformed_lines_are_flagged_and_read_as_far_as_they_go(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2.5,x\n2,N/A,\n3,bad,y\n4,1.0\n5,2.0,z,extra\n,NaN,w\n")
    schema = T.StructType.fromDDL("id long, v double, s string")
    got = sorted(map(tuple, read_entities(spark, str(tmp_path), schema, header=False, corrupt="malformed").collect()), key=str)
    assert got == sorted([(1, 2.5, "x", False), (2, None, None, False), (3, None, "y", False), (4, 1.0, None, True), (5, 2.0, "z", True), (None, None, "w", False)], key=str)


def test_sets_compare_nulls_as_equal(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("y",)], "f string")
    b = spark.createDataFrame([("y",), (None,), ("z",)], "f string")
    assert {(r.f, r.status) for r in compare_sets(a, b).collect()} == {("x", "dropped"), ("y", "shared"), (None, "shared"), ("z", "new")}
    assert compare_sets(a, b).count() == 4


def test_histograms_and_densities_of_several_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=700), "b": rng.integers(0, 3, 700).astype(float), "c": np.full(700, 2.0)})
    df = spark.createDataFrame(pdf).selectExpr("a", "b", "c", "cast(null as double) as d").repartition(5)
    h = profile.histograms(df, ["a", "b", "c", "d"], 10).toPandas()
    for c in "ab":
        assert h[h["column"] == c].sort_values("bin")["n"].tolist() == np.histogram(pdf[c], 10)[0].tolist()
    assert h[h["column"] == "c"]["n"].sum() == 700 and not (h["column"] == "d").any()
    k = profile.kdes(df, ["a", "b", "c", "d"], 50).toPandas()
    assert set(k["column"]) == {"a", "b"}
    for c in "ab":
        v, mine = pdf[c].to_numpy(), k[k["column"] == c].sort_values("point")
        width = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((mine["x"].to_numpy()[:, None] - v) / width) ** 2).sum(1) / (len(v) * width * np.sqrt(2 * np.pi))
        assert np.allclose(mine["density"], want)
    binned = profile.kdes(df, ["a"], 50, bins=2000).toPandas().sort_values("point")
    assert np.allclose(binned["density"], k[k["column"] == "a"].sort_values("point")["density"], atol=2e-3)
    assert "Generate" not in profile.kdes(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
