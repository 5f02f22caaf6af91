import numpy as np
import pandas as pd

from cohortlab.operators.quantiles import exact_modes, exact_quantiles


def test_exact_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2.0, 3.0, 5000), 1)  # many duplicates
    y = rng.integers(0, 5, 5000).astype(float)
    g = rng.integers(0, 3, 5000)
    pdf = pd.DataFrame({"x": x, "y": y, "g": g})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("nanvl(x, null) as x", "y", "g")
    probs = [0.0, 0.25, 0.33, 0.5, 0.75, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x", "y"], probs, buckets=16).collect()}
    for c in ("x", "y"):
        v = pdf[c].dropna().to_numpy()
        for p in probs:
            assert abs(got[(c, p)] - np.quantile(v, p)) < 1e-9
    by = {(r["g"], r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], [0.5], by=["g"], buckets=8).collect()}
    for k in range(3):
        assert abs(by[(k, "x", 0.5)] - pdf[pdf.g == k]["x"].median()) < 1e-9


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    r = exact_modes(df, ["c"]).collect()[0]
    assert r["value"] == "a" and r["n"] == 2  # NULL never wins, tie -> smallest


def test_bucketed_path_matches_numpy(spark, monkeypatch):
    import cohortlab.operators.quantiles as Q

    monkeypatch.setattr(Q, "SMALL_KEY", 10)  # force the multi-bucket path
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {r["prob"]: r["value"] for r in Q.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], buckets=16).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(x, p)) < 1e-12


def test_hot_and_near_unique_values_in_groups(spark, monkeypatch):
    import cohortlab.operators.quantiles as Q

    monkeypatch.setattr(Q, "SMALL_KEY", 25)
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.normal(size=n) * 1e6  # near-unique
    x[: n // 3] = 5.0  # a third of the rows share one value
    g = np.array(["a", "b", None], dtype=object)[np.minimum(rng.integers(0, 60, n), 2)]
    pdf = pd.DataFrame({"x": x, "g": g})
    df = spark.createDataFrame(pdf, "x double, g string").repartition(6)
    probs = [0.0, 0.001, 0.33, 0.34, 0.5, 0.999, 1.0]
    for buckets in (16, 1000):
        got = {(r["g"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, ["x"], probs, by=["g"], buckets=buckets).collect()}
        assert len(got) == 3 * len(probs)
        for (k, p), v in got.items():
            mine = pdf[pdf["g"].isna() if k is None else pdf["g"] == k]["x"]
            assert v == np.quantile(mine, p) or abs(v - np.quantile(mine, p)) < 1e-6
    assert Q.exact_quantiles(df.limit(0), ["x"], probs).count() == 0
