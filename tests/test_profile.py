import math

from cohortlab.operators.profile import box_stats, corr_matrix, histogram, skewness


def test_bias_corrected_skewness(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, None), (10.0, None)], "v double, w double")
    got = {r["column"]: r["skew"] for r in skewness(df, ["v", "w"]).collect()}
    assert math.isclose(got["v"], 1.763632614803888, rel_tol=1e-12)
    assert got["w"] is None  # n < 3


def test_corr_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, None), (None, 3.0), (5.0, 10.2)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = {(x["a"], x["b"]): x["r"] for x in corr_matrix(df, ["a", "b"]).collect()}
    import numpy as np

    pa = np.array([1, 2, 3, 5.0]); pb = np.array([2, 4.1, 5.9, 10.2])
    assert math.isclose(r[("a", "b")], np.corrcoef(pa, pb)[0, 1], rel_tol=1e-12)
    assert r[("a", "b")] == r[("b", "a")] and r[("a", "a")] == 1.0


def test_box_and_histogram(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = box_stats(df, ["x"]).collect()[0]
    assert b["q1"] == 2.0 and b["q3"] == 4.0 and b["outliers"] == 1 and b["whisker_hi"] == 4.0
    h = histogram(df, "x", 4).collect()
    assert sum(r["n"] for r in h) == 5 and max(r["bin"] for r in h) == 3


def test_approximate_describe_is_close(spark):
    import numpy as np

    from cohortlab.operators.profile import describe_numeric

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=3000)], "x double")
    ex = describe_numeric(df, ["x"]).collect()[0]
    ap = describe_numeric(df, ["x"], exact=False).collect()[0]
    assert ex["count"] == ap["count"] == 3000
    for c in ("p25", "p50", "p75"):
        assert abs(ex[c] - ap[c]) < 0.01


def test_binned_kde_close_to_exact(spark):
    import numpy as np

    from cohortlab.operators.profile import kde

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2.0, 1.0, 4000)], "v double")
    ex = {r["point"]: r["density"] for r in kde(df, "v", 50).collect()}
    ap = {r["point"]: r["density"] for r in kde(df, "v", 50, bins=2000).collect()}
    assert max(abs(ex[k] - ap[k]) for k in ex) < 1e-3 * max(ex.values())
