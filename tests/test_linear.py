import math

import numpy as np
import pandas as pd

from cohortlab.operators import linear, moments


def _data(spark, n=400, p=4, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) * [1, 10, 100, 0.1] + [5, -3, 1000, 0]
    X[:, 3] = X[:, 0] * 0.5 + rng.normal(scale=0.05, size=n)  # collinear pair
    y = X @ [2.0, -0.3, 0.01, 4.0] + 7 + rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(p)]).assign(y=y, fold=np.arange(n) % 5)
    return spark.createDataFrame(pdf), X, y


def test_ols_and_inference_match_numpy(spark):
    df, X, y = _data(spark)
    g = moments.gram(df, [f"x{i}" for i in range(4)], "y", shift={"x2": 1000.0, "y": 10.0})[None]
    fit = linear.ols(g)
    A = np.column_stack([np.ones(len(y)), X])
    beta, *_ = np.linalg.lstsq(A, y, rcond=None)
    assert np.allclose(fit.coef, beta[1:], rtol=1e-8) and math.isclose(fit.intercept, beta[0], rel_tol=1e-8)
    res = y - A @ beta
    sigma2 = res @ res / (len(y) - 5)
    se = np.sqrt(np.diag(np.linalg.inv(A.T @ A)) * sigma2)
    inf = {r["feature"]: r for r in linear.ols_inference(g)}
    assert math.isclose(inf["const"]["se"], se[0], rel_tol=1e-6)
    assert all(math.isclose(inf[f"x{i}"]["se"], se[i + 1], rel_tol=1e-6) for i in range(4))


def test_t_distribution_p_values():
    assert math.isclose(linear.t_two_sided_p(1.0, 1), 0.5, rel_tol=1e-12)
    t = 1.7
    assert math.isclose(linear.t_two_sided_p(t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-10)


def test_ridge_closed_form_and_cv_fold_sums(spark):
    df, X, y = _data(spark)
    cols = [f"x{i}" for i in range(4)]
    folds = moments.gram(df, cols, "y", group="fold")
    tot = moments.total(folds)
    whole = moments.gram(df, cols, "y")[None]
    assert np.allclose(tot.sxx, whole.sxx) and tot.n == whole.n  # fold Grams sum to the total
    Xc = X - X.mean(0); yc = y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 10.0 * np.eye(4), Xc.T @ yc)
    assert np.allclose(linear.ridge(tot, 10.0).coef, w, rtol=1e-8)
    rows = linear.cv_grid(folds, [(1.0, 0.0), (10.0, 0.0)], "ridge")
    assert len(rows) == 10 and all(r["rmse"] > 0 for r in rows)


def test_enet_satisfies_kkt(spark):
    df, X, y = _data(spark)
    g = moments.gram(df, [f"x{i}" for i in range(4)], "y")[None]
    for alpha, rho in [(0.5, 1.0), (0.1, 0.5), (5.0, 0.9)]:
        fit = linear.enet(g, alpha, rho)
        Xc = X - X.mean(0); yc = y - y.mean(); n = len(y)
        grad = Xc.T @ (yc - Xc @ fit.coef) / n - alpha * (1 - rho) * fit.coef
        for j, wj in enumerate(fit.coef):
            if wj != 0:
                assert abs(grad[j] - alpha * rho * np.sign(wj)) < 1e-8 * max(1, abs(grad[j]))
            else:
                assert abs(grad[j]) <= alpha * rho * (1 + 1e-8)


def test_vif_two_features_closed_form(spark):
    df, X, _ = _data(spark)
    g = moments.gram(df, ["x0", "x3"], "y")[None]
    r = np.corrcoef(X[:, 0], X[:, 3])[0, 1]
    for row in linear.vif(g):
        assert math.isclose(row["vif"], 1 / (1 - r * r), rel_tol=1e-8)


def test_sse_from_moments_equals_direct(spark):
    df, X, y = _data(spark)
    g = moments.gram(df, [f"x{i}" for i in range(4)], "y", shift={"x2": 1000.0})[None]
    fit = linear.ridge(g, 3.0)
    pred = X @ fit.coef + fit.intercept
    assert math.isclose(linear.sse(g, fit), float(((y - pred) ** 2).sum()), rel_tol=1e-8)
    got = df.select(fit.predict_column().alias("p")).toPandas()["p"].to_numpy()
    assert np.allclose(got, pred)


def test_rank_deficient_features_get_the_minimum_norm_solution(spark):
    rng = np.random.default_rng(12)
    x, z, k = rng.normal(size=400) * 3 + 5, rng.normal(size=400) * 100, np.full(400, 4.0)
    y = 2 * x - z + 7 + rng.normal(scale=0.1, size=400)
    X = np.column_stack([x, z, 0.1 * x + 0.7 * z, k])
    df = spark.createDataFrame(pd.DataFrame(X, columns=["x", "z", "w", "k"]).assign(y=y))
    g = moments.gram(df, ["x", "z", "w", "k"], "y")[None]
    fit = linear.ols(g)
    want = np.linalg.lstsq(X - X.mean(0), y - y.mean(), rcond=None)[0]
    assert np.allclose(fit.coef, want, atol=1e-6) and fit.coef[3] == 0
    assert abs(fit.intercept - (y.mean() - X.mean(0) @ want)) < 1e-4
    rows = {r["feature"]: r for r in linear.ols_inference(g)}
    C = X[:, :3] - X[:, :3].mean(0)
    rss = float(((y - y.mean() - C @ want[:3]) ** 2).sum())
    se = np.sqrt(np.diag(np.linalg.pinv(C.T @ C)) * rss / (400 - 2 - 1))  # rank 2
    assert np.allclose([rows[c]["se"] for c in "xzw"], se, rtol=1e-4)
