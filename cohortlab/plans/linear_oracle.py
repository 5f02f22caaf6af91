"""SQL (DuckDB dialect) of OLS, inference, VIF and ridge: the sweep operator as a recursive query.

The centred cross products of the features and the target are a table (i, j, v).  Sweeping every feature, one a step, turns
it into minus the inverse, the coefficients and the residual sum of squares.  P-values integrate the t density (Simpson's rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from cohortlab.plans import oracle as O
from cohortlab.plans.tree_oracle import _value
from cohortlab.roles import ALPHA_GRID, BAND_VIF, ENTITY, P_SIGNIFICANT, R2_GAP_LIMIT, SPLIT_SEED

R = ENTITY
Y = R.regression_target
FEATURES = R.regression_features()
STEPS = 4000


def swept(features: Sequence[str], values: dict[str, str] | None = None, folds: bool = False, alphas: Sequence[float] = (0.0,), prefix: str = "") -> str:
    """CTEs named with ``prefix``: reg, n, mean, gram (g, i, j, v) and fin (g, alpha, i, j, v), everything swept; the target is the last index.

    A group g is the training rows, with ``folds`` those outside each fold.
    """
    made = {**{c: _value(c) for c in (*R.numeric, *R.categorical)}, **(values or {})}
    p, x = len(features), ", ".join([*(made[c] for c in features), f"CAST({Y} AS DOUBLE)"])
    fold = f"CAST(('0x' || substr({O._md5('id', SPLIT_SEED + 1)}, 1, 8))::BIGINT % 5 AS INTEGER)"
    r = prefix
    groups = f"SELECT f AS g, id, x FROM {r}reg JOIN range(5) t(f) ON fold <> f WHERE NOT is_test" if folds else f"SELECT 0 AS g, id, x FROM {r}reg WHERE NOT is_test"
    grid = ", ".join(f"({a!r}::DOUBLE)" for a in alphas)
    return (
        f"{r}reg AS MATERIALIZED (SELECT id, {fold} AS fold, {O._md5('id', SPLIT_SEED)} < '4ccccccc' AS is_test, [{x}] AS x FROM enc), "
        f"{r}rows AS (SELECT g, id, unnest(range({p + 1})) AS i, unnest(x) AS v FROM ({groups})), "
        f"{r}mean AS MATERIALIZED (SELECT g, i, avg(v) AS m, count(*) AS n FROM {r}rows GROUP BY g, i), "
        f"{r}cen AS MATERIALIZED (SELECT r.g, r.id, r.i, v - m AS z FROM {r}rows r JOIN {r}mean USING (g, i)), "
        f"{r}gram AS MATERIALIZED (SELECT a.g, a.i, b.i AS j, sum(a.z * b.z) AS v FROM {r}cen a JOIN {r}cen b ON a.g = b.g AND a.id = b.id GROUP BY ALL), "
        f"{r}sw(k, g, alpha, i, j, v) AS (SELECT 0, g, alpha, i, j, v + CASE WHEN i = j AND i < {p} THEN alpha ELSE 0 END FROM {r}gram, (VALUES {grid}) t(alpha) "
        f"UNION ALL (WITH cur AS (SELECT * FROM {r}sw) SELECT c.k + 1, c.g, c.alpha, c.i, c.j, "
        "CASE WHEN c.i = c.k AND c.j = c.k THEN -1 / d.v WHEN c.i = c.k OR c.j = c.k THEN c.v / d.v ELSE c.v - row.v * col.v / d.v END "
        "FROM cur c JOIN cur d ON d.g = c.g AND d.alpha = c.alpha AND d.i = c.k AND d.j = c.k "
        "JOIN cur row ON row.g = c.g AND row.alpha = c.alpha AND row.i = c.i AND row.j = c.k "
        f"JOIN cur col ON col.g = c.g AND col.alpha = c.alpha AND col.i = c.k AND col.j = c.j WHERE c.k < {p})), "
        f"{r}fin AS MATERIALIZED (SELECT g, alpha, i, j, v FROM {r}sw WHERE k = {p}), "
        f"{r}coef AS MATERIALIZED (SELECT f.g, f.alpha, list(f.v ORDER BY f.i) AS w, "
        f"any_value(my.m) - sum(f.v * m.m) AS b FROM {r}fin f JOIN {r}mean m ON m.g = f.g AND m.i = f.i JOIN {r}mean my ON my.g = f.g AND my.i = {p} "
        f"WHERE f.j = {p} AND f.i < {p} GROUP BY f.g, f.alpha) "
    )


def _start(sql: str) -> str:
    return f"WITH RECURSIVE {O.ENC_CTE}, {sql}"


def _names(features: Sequence[str]) -> str:
    return f"(SELECT unnest({list(features)!r}) AS feature, unnest(range({len(features)})) AS i)"


def _inference(features: Sequence[str], prefix: str = "") -> str:
    """CTE ``inf`` (feature, coef, se, t, p, vif) for the features and the intercept."""
    p, r = len(features), prefix
    return (
        f", {r}s AS (SELECT any_value(n) AS n, any_value(n) - {p + 1} AS dof FROM {r}mean), "
        f"{r}sig AS (SELECT f.v / s.dof AS s2, s.n, s.dof FROM {r}fin f, {r}s s WHERE f.i = {p} AND f.j = {p}), "
        f"{r}one AS (SELECT nm.feature, c.v AS coef, sqrt(-d.v * s2) AS se, -d.v * q.v AS vif FROM {_names(features)} nm JOIN {r}fin c ON c.i = nm.i AND c.j = {p} "
        f"JOIN {r}fin d ON d.i = nm.i AND d.j = nm.i JOIN {r}gram q ON q.i = nm.i AND q.j = nm.i, {r}sig "
        f"UNION ALL SELECT 'const', (SELECT b FROM {r}coef), sqrt(s2 * (1 / n - (SELECT sum(f.v * a.m * b.m) FROM {r}fin f JOIN {r}mean a ON a.i = f.i JOIN {r}mean b ON b.i = f.j "
        f"WHERE f.i < {p} AND f.j < {p}))), NULL FROM {r}sig), "
        f"{r}tt AS (SELECT *, coef / se AS t, least(abs(coef / se), 12.0) AS top, dof FROM {r}one, {r}sig), "
        f"{r}area AS (SELECT feature, sum((CASE WHEN x IN (0, {STEPS}) THEN 1 WHEN x % 2 = 1 THEN 4 ELSE 2 END) "
        f"* pow(1 + (top * x / {STEPS}) * (top * x / {STEPS}) / dof, -(dof + 1) / 2.0)) * any_value(top) / {STEPS} / 3 "
        f"* exp(lgamma((any_value(dof) + 1) / 2.0) - lgamma(any_value(dof) / 2.0)) / sqrt(any_value(dof) * pi()) AS half FROM {r}tt, range({STEPS + 1}) g(x) GROUP BY feature), "
        f"{r}inf AS (SELECT feature, coef, se, t, greatest(1 - 2 * half, 0) AS p, vif FROM {r}tt JOIN {r}area USING (feature)) "
    )


SCORE = (
    "sc AS (SELECT r.is_test, r.x[len(r.x)] AS y, b + list_dot_product(r.x[:len(r.x) - 1], w) AS e FROM {r}reg r, {r}coef), "
    "my AS (SELECT is_test, avg(y) AS m FROM sc GROUP BY 1), "
    "met AS (SELECT is_test, count(*) AS n, 1 - sum((y - e) * (y - e)) / sum((y - m) * (y - m)) AS r2, sqrt(avg((y - e) * (y - e))) AS rmse FROM sc JOIN my USING (is_test) GROUP BY 1) "
)


def _ols() -> str:
    return _start(swept(FEATURES)) + (
        f"SELECT 'const' AS feature, round(b, 4) AS coef FROM coef UNION ALL SELECT nm.feature, round(f.v, 4) FROM {_names(FEATURES)} nm JOIN fin f ON f.i = nm.i AND f.j = {len(FEATURES)}")


def _metrics() -> str:
    p = len(FEATURES)
    return _start(swept(FEATURES)) + ", " + SCORE.format(r="") + (
        ", tr AS (SELECT * FROM met WHERE NOT is_test), te AS (SELECT * FROM met WHERE is_test) "
        f"SELECT CASE WHEN m.is_test THEN 'test' ELSE 'train' END AS split, m.n, round(m.r2, 6) AS r2, CASE WHEN NOT m.is_test THEN round(1 - (1 - m.r2) * (m.n - 1) / (m.n - {p + 1}), 6) END AS adj_r2, "
        f"round(m.rmse, 4) AS rmse, round(tr.r2 - te.r2, 6) AS r2_gap, tr.r2 - te.r2 > {R2_GAP_LIMIT} AS overfit FROM met m, tr, te")


def _ols_inference() -> str:
    return _start(swept(FEATURES)) + _inference(FEATURES) + (
        f"SELECT feature, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 6) AS t, round(p, 9) AS p, p < {P_SIGNIFICANT} AS significant FROM inf")


def _vif() -> str:
    return _start(swept(FEATURES)) + _inference(FEATURES) + (
        f"SELECT feature, round(vif, 6) AS vif, {O.band_sql('round(vif, 6)', BAND_VIF, inclusive=True)} AS risk FROM inf WHERE feature <> 'const'")


def _ridge_cv() -> str:
    return _start(swept(FEATURES, folds=True, alphas=ALPHA_GRID)) + (
        ", val AS (SELECT c.alpha, c.g, sqrt(avg(pow(x[len(x)] - b - list_dot_product(x[:len(x) - 1], w), 2))) AS rmse FROM coef c JOIN reg r ON r.fold = c.g WHERE NOT r.is_test GROUP BY ALL), "
        "cv AS (SELECT alpha, avg(rmse) AS m, stddev_pop(rmse) AS s FROM val GROUP BY alpha) "
        "SELECT alpha, CAST(0 AS DOUBLE) AS l1_ratio, round(m, 4) AS mean_rmse, round(s, 4) AS std_rmse, alpha = (SELECT min_by(alpha, m) FROM cv) AS best FROM cv")


def _remedy() -> str:
    after = [c for c in FEATURES if c not in ("tenure", "n_lines")] + ["promotion_rate"]
    ratio = {"promotion_rate": "CAST(n_lines / (CASE WHEN tenure < 0.5 THEN 0.5 ELSE tenure END) AS DOUBLE)"}
    r2 = "(SELECT 1 - f.v / q.v FROM {r}fin f JOIN {r}gram q USING (i, j) WHERE i = {p} AND j = {p})"
    before_r2, after_r2 = r2.format(r="", p=len(FEATURES)), r2.format(r="z", p=len(after))
    return _start(swept(FEATURES) + ", " + swept(after, ratio, prefix="z")) + _inference(FEATURES) + _inference(after, "z") + (
        "SELECT feature, CASE WHEN a.coef IS NULL THEN 'dropped' WHEN b.coef IS NULL THEN 'new' ELSE 'shared' END AS status, "
        "round(b.coef, 4) AS coef_before, round(a.coef, 4) AS coef_after, round(b.se, 4) AS se_before, round(a.se, 4) AS se_after, round(a.se - b.se, 4) AS se_delta, "
        f"round(b.p, 9) AS p_before, round(a.p, 9) AS p_after, round(a.vif, 6) AS vif_after, round({before_r2}, 6) AS r2_before, round({after_r2}, 6) AS r2_after, "
        f"round({after_r2} - {before_r2}, 6) AS r2_delta FROM inf b FULL JOIN zinf a USING (feature) WHERE feature <> 'const'")


def oracle_sql() -> dict[str, str]:
    return {"q_ols": _ols(), "q_reg_metrics": _metrics(), "q_ols_inference": _ols_inference(), "q_vif": _vif(), "q_ridge_cv": _ridge_cv(), "q_remedy": _remedy()}
