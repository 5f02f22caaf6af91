"""Linear models solved from Gram statistics.

One Spark pass (:func:`cohortlab.operators.moments.gram` grouped by fold /
split) feeds every fit below; the solves are p×p (p ≈ 10–20) on the driver.
Cross-validation uses ``train_k = total − fold_k``, so the whole
α × l1_ratio × fold grid needs no further scan of the data.

Objectives (intercept never penalised):

* OLS: min ‖y − b − Xw‖²
* ridge: min ‖y − b − Xw‖² + α‖w‖²
* elastic net / lasso: min 1/(2n)‖y − b − Xw‖² + αρ‖w‖₁ + α(1−ρ)/2‖w‖²
  (coordinate descent on the covariance form, Friedman, Hastie & Tibshirani 2010)
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.operators.moments import Gram


@dataclass
class LinearFit:
    features: list[str]
    coef: np.ndarray
    intercept: float  # in original (unshifted) coordinates
    alpha: float = 0.0
    l1_ratio: float = 0.0
    model: str = "ols"

    def predict_column(self) -> Column:
        """Σ cᵢ·xᵢ + b as a Catalyst expression (no UDF)."""
        expr = F.lit(float(self.intercept))
        for f, c in zip(self.features, self.coef):
            if c != 0.0:
                expr = expr + F.col(f).cast("double") * F.lit(float(c))
        return expr

    @property
    def nonzero(self) -> int:
        return int(np.count_nonzero(self.coef))


def _shift_intercept(g: Gram, w: np.ndarray) -> tuple[float, float]:
    """Intercept in shifted and in original coordinates."""
    mx, my = g.sx / g.n, g.sy / g.n
    b_shift = my - float(mx @ w)
    return b_shift, b_shift + g.shift_y - float(g.shift_x @ w)


RANK_TOLERANCE = 1e-11  # on the correlation scale; exact linear combinations leave about 1e-15


def _pseudo_inverse(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Moore-Penrose inverse and rank of a positive semidefinite matrix.

    The rank is read from the eigenvalues on the correlation scale, where units don't matter; the null space found
    there is projected out on the original scale, which makes solutions those of minimum norm.
    """
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    used = np.flatnonzero(scale > 0)
    inverse = np.zeros_like(a)
    if not used.size:
        return inverse, 0
    d = 1.0 / scale[used]
    values, vectors = np.linalg.eigh(a[np.ix_(used, used)] * np.outer(d, d))
    kept = values > RANK_TOLERANCE * len(used)
    g = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T * np.outer(d, d)
    null = vectors[:, ~kept] * d[:, None]
    if null.shape[1]:
        null, _ = np.linalg.qr(null)
        onto = np.eye(len(used)) - null @ null.T
        g = onto @ g @ onto
    inverse[np.ix_(used, used)] = g
    return inverse, int(kept.sum())


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution, of minimum norm if there are several."""
    inverse, rank = _pseudo_inverse(a)
    return np.linalg.solve(a, b) if rank == len(b) else inverse @ b


def ols(g: Gram) -> LinearFit:
    _, _, cxx, cxy, _ = g.centered()
    w = _solve(cxx, cxy)
    return LinearFit(list(g.features), w, _shift_intercept(g, w)[1], model="ols")


def ridge(g: Gram, alpha: float) -> LinearFit:
    _, _, cxx, cxy, _ = g.centered()
    w = _solve(cxx + alpha * np.eye(len(cxy)), cxy)
    return LinearFit(list(g.features), w, _shift_intercept(g, w)[1], alpha=alpha, model="ridge")


def _polish(a: np.ndarray, c: np.ndarray, l1: float, w: np.ndarray) -> np.ndarray | None:
    """Exact optimum on the active set of ``w`` if it satisfies the KKT conditions."""
    act = np.flatnonzero(w)
    if act.size == 0:
        return w.copy() if np.all(np.abs(c) <= l1 * (1 + 1e-10)) else None
    s = np.sign(w[act])
    try:
        wa = np.linalg.solve(a[np.ix_(act, act)], c[act] - l1 * s)
    except np.linalg.LinAlgError:
        return None
    if np.any(np.sign(wa) != s):
        return None
    full = np.zeros_like(w)
    full[act] = wa
    grad = c - a @ full
    inactive = np.setdiff1d(np.arange(len(w)), act)
    if inactive.size and np.any(np.abs(grad[inactive]) > l1 * (1 + 1e-9) + 1e-12 * np.abs(c).max()):
        return None
    return full


def enet(g: Gram, alpha: float, l1_ratio: float, w0: np.ndarray | None = None,
         max_iter: int = 10_000) -> LinearFit:
    """Coordinate descent on the covariance form, finished by an exact solve on
    the active set once it satisfies the optimality (KKT) conditions."""
    _, _, cxx, cxy, _ = g.centered()
    n, p = g.n, len(cxy)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    a = cxx / n + l2 * np.eye(p)
    c = cxy / n
    w = np.zeros(p) if w0 is None else w0.copy()
    grad = c - a @ w
    aa = a.tolist()
    diag = [aa[j][j] for j in range(p)]
    wl = w.tolist()
    gl = grad.tolist()
    for it in range(max_iter):
        for j in range(p):
            if diag[j] <= 0:
                continue
            rho = gl[j] + diag[j] * wl[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / diag[j]
            delta = new - wl[j]
            if delta != 0.0:
                wl[j] = new
                col = aa[j]
                for k in range(p):
                    gl[k] -= col[k] * delta
        if it % 5 == 4:
            exact = _polish(a, c, l1, np.array(wl))
            if exact is not None:
                w = exact
                break
    else:
        w = np.array(wl)
    model = "lasso" if l1_ratio == 1.0 else "elasticnet"
    return LinearFit(list(g.features), w, _shift_intercept(g, w)[1], alpha=alpha, l1_ratio=l1_ratio, model=model)


def sse(g: Gram, fit: LinearFit) -> float:
    """Σ(y − ŷ)² over the rows summarised by ``g`` (any subset, e.g. a fold)."""
    w = fit.coef
    b = fit.intercept - g.shift_y + float(g.shift_x @ w)  # intercept in shifted coordinates
    val = (g.syy - 2 * b * g.sy - 2 * float(w @ g.sxy) + g.n * b * b + 2 * b * float(w @ g.sx) + float(w @ g.sxx @ w))
    return max(val, 0.0)


def metrics(g: Gram, fit: LinearFit) -> dict[str, float]:
    """R² (against the subset's own mean), RMSE and n from statistics alone."""
    _, _, _, _, cyy = g.centered()
    e = sse(g, fit)
    return {"n": g.n, "r2": 1.0 - e / cyy if cyy > 0 else float("nan"), "rmse": math.sqrt(e / g.n)}


def adjusted_r2(r2: float, n: float, p: int) -> float:
    return 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1)


def cv_grid(folds: Mapping[object, Gram], grid: Sequence[tuple[float, float]], kind: str) -> list[dict]:
    """Validation RMSE for every (α, l1_ratio) × fold; ``kind`` ridge|enet."""
    keys = sorted(folds)
    tot = folds[keys[0]]
    for k in keys[1:]:
        tot = tot + folds[k]
    rows = []
    for k in keys:
        train = tot - folds[k]
        warm = None
        # large penalties first: each solution warm-starts the next
        for alpha, l1 in sorted(grid, key=lambda t: (t[1], -t[0])):
            fit = ridge(train, alpha) if kind == "ridge" else enet(train, alpha, l1, w0=warm)
            warm = fit.coef if kind != "ridge" else None
            rows.append({"alpha": alpha, "l1_ratio": l1, "fold": int(k), "rmse": math.sqrt(sse(folds[k], fit) / folds[k].n)})
    return rows


def best_params(rows: list[dict], grid: Sequence[tuple[float, float]]) -> tuple[float, float]:
    """Smallest mean validation RMSE; ties -> first grid entry."""
    best, best_score = grid[0], float("inf")
    for alpha, l1 in grid:
        vals = [r["rmse"] for r in rows if r["alpha"] == alpha and r["l1_ratio"] == l1]
        score = sum(vals) / len(vals)
        if score < best_score - 1e-12 * max(1.0, abs(best_score) if best_score != float("inf") else 1.0):
            best, best_score = (alpha, l1), score
    return best


# ---------------------------------------------------------------- inference
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if not math.isfinite(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def ols_inference(g: Gram) -> list[dict]:
    """Coefficient, SE, t and two-sided p for each feature and the intercept (degrees of freedom by rank)."""
    fit = ols(g)
    mx, _, cxx, cxy, cyy = g.centered()
    p = len(cxy)
    inv, rank = _pseudo_inverse(cxx)
    if rank == p:
        inv = np.linalg.inv(cxx)
    dof = g.n - rank - 1
    rss = max(cyy - float(fit.coef @ cxy), 0.0)
    sigma2 = rss / dof if dof > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    m_orig = mx + g.shift_x
    se_b = math.sqrt(max(sigma2 * (1.0 / g.n + float(m_orig @ inv @ m_orig)), 0.0))
    rows = [{"feature": "const", "coef": fit.intercept, "se": se_b}]
    rows += [{"feature": f, "coef": float(c), "se": float(s)} for f, c, s in zip(g.features, fit.coef, se)]
    for r in rows:
        r["t"] = r["coef"] / r["se"] if r["se"] > 0 else float("inf")
        r["p"] = t_two_sided_p(r["t"], dof)
        r["significant"] = bool(r["p"] < 0.05)
    return rows


def vif(g: Gram) -> list[dict]:
    """VIF_j = 1/(1 − R²_j) = Cxx_jj / RSS_j (regression on the others + const)."""
    _, _, cxx, _, _ = g.centered()
    p = cxx.shape[0]
    out = []
    for j in range(p):
        others = [k for k in range(p) if k != j]
        if not others:
            out.append({"feature": g.features[j], "vif": 1.0})
            continue
        a = cxx[np.ix_(others, others)]
        b = cxx[others, j]
        w = _solve(a, b)
        rss = cxx[j, j] - float(b @ w)
        v = cxx[j, j] / rss if rss > 1e-12 * max(cxx[j, j], 1e-300) else float("inf")
        out.append({"feature": g.features[j], "vif": float(v)})
    return out
