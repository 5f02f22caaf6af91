"""Model-based queries: regression suite, decision tree, segmentation, cohorts.

Full-feature fits have no exact SQL twin; they are checked by unit tests
against brute-force numpy.  Reduced cases with closed forms (two-feature OLS,
two-feature VIF, one-feature ridge CV, a one-feature stump, pairwise distances
and silhouettes with given labels) carry SQL oracles here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.columns import band, below_band, ratio_feature
from cohortlab.operators import cells, linear, moments, profile, rates, segments, tree
from cohortlab.operators.joins import compare_sets, in_set, left_lookup, mark_membership
from cohortlab.plans import oracle as O
from cohortlab.plans import linear_oracle, tree_oracle
from cohortlab.plans.pipeline import pipeline
from cohortlab.roles import (
    ALPHA_GRID,
    BALANCE_BANDS,
    BAND_CLUSTER_RATE,
    BAND_IMPORTANCE,
    BAND_SEGMENT_RATE,
    BAND_SHRINKAGE,
    BAND_VIF,
    CHAINING_SHARE,
    DEPTH_GAP_BANDS,
    ENGINEERED,
    ENTITY,
    ENTITY_CLUSTER_FEATURES,
    ENTITY_PROBE,
    ENTITY_PROFILE_MEANS,
    GAP_BANDS,
    L1_RATIO_GRID,
    LASSO_PATH_ALPHAS,
    NEIGHBOUR_RADIUS,
    NOT_SUITABLE,
    NUM_CLUSTERS,
    P_SIGNIFICANT,
    PRUNED_DEPTH,
    R2_GAP_LIMIT,
    SAMPLE_SIZE,
    SEGMENT_INTERVENTIONS,
    SEGMENT_NAMES,
    SILHOUETTE_CELLS,
    SILHOUETTE_GOOD,
    SPLIT_SEED,
    SUITABLE,
    TARGET_DERIVED,
    TOP_N,
)
from cohortlab.sources.fixtures import embedding_view

R = ENTITY
Y = R.regression_target


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _r(x, nd=6):
    return None if x is None or (isinstance(x, float) and not math.isfinite(x)) else round(float(x), nd)


# ============================================================ regression
def q_ols(spark, sf):
    fit = pipeline(spark, sf).ols
    rows = [("const", _r(fit.intercept, 4))] + [(f, _r(c, 4)) for f, c in zip(fit.features, fit.coef)]
    return _rows(spark, rows, "feature string, coef double")


def q_reg_metrics(spark, sf):
    p = pipeline(spark, sf)
    fit = p.ols
    tr, te = linear.metrics(p.train_gram, fit), linear.metrics(p.test_gram, fit)
    adj = linear.adjusted_r2(tr["r2"], tr["n"], len(fit.features))
    rows = [("train", int(tr["n"]), _r(tr["r2"]), _r(adj), _r(tr["rmse"], 4)),
            ("test", int(te["n"]), _r(te["r2"]), None, _r(te["rmse"], 4))]
    out = _rows(spark, rows, "split string, n bigint, r2 double, adj_r2 double, rmse double")
    gap = tr["r2"] - te["r2"]
    return out.withColumn("r2_gap", F.lit(_r(gap))).withColumn("overfit", F.lit(gap > R2_GAP_LIMIT))


def q_ols_inference(spark, sf):
    rows = linear.ols_inference(pipeline(spark, sf).train_gram)
    return _rows(spark, [(r["feature"], _r(r["coef"], 4), _r(r["se"], 4), _r(r["t"]), _r(r["p"], 9), r["p"] < P_SIGNIFICANT) for r in rows],
                 "feature string, coef double, se double, t double, p double, significant boolean")


def q_vif(spark, sf):
    rows = linear.vif(pipeline(spark, sf).train_gram)
    df = _rows(spark, [(r["feature"], _r(r["vif"])) for r in rows], "feature string, vif double")
    return df.withColumn("risk", band("vif", BAND_VIF, inclusive=True))


VIF_PAIR = ("n_lines", "parts")


def q_vif_2f(spark, sf):
    """Two-feature VIF = 1/(1 − r²) on the training rows (closed form, SQL oracle)."""
    p = pipeline(spark, sf)
    g = moments.gram(p.reg_data.where(~F.col("is_test")), list(VIF_PAIR), Y, shift={c: p.medians[c] for c in VIF_PAIR})[None]
    return _rows(spark, [(r["feature"], _r(r["vif"], 4)) for r in linear.vif(g)], "feature string, vif double")


def _remedy_gram(p):
    df = p.reg_data.where(~F.col("is_test")).withColumn("promotion_rate", ratio_feature("n_lines", "tenure", floor=0.5))
    feats = [c for c in p.reg_features if c not in ("tenure", "n_lines")] + ["promotion_rate"]
    shift = {c: p.medians.get(c, 0.0) for c in feats + [Y]}
    return moments.gram(df, feats, Y, shift=shift)[None]


def q_remedy(spark, sf):
    """OLS before / after replacing (tenure, n_lines) by their floored ratio; set operators tell shared, dropped and new features."""
    p = pipeline(spark, sf)
    g2 = _remedy_gram(p)

    def fitted(g, suffix):
        rows = [(r["feature"], float(r["coef"]), float(r["se"]), float(r["p"])) for r in linear.ols_inference(g) if r["feature"] != "const"]
        return _rows(spark, rows, f"feature string, coef_{suffix} double, se_{suffix} double, p_{suffix} double")

    before, after = fitted(p.train_gram, "before"), fitted(g2, "after")
    r2b = linear.metrics(p.train_gram, linear.ols(p.train_gram))["r2"]
    r2a = linear.metrics(g2, linear.ols(g2))["r2"]
    inflation = _rows(spark, [(r["feature"], _r(r["vif"])) for r in linear.vif(g2)], "feature string, vif_after double")
    status = compare_sets(before.select("feature"), after.select("feature"))
    out = status.join(before, "feature", "left").join(after, "feature", "left").join(inflation, "feature", "left")
    r4 = {c: F.round(c, 4) for c in ("coef_before", "coef_after", "se_before", "se_after")}
    return out.select(
        "feature", "status", *(v.alias(c) for c, v in r4.items()), F.round(F.col("se_after") - F.col("se_before"), 4).alias("se_delta"),
        F.round("p_before", 9).alias("p_before"), F.round("p_after", 9).alias("p_after"), "vif_after",
        F.lit(_r(r2b)).alias("r2_before"), F.lit(_r(r2a)).alias("r2_after"), F.lit(_r(r2a - r2b)).alias("r2_delta"))


def _cv_frame(spark, rows, best):
    df = _rows(spark, [(r["alpha"], r["l1_ratio"], r["fold"], r["rmse"]) for r in rows], "alpha double, l1_ratio double, fold int, rmse double")
    g = df.groupBy("alpha", "l1_ratio").agg(F.round(F.avg("rmse"), 4).alias("mean_rmse"), F.round(F.stddev_pop("rmse"), 4).alias("std_rmse"))
    return g.withColumn("best", (F.col("alpha") == best.alpha) & (F.col("l1_ratio") == best.l1_ratio))


def q_ridge_cv(spark, sf):
    rows, fit = pipeline(spark, sf).ridge_cv
    return _cv_frame(spark, rows, fit)


def q_lasso_cv(spark, sf):
    rows, fit = pipeline(spark, sf).lasso_cv
    return _cv_frame(spark, rows, fit)


def q_enet_cv(spark, sf):
    rows, fit = pipeline(spark, sf).enet_cv
    return _cv_frame(spark, rows, fit)


RIDGE_1F = "n_lines"


def q_ridge_cv_1f(spark, sf):
    """One-feature ridge over the α grid with 5-fold CV (closed form, SQL oracle)."""
    p = pipeline(spark, sf)
    grams = moments.gram(p.reg_data.where(~F.col("is_test")), [RIDGE_1F], Y, group="fold",
                         shift={RIDGE_1F: p.medians[RIDGE_1F], Y: p.medians[Y]})
    rows = linear.cv_grid(grams, [(a, 0.0) for a in ALPHA_GRID], "ridge")
    df = _rows(spark, [(r["alpha"], r["fold"], r["rmse"]) for r in rows], "alpha double, fold int, rmse double")
    return df.groupBy("alpha").agg(F.round(F.avg("rmse"), 4).alias("mean_rmse"))


OLS_PAIR = ("n_lines", "qty")


def q_ols_2f(spark, sf):
    """Two-feature OLS on the training rows (Cramer's rule in the SQL oracle)."""
    p = pipeline(spark, sf)
    g = moments.gram(p.reg_data.where(~F.col("is_test")), list(OLS_PAIR), Y,
                     shift={c: p.medians[c] for c in (*OLS_PAIR, Y)})[None]
    fit = linear.ols(g)
    rows = [("const", _r(fit.intercept, 4))] + [(f, _r(c, 4)) for f, c in zip(fit.features, fit.coef)]
    return _rows(spark, rows, "feature string, coef double")


def q_enet_cv_1f(spark, sf):
    """One-feature lasso / elastic net over the α × l1_ratio grid with 5-fold CV
    (closed form soft(Sxy/n, αρ)/(Sxx/n + α(1−ρ)) in the SQL oracle)."""
    p = pipeline(spark, sf)
    grams = moments.gram(p.reg_data.where(~F.col("is_test")), [RIDGE_1F], Y, group="fold",
                         shift={RIDGE_1F: p.medians[RIDGE_1F], Y: p.medians[Y]})
    grid = [(a, r) for a in ALPHA_GRID for r in (*L1_RATIO_GRID, 1.0)]
    rows = linear.cv_grid(grams, grid, "enet")
    df = _rows(spark, [(r["alpha"], r["l1_ratio"], r["fold"], r["rmse"]) for r in rows], "alpha double, l1_ratio double, fold int, rmse double")
    return df.groupBy("alpha", "l1_ratio").agg(F.round(F.avg("rmse"), 4).alias("mean_rmse"))


def q_lasso_path(spark, sf):
    g = pipeline(spark, sf).train_gram
    rows, warm = [], None
    for a in sorted(LASSO_PATH_ALPHAS, reverse=True):
        fit = linear.enet(g, a, 1.0, w0=warm)
        warm = fit.coef
        rows += [(_r(math.log10(a)), a, f, _r(c)) for f, c in zip(fit.features, fit.coef)]
    return _rows(spark, rows, "log10_alpha double, alpha double, feature string, coef double")


def _coef_frame(spark, fit, name):
    return _rows(spark, [(f, float(c)) for f, c in zip(fit.features, fit.coef)], f"feature string, {name} double")


MODEL_COLUMNS = (("OLS", "ols"), ("Ridge", "ridge"), ("Lasso", "lasso"), ("ElasticNet", "elasticnet"))


def q_coef_compare(spark, sf):
    """Coefficients of the four models side by side (full outer join on feature), largest OLS coefficient first,
    with each penalised model's shrinkage against OLS."""
    m = pipeline(spark, sf).models()
    df = None
    for name, col in MODEL_COLUMNS:
        f = _coef_frame(spark, m[name], col)
        df = f if df is None else df.join(f, "feature", "full_outer")
    shrunk = {c: F.round(F.abs(F.col("ols") - F.col(c)), 6) for c in ("ridge", "lasso", "elasticnet")}
    out = df.select(
        "feature", *[F.round(c, 6).alias(c) for _, c in MODEL_COLUMNS],
        shrunk["ridge"].alias("shrinkage"), shrunk["lasso"].alias("lasso_shrinkage"), shrunk["elasticnet"].alias("enet_shrinkage"),
        (F.col("lasso") == 0).alias("lasso_zeroed"), (F.col("elasticnet") == 0).alias("enet_zeroed"),
    ).orderBy(F.abs("ols").desc(), "feature")
    return out.withColumn("shrinkage_band", band("shrinkage", BAND_SHRINKAGE))


def q_coef_lists(spark, sf):
    """Eliminated (coefficient 0) and retained features of each model, as lists in name order."""
    m = pipeline(spark, sf).models()
    rows = [(name, f, float(c)) for name, _ in MODEL_COLUMNS for f, c in zip(m[name].features, m[name].coef)]
    gone = F.col("coef") == 0
    found = _rows(spark, rows, "model string, feature string, coef double").groupBy("model").agg(
        F.array_sort(F.collect_list(F.when(gone, F.col("feature")))).alias("eliminated"), F.array_sort(F.collect_list(F.when(~gone, F.col("feature")))).alias("retained"))
    return found.select("model", F.array_join("eliminated", ", ").alias("eliminated"), F.size("eliminated").alias("n_eliminated"),
                        F.array_join("retained", ", ").alias("retained"), F.size("retained").alias("n_retained"))


def q_coef_long(spark, sf):
    """The coefficient comparison melted to (feature, model, coef)."""
    wide = q_coef_compare(spark, sf)
    return wide.unpivot(["feature"], ["ols", "ridge", "lasso", "elasticnet"], "model", "coef")


def _model_rows(p, models):
    rows = []
    for name, fit in models.items():
        tr, te = linear.metrics(p.train_gram, fit), linear.metrics(p.test_gram, fit)
        rows.append((name, float(fit.alpha), float(fit.l1_ratio), _r(tr["r2"]), _r(te["r2"]), _r(tr["rmse"], 4), _r(te["rmse"], 4),
                     fit.nonzero, _r(tr["r2"] - te["r2"])))
    return rows


def q_model_compare(spark, sf):
    p = pipeline(spark, sf)
    rows = _model_rows(p, p.models())
    df = _rows(spark, rows, "model string, alpha double, l1_ratio double, train_r2 double, test_r2 double, "
                                                   "train_rmse double, test_rmse double, nonzero int, r2_gap double")
    best_r2 = max(rows, key=lambda r: r[4])[0]  # ties: the first model
    best_rmse = min(rows, key=lambda r: r[6])[0]
    return df.withColumn("best_r2", F.col("model") == best_r2).withColumn("best_rmse", F.col("model") == best_rmse)


def _engineer(df):
    for name, (num, den, off, floor) in ENGINEERED.items():
        df = df.withColumn(name, ratio_feature(num, den, offset=off, floor=floor))
    return df


def _fe_regression(spark, sf, exclude_target_derived: bool):
    p = pipeline(spark, sf)
    feats = p.reg_features + [c for c in ENGINEERED if not (exclude_target_derived and c in TARGET_DERIVED)]
    df = _engineer(p.reg_data).withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    shift = {c: p.medians.get(c, 0.0) for c in feats + [Y]}
    g = moments.gram(df, feats, Y, group="split", shift=shift)
    tr_e, te_e = g["train"], g["test"]
    alpha_r, alpha_l = p.ridge_cv[1].alpha, p.lasso_cv[1].alpha
    base = {"OLS": p.ols, "Ridge": linear.ridge(p.train_gram, alpha_r), "Lasso": linear.enet(p.train_gram, alpha_l, 1.0)}
    eng = {"OLS": linear.ols(tr_e), "Ridge": linear.ridge(tr_e, alpha_r), "Lasso": linear.enet(tr_e, alpha_l, 1.0)}
    rows = []
    for name in ("OLS", "Ridge", "Lasso"):
        b, e = linear.metrics(p.test_gram, base[name]), linear.metrics(te_e, eng[name])
        rows.append((name, _r(b["r2"]), _r(e["r2"]), _r(e["r2"] - b["r2"]), _r(b["rmse"], 4), _r(e["rmse"], 4),
                     _r(e["rmse"] - b["rmse"], 4), base[name].nonzero, eng[name].nonzero))
    return _rows(spark, rows, "model string, baseline_r2 double, engineered_r2 double, delta_r2 double, baseline_rmse double, "
                              "engineered_rmse double, delta_rmse double, baseline_nonzero int, engineered_nonzero int")


def q_fe_regression(spark, sf):
    """Baseline vs engineered features for OLS / ridge / lasso at the CV'd α.

    As in the analysis being reproduced, ``salary_per_tenure`` is derived from
    the target and stays among the features (a deliberate leak kept for parity).
    """
    return _fe_regression(spark, sf, exclude_target_derived=False)


def q_fe_regression_safe(spark, sf):
    """The same comparison without features made from the target."""
    return _fe_regression(spark, sf, exclude_target_derived=True)


# ============================================================ decision tree
STUMP_FEATURE = "n_lines"
EXACT_FEATURES = ["gross", "disc", "n_lines"]


def q_stump(spark, sf):
    """Depth-1 variance tree on one small-integer feature (exhaustive SQL oracle)."""
    p = pipeline(spark, sf)
    fit = tree.fit_tree(p.tree_data.where(~F.col("is_test")), [STUMP_FEATURE], R.target, max_depth=1)
    node = fit.nodes.groupBy().pivot("node", ["", "0", "1"]).agg(F.first(F.struct("threshold", "n", "p")))
    return node.where("`0` IS NOT NULL").select(
        F.lit(STUMP_FEATURE).alias("feature"), F.round(node[""]["threshold"], 6).alias("threshold"),
        node["0"]["n"].alias("left_n"), node["1"]["n"].alias("right_n"), F.round(node["0"]["p"], 6).alias("left_p"), F.round(node["1"]["p"], 6).alias("right_p"))


def q_tree_exact(spark, sf):
    """Nodes of the depth-3 tree on continuous and small-integer features, all levels split by Spark."""
    p = pipeline(spark, sf)
    fit = tree.fit_tree(p.tree_data.where(~F.col("is_test")), EXACT_FEATURES, R.target, max_depth=3, local_rows=0)
    return fit.nodes.select("node", tree.feature_name(fit, F.col("feature")).alias("feature"), F.round("threshold", 6).alias("threshold"), "n", F.round("p", 6).alias("p"))


def q_tree_struct(spark, sf):
    return tree.structure(pipeline(spark, sf).tree)


def q_tree_nodes(spark, sf):
    """Node table of the pruned tree (depth ≤ 4 of the deep greedy tree)."""
    fit = pipeline(spark, sf).pruned_tree
    nodes = fit.nodes.where(F.col("depth") <= PRUNED_DEPTH).withColumn("is_leaf", F.col("is_leaf") | (F.col("depth") == PRUNED_DEPTH))
    return nodes.select(
        tree.heap_number(F.col("node")).alias("node"), "depth", F.when(~F.col("is_leaf"), tree.feature_name(fit, F.col("feature"))).alias("feature"),
        F.when(~F.col("is_leaf"), F.round("threshold", 6)).alias("threshold"), "n", F.round("p", 6).alias("p"), "is_leaf",
        F.when(F.col("p") > 0.5, 1).otherwise(0).alias("predicted"))


def _curve_df(p):
    return p.curve.select("depth", F.round("train_accuracy", 6).alias("train_accuracy"), F.round("test_accuracy", 6).alias("test_accuracy"), "leaves")


def _optimal(curve):
    """The depth of the greatest test accuracy, the smallest of equals (a curve has one row a depth)."""
    return curve.agg(F.min_by("depth", F.struct(-F.col("test_accuracy"), F.col("depth"))).alias("d")).collect()[0]["d"]


def q_depth_curve(spark, sf):
    p = pipeline(spark, sf)
    df = _curve_df(p).withColumn("gap", F.round(F.col("train_accuracy") - F.col("test_accuracy"), 6))
    return df.withColumn("gap_band", band("gap", DEPTH_GAP_BANDS)).withColumn("optimal", F.col("depth") == _optimal(_curve_df(p))).withColumn(
        "pruned", F.col("depth") == PRUNED_DEPTH).withColumn("unpruned", F.col("depth") == p.tree.depth)


def q_prune_compare(spark, sf):
    """The pruned and the unpruned tree side by side."""
    p = pipeline(spark, sf)
    kinds = spark.createDataFrame([("pruned", min(PRUNED_DEPTH, p.tree.depth)), ("unpruned", p.tree.depth)], "tree string, depth int")
    gap = F.round(F.col("train_accuracy") - F.col("test_accuracy"), 6)
    return _curve_df(p).join(F.broadcast(kinds), "depth").select("tree", "depth", "leaves", "train_accuracy", "test_accuracy", gap.alias("gap"), band(gap, DEPTH_GAP_BANDS).alias("gap_band"))


def q_depth_zones(spark, sf):
    """Optimal depth, underfitting range (test accuracy below its 0.33 quantile)
    and the start of overfitting (gap > 0.05 beyond the optimum)."""
    curve = _curve_df(pipeline(spark, sf))
    o = _optimal(curve)
    q = curve.agg(F.percentile("test_accuracy", 0.33).alias("q33")).collect()[0]["q33"]
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    full = F.max_by(F.struct("depth", gap.alias("gap")), "depth")
    at = F.max(F.when(F.col("depth") == o, F.struct("test_accuracy", "train_accuracy")))
    return curve.agg(
        F.lit(o).alias("optimal_depth"), at["test_accuracy"].alias("optimal_test_accuracy"), at["train_accuracy"].alias("optimal_train_accuracy"),
        F.max(F.when(F.col("test_accuracy") < q, F.col("depth"))).alias("underfit_max_depth"),
        F.coalesce(F.min(F.when((F.col("depth") > o) & (gap > 0.05), F.col("depth"))), F.lit(o + 1)).alias("overfit_start"),
        full["depth"].alias("full_depth"), F.round(full["gap"], 6).alias("full_gap"))


def _rounded_paths(paths):
    return paths.select("id", "step", tree.heap_number(F.col("node")).alias("node"), "type", "feature", F.round("threshold", 6).alias("threshold"),
                        F.round("value", 6).alias("value"), "direction", F.col("prediction").cast("string").alias("prediction"))


def q_paths(spark, sf):
    p = pipeline(spark, sf)
    return _rounded_paths(tree.trace_paths(p.pruned_tree, p.tree_data, R.id, max_depth=PRUNED_DEPTH))


def q_probe_path(spark, sf):
    """The decision path of one hypothetical entity through the pruned tree."""
    p = pipeline(spark, sf)
    probe = spark.createDataFrame([(-1, *(float(ENTITY_PROBE[f]) for f in p.tree_features))], ", ".join(["id long", *(f"{f} double" for f in p.tree_features)]))
    return _rounded_paths(tree.trace_paths(p.pruned_tree, probe, "id", max_depth=PRUNED_DEPTH))


def q_importance(spark, sf):
    """Top-10 importances with rank (window over the small importance table),
    percentage, band and the bar length as a share of the largest."""
    from pyspark.sql import Window

    imp = tree.importances(pipeline(spark, sf).tree)
    ranked = imp.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    top = ranked.where(F.col("rank") <= TOP_N).withColumn("importance_pct", F.bround(F.col("importance") * 100, 2))
    mx = F.max("importance_pct").over(Window.partitionBy())
    return top.select("rank", "feature", "importance_pct", F.round(F.col("importance_pct") / mx, 6).alias("share_of_max"),
                      band("importance_pct", BAND_IMPORTANCE, inclusive=True).alias("band"))


def q_probability(spark, sf):
    p = pipeline(spark, sf)
    return p.tree_scored.select("id", F.round("p", 6).alias("p"), (F.col("p") >= 0.5).cast("int").alias("predicted"), "is_test")


def _tree_test_pred(p):
    return p.tree_scored.where("is_test").withColumn("predicted", (F.col("p") > 0.5).cast("int"))


def q_tree_confusion(spark, sf):
    return rates.confusion(_tree_test_pred(pipeline(spark, sf)), R.target, "predicted")


def q_tree_report(spark, sf):
    r = rates.classification_report(_tree_test_pred(pipeline(spark, sf)), R.target, "predicted", (0, 1), ("Stayed", "Left"))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_fe_tree(spark, sf):
    """Accuracy and F1 (class 1) of the unpruned tree with and without the
    engineered ratio features."""
    p = pipeline(spark, sf)
    data = _engineer(p.tree_data)
    out = []
    for name, feats in (("baseline", p.tree_features), ("engineered", p.tree_features + list(ENGINEERED))):
        fit = p.tree if name == "baseline" else tree.fit_tree(data.where(~F.col("is_test")), feats, R.target)
        pred = tree.with_leaf(fit, data.where(F.col("is_test")), [R.target]).withColumn("predicted", (F.col("p") > 0.5).cast("int"))
        rep = {r["label"]: r for r in rates.classification_report(pred, R.target, "predicted").collect()}
        out.append((name, rep["accuracy"]["precision"], rep["1"]["f1"]))
    (_, ab, fb), (_, ae, fe) = out
    return _rows(spark, [("accuracy", _r(ab), _r(ae), _r(ae - ab)), ("f1", _r(fb), _r(fe), _r(fe - fb))],
                 "metric string, baseline double, engineered double, delta double")


# ============================================================ segmentation
def q_pairwise(spark, sf):
    p = pipeline(spark, sf)
    return p.pairs.select("i", "j", F.round("euclidean", 6).alias("euclidean"), F.round("manhattan", 6).alias("manhattan"))


def q_neighbours(spark, sf):
    """All pairs of distinct clean rows within the radius in the space of z-scored features."""
    near = segments.neighbours(pipeline(spark, sf).standardized.select(F.col(R.id).alias("id"), "vec"), NEIGHBOUR_RADIUS)
    return near.select("i", "j", F.round("euclidean", 6).alias("euclidean"))


def q_silhouette(spark, sf):
    """Silhouette of the given labels over all embeddings, with its error bound (0 while each cell holds one point)."""
    x = embedding_view(spark, sf)
    found = cells.feature_cells(x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"), SILHOUETTE_CELLS, by=["label"])
    cluster = found.rows.groupBy("cell").agg(F.first("label").alias("cluster")).toPandas()
    sil = cells.silhouettes(found, cluster)
    return sil.select(F.round("silhouette", 6).alias("silhouette"), F.round("error_bound", 6).alias("error_bound"), "n")


def q_linkage(spark, sf):
    p = pipeline(spark, sf)
    return segments.linkage_frame(spark, p.linkage).withColumn("height", F.round("height", 6))


def q_cut(spark, sf):
    return pipeline(spark, sf).labels


def q_last_merges(spark, sf):
    from pyspark.sql import Window

    lk = q_linkage(spark, sf)
    w = Window.partitionBy("method", "metric").orderBy(F.col("height").desc(), F.col("step").desc())
    return lk.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 30)


def q_cluster_compare(spark, sf):
    p = pipeline(spark, sf)
    weight = p.cell_labels.merge(p.cells.table[["cell", "n"]], on="cell")
    sizes = segments.size_summary(spark.createDataFrame(weight), ["method", "metric"], CHAINING_SHARE)
    sil = cells.silhouettes(p.cells, p.cell_labels, ["method", "metric"])
    out = sizes.join(sil.select("method", "metric", *(F.round(c, 6).alias(c) for c in ("silhouette", "error_bound"))), ["method", "metric"])
    best = out.agg(F.max_by(F.struct("method", "metric"), "silhouette").alias("b")).collect()[0]["b"]
    return out.withColumn("recommended", (F.col("method") == best["method"]) & (F.col("metric") == best["metric"])).withColumn(
        "balance_band", below_band("max_over_min", BALANCE_BANDS, "unbalanced")).withColumn(
        "silhouette_band", F.when(F.col("silhouette") >= SILHOUETTE_GOOD, "good").otherwise("weak")).withColumn(
        "suitability", F.when(F.col("chaining"), NOT_SUITABLE).otherwise(SUITABLE))


def _profile(p, method="complete"):
    df = p.segmented(method)
    return df, segments.profile_groups(df, "cluster", R.target, list(ENTITY_PROFILE_MEANS))


def _profile_rows(prof):
    return prof.withColumn("band", band("target_pct", BAND_CLUSTER_RATE)).select(
        "cluster", "size", F.round("target_pct", 4).alias("target_pct"),
        *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in ENTITY_PROFILE_MEANS], "band")


def q_profile(spark, sf):
    return _profile_rows(_profile(pipeline(spark, sf))[1])


def q_profile_compare(spark, sf):
    """Cluster profiles of average and complete linkage side by side, with balance and chaining of each."""
    p = pipeline(spark, sf)
    out = None
    for method in ("average", "complete"):
        rows = _profile_rows(_profile(p, method)[1]).select(F.lit(method).alias("method"), "*")
        out = rows if out is None else out.unionByName(rows)
    sizes = segments.size_summary(out.withColumnRenamed("size", "n"), ["method"], CHAINING_SHARE)
    verdict = F.when(F.col("chaining"), NOT_SUITABLE).otherwise(SUITABLE)
    return out.join(F.broadcast(sizes.select("method", "min_over_max", "chaining", verdict.alias("suitability"))), "method")


def _segments(p):
    df, prof = _profile(p)
    names = segments.name_segments(prof, SEGMENT_NAMES)
    inter = p.spark.createDataFrame(list(SEGMENT_INTERVENTIONS.items()), "segment_key string, intervention string")
    return df, prof.join(names, "cluster").join(inter, "segment_key")


def q_segments(spark, sf):
    _, seg = _segments(pipeline(spark, sf))
    return seg.select("cluster", "segment", "intervention", "size", F.round("target_pct", 4).alias("target_pct"),
                      band("target_pct", BAND_SEGMENT_RATE).alias("band"),
                      *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in ENTITY_PROFILE_MEANS])


def q_cluster_box(spark, sf):
    df, _ = _profile(pipeline(spark, sf))
    return profile.box_stats(df, list(ENTITY_CLUSTER_FEATURES), by=["cluster"])


def q_cluster_attrition(spark, sf):
    p = pipeline(spark, sf)
    df, seg = _segments(p)
    named = df.join(seg.select("cluster", "segment"), "cluster")
    ct = rates.crosstab(named, "segment", R.target, [0, 1], ["Stayed", "Left"])
    return ct.withColumn("band", band("rate_pct", BAND_SEGMENT_RATE))


# ============================================================ cohorts
def risk_ids(p) -> DataFrame:
    df, seg = _segments(p)
    return df.join(seg.where(F.col("segment_key") == "risk").select("cluster"), "cluster", "left_semi").select(F.col(R.id).alias("id"))


def master(p) -> DataFrame:
    """One projection over the clean rows: P(leave), class, predicted salary, gap."""
    lasso = p.lasso_cv[1]
    scored = tree.with_leaf(p.tree, p.encoded, [
        F.col(R.id).cast("string").alias("id"), F.col(Y).alias("actual"), F.col(R.target).alias("target"), lasso.predict_column().alias("predicted")])
    return scored.select(
        "id", "actual", "target", F.col("p").alias("attrition_probability"), (F.col("p") >= 0.5).cast("int").alias("predicted_attrition"), "predicted",
    ).withColumn("gap", F.col("actual") - F.col("predicted"))


def _m6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_master(spark, sf):
    return _m6(master(pipeline(spark, sf)))


def q_high_risk(spark, sf):
    """Flagship: predicted to leave by the tree AND in the risk segment, top 10 by probability."""
    p = pipeline(spark, sf)
    m = in_set(master(p).where(F.col("predicted_attrition") == 1), risk_ids(p), "id")
    top = m.orderBy(F.col("attrition_probability").desc(), F.col("id")).limit(TOP_N)
    return _m6(top.withColumn("gap_band", below_band("gap", GAP_BANDS, "fair")))


def q_contradictions(spark, sf):
    """Predicted to stay but in the risk segment, with the actual outcome looked
    up by a left join on id (duplicate ids would fan out, as a plain merge does)."""
    p = pipeline(spark, sf)
    m = in_set(master(p).drop("target").where(F.col("predicted_attrition") == 0), risk_ids(p), "id")
    m = left_lookup(m, p.clean.select(F.col(R.id).alias("id"), F.col(R.target).alias("target")), "id")
    return _m6(m.withColumn("gap_band", below_band("gap", GAP_BANDS, "fair"))).orderBy(F.col("attrition_probability").desc(), "id")


def gap_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """n, underpaid n and %, mean actual / predicted / gap per group (empty-safe)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") < 0).alias("underpaid"),
        F.round(F.try_divide(F.count_if(F.col("gap") < 0) * 100.0, F.count(F.lit(1))), 4).alias("underpaid_pct"),
        F.round(F.avg("gap"), 4).alias("mean_gap"), F.round(F.avg("actual"), 4).alias("mean_actual"),
        F.round(F.avg("predicted"), 4).alias("mean_predicted"))


def q_high_risk_summary(spark, sf):
    return gap_summary(q_high_risk(spark, sf), [])


def q_contradiction_summary(spark, sf):
    c = q_contradictions(spark, sf)
    return c.agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("actually_left"),
        F.round(F.try_divide(F.sum("target") * 100.0, F.count(F.lit(1))), 4).alias("left_pct"),
        F.count_if(F.col("gap") < 0).alias("underpaid"), F.round(F.avg("attrition_probability"), 6).alias("mean_probability"))


RULE_RISK_DISC = 5.0
RULE_LEAVE_LINES = 5.0


def q_rule_cohorts(spark, sf):
    """The cohort operators on deterministic rule scores (SQL-checkable):
    leave if n_lines ≥ 5, benchmark = department mean of gross, risk segment =
    entities with disc > 5 (all rows of the clean table)."""
    p = pipeline(spark, sf)
    c = p.clean
    bench_ = c.groupBy("department").agg(F.avg(Y).alias("predicted"))
    scored = c.join(bench_, "department").select(
        F.col(R.id).cast("string").alias("id"), F.col(Y).alias("actual"),
        (F.col("n_lines") >= RULE_LEAVE_LINES).cast("int").alias("predicted_attrition"), "predicted",
    ).withColumn("gap", F.col("actual") - F.col("predicted"))
    risk = c.where(F.col("disc") > RULE_RISK_DISC).select(F.col(R.id).alias("id"))
    m = mark_membership(scored, risk, "id", "in_risk")
    cohorts = (
        m.select(F.lit("all").alias("cohort"), "gap", "actual", "predicted")
        .unionByName(m.where("in_risk").select(F.lit("risk").alias("cohort"), "gap", "actual", "predicted"))
        .unionByName(in_set(scored.where(F.col("predicted_attrition") == 1), risk, "id")
                     .select(F.lit("high_risk").alias("cohort"), "gap", "actual", "predicted"))
        .unionByName(in_set(scored.where(F.col("predicted_attrition") == 0), risk, "id")
                     .select(F.lit("contradiction").alias("cohort"), "gap", "actual", "predicted"))
    )
    return gap_summary(cohorts, ["cohort"])


def q_fairness(spark, sf):
    p = pipeline(spark, sf)
    m = mark_membership(master(p), risk_ids(p), "id", "in_risk")
    allrows = m.select(F.lit("all").alias("cohort"), "gap", "actual", "predicted")
    risk = m.where("in_risk").select(F.lit("risk").alias("cohort"), "gap", "actual", "predicted")
    return gap_summary(allrows.unionByName(risk), ["cohort"])


def q_performance(spark, sf):
    p = pipeline(spark, sf)
    acc = rates.classification_report(_tree_test_pred(p), R.target, "predicted").where(F.col("label") == "accuracy").collect()[0]["precision"]
    lm = linear.metrics(p.test_gram, p.lasso_cv[1])
    rows = [("Decision Tree", "attrition prediction", "test_accuracy", _r(acc)),
            ("Lasso Regression", "salary benchmark", "test_r2", _r(lm["r2"])),
            ("Lasso Regression", "salary benchmark", "test_rmse", _r(lm["rmse"], 4)),
            ("Hierarchical Clustering", "segmentation", "clusters", float(NUM_CLUSTERS))]
    return _rows(spark, rows, "model string, purpose string, metric string, value double")


def q_report_facts(spark, sf):
    """The numbers behind the executive summary: conditional aggregates of one scored table, and the model scores."""
    p = pipeline(spark, sf)
    df, seg = _segments(p)
    named = df.join(F.broadcast(seg.select("cluster", "segment_key")), "cluster").select(F.col(R.id).cast("string").alias("id"), "segment_key")
    m = master(p).join(named, "id")
    risk, stable, left = F.col("segment_key") == "risk", F.col("segment_key") == "stable", F.col("predicted_attrition") == 1
    lasso = linear.metrics(p.test_gram, p.lasso_cv[1])
    facts = m.agg(
        F.count(F.lit(1)).alias("entities"),
        F.round(F.avg("target") * 100, 4).alias("attrition_pct"),
        F.sum("predicted_attrition").alias("predicted_leave"),
        F.count_if(risk).alias("risk_segment_size"),
        F.round(F.avg(F.when(risk, F.col("target"))) * 100, 4).alias("risk_attrition_pct"),
        F.count_if(risk & left).alias("high_risk_intersection"),
        F.count_if(risk & ~left).alias("contradictions"),
        F.count_if(risk & (F.col("gap") < 0)).alias("risk_underpaid"),
        F.round(F.avg(F.when(risk, F.col("gap"))), 4).alias("risk_mean_gap"),
        F.round(F.avg(F.when(risk, F.col("actual"))), 4).alias("risk_mean_actual"),
        F.round(F.avg(F.when(stable, F.col("actual"))), 4).alias("stable_mean_actual"),
    )
    right = (F.col("predicted") == F.col(R.target)).cast("double")
    tested = _tree_test_pred(p).agg(F.round(F.avg(right), 6).alias("tree_accuracy"))
    return facts.join(F.broadcast(tested)).select("*", F.lit(_r(lasso["r2"])).alias("lasso_r2"), F.lit(_r(lasso["rmse"], 4)).alias("lasso_rmse"))


QUERIES = {
    "q_ols": q_ols, "q_reg_metrics": q_reg_metrics, "q_ols_inference": q_ols_inference, "q_vif": q_vif, "q_vif_2f": q_vif_2f,
    "q_remedy": q_remedy, "q_ridge_cv": q_ridge_cv, "q_lasso_cv": q_lasso_cv, "q_enet_cv": q_enet_cv,
    "q_ridge_cv_1f": q_ridge_cv_1f, "q_ols_2f": q_ols_2f, "q_enet_cv_1f": q_enet_cv_1f, "q_lasso_path": q_lasso_path, "q_coef_compare": q_coef_compare, "q_coef_long": q_coef_long,
    "q_model_compare": q_model_compare, "q_fe_regression": q_fe_regression, "q_fe_regression_safe": q_fe_regression_safe, "q_coef_lists": q_coef_lists,
    "q_stump": q_stump, "q_tree_struct": q_tree_struct, "q_tree_nodes": q_tree_nodes, "q_depth_curve": q_depth_curve,
    "q_depth_zones": q_depth_zones, "q_tree_exact": q_tree_exact, "q_prune_compare": q_prune_compare, "q_probe_path": q_probe_path, "q_paths": q_paths, "q_importance": q_importance, "q_probability": q_probability,
    "q_tree_confusion": q_tree_confusion, "q_tree_report": q_tree_report, "q_fe_tree": q_fe_tree,
    "q_pairwise": q_pairwise, "q_silhouette": q_silhouette, "q_neighbours": q_neighbours, "q_linkage": q_linkage, "q_cut": q_cut,
    "q_last_merges": q_last_merges, "q_cluster_compare": q_cluster_compare, "q_profile": q_profile, "q_profile_compare": q_profile_compare, "q_segments": q_segments,
    "q_cluster_box": q_cluster_box, "q_cluster_attrition": q_cluster_attrition,
    "q_master": q_master, "q_high_risk": q_high_risk, "q_high_risk_summary": q_high_risk_summary,
    "q_contradictions": q_contradictions, "q_contradiction_summary": q_contradiction_summary, "q_fairness": q_fairness,
    "q_rule_cohorts": q_rule_cohorts,
    "q_performance": q_performance, "q_report_facts": q_report_facts,
}


# ============================================================ SQL oracles
def _train_reg(extra: str = "") -> str:
    return f"reg AS (SELECT * FROM enc WHERE NOT ({O._md5('id', SPLIT_SEED)} < '4ccccccc'){extra})"


def _vif_2f_sql() -> str:
    a, b = VIF_PAIR
    return O.with_enc(
        f", {_train_reg()} SELECT feature, round(1 / (1 - r * r), 4) AS vif FROM "
        f"(SELECT corr({a}, {b}) AS r FROM reg), (VALUES ({O.q(a)}), ({O.q(b)})) v(feature)"
    ).replace("\n, reg", ",\nreg")


def _ridge_1f_sql() -> str:
    x = RIDGE_1F
    fold = f"CAST(('0x' || substr({O._md5('id', SPLIT_SEED + 1)}, 1, 8))::BIGINT % 5 AS INTEGER)"
    alphas = ", ".join(f"({a!r})" for a in ALPHA_GRID)
    return O.with_enc(
        f", reg AS (SELECT {x} AS x, {Y} AS y, {fold} AS fold FROM enc WHERE NOT ({O._md5('id', SPLIT_SEED)} < '4ccccccc')), "
        f"folds AS (SELECT DISTINCT fold FROM reg), "
        f"tr AS (SELECT f.fold, count(*) AS n, avg(r.x) AS mx, avg(r.y) AS my, "
        f"sum((r.x - m.mx) * (r.x - m.mx)) AS sxx, sum((r.x - m.mx) * (r.y - m.my)) AS sxy "
        f"FROM folds f JOIN reg r ON r.fold <> f.fold JOIN (SELECT f2.fold, avg(r2.x) AS mx, avg(r2.y) AS my FROM folds f2 "
        f"JOIN reg r2 ON r2.fold <> f2.fold GROUP BY f2.fold) m ON m.fold = f.fold GROUP BY f.fold), "
        f"coef AS (SELECT tr.fold, a.alpha, tr.sxy / (tr.sxx + a.alpha) AS w, tr.my - tr.sxy / (tr.sxx + a.alpha) * tr.mx AS b "
        f"FROM tr, (VALUES {alphas}) a(alpha)), "
        f"val AS (SELECT c.alpha, c.fold, sqrt(avg((r.y - c.b - c.w * r.x) * (r.y - c.b - c.w * r.x))) AS rmse "
        f"FROM coef c JOIN reg r ON r.fold = c.fold GROUP BY c.alpha, c.fold) "
        f"SELECT alpha, round(avg(rmse), 4) AS mean_rmse FROM val GROUP BY alpha"
    ).replace("\n, reg", ",\nreg")


def _ols_2f_sql() -> str:
    a, b = OLS_PAIR
    return O.with_enc(
        f", {_train_reg()}, m AS (SELECT avg({a}) AS ma, avg({b}) AS mb, avg({Y}) AS my FROM reg), "
        f"s AS (SELECT sum(({a} - ma) * ({a} - ma)) AS saa, sum(({b} - mb) * ({b} - mb)) AS sbb, "
        f"sum(({a} - ma) * ({b} - mb)) AS sab, sum(({a} - ma) * ({Y} - my)) AS say, sum(({b} - mb) * ({Y} - my)) AS sby, "
        f"any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my FROM reg, m), "
        f"w AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, "
        f"ma, mb, my FROM s) "
        f"SELECT 'const' AS feature, round(my - wa * ma - wb * mb, 4) AS coef FROM w "
        f"UNION ALL SELECT {O.q(a)}, round(wa, 4) FROM w UNION ALL SELECT {O.q(b)}, round(wb, 4) FROM w"
    )


def _enet_1f_sql() -> str:
    x = RIDGE_1F
    fold = f"CAST(('0x' || substr({O._md5('id', SPLIT_SEED + 1)}, 1, 8))::BIGINT % 5 AS INTEGER)"
    grid = ", ".join(f"({a!r}, {r!r})" for a in ALPHA_GRID for r in (*L1_RATIO_GRID, 1.0))
    return O.with_enc(
        f", reg AS (SELECT {x} AS x, {Y} AS y, {fold} AS fold FROM enc WHERE NOT ({O._md5('id', SPLIT_SEED)} < '4ccccccc')), "
        f"folds AS (SELECT DISTINCT fold FROM reg), "
        f"m AS (SELECT f.fold, avg(r.x) AS mx, avg(r.y) AS my, count(*) AS n FROM folds f JOIN reg r ON r.fold <> f.fold GROUP BY f.fold), "
        f"tr AS (SELECT m.fold, any_value(m.n) AS n, any_value(m.mx) AS mx, any_value(m.my) AS my, "
        f"sum((r.x - m.mx) * (r.x - m.mx)) AS sxx, sum((r.x - m.mx) * (r.y - m.my)) AS sxy "
        f"FROM m JOIN reg r ON r.fold <> m.fold GROUP BY m.fold), "
        f"coef AS (SELECT tr.fold, g.alpha, g.l1, "
        f"sign(tr.sxy) * greatest(abs(tr.sxy) / tr.n - g.alpha * g.l1, 0) / (tr.sxx / tr.n + g.alpha * (1 - g.l1)) AS w, tr.mx, tr.my "
        f"FROM tr, (VALUES {grid}) g(alpha, l1)), "
        f"val AS (SELECT c.alpha, c.l1, c.fold, sqrt(avg((r.y - (c.my - c.w * c.mx) - c.w * r.x) * (r.y - (c.my - c.w * c.mx) - c.w * r.x))) AS rmse "
        f"FROM coef c JOIN reg r ON r.fold = c.fold GROUP BY c.alpha, c.l1, c.fold) "
        f"SELECT alpha, l1 AS l1_ratio, round(avg(rmse), 4) AS mean_rmse FROM val GROUP BY alpha, l1"
    )


def _stump_sql() -> str:
    x = STUMP_FEATURE
    return O.with_enc(
        f", tr AS (SELECT {x} AS x, target AS y FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {O._md5('id', SPLIT_SEED)}) "
        f"<= floor(0.3 * count(*) OVER (PARTITION BY target) + 0.5) AS is_test FROM enc) WHERE NOT is_test), "
        f"v AS (SELECT x, count(*) AS c, sum(y) AS s FROM tr GROUP BY x), "
        f"cum AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(c) OVER (ORDER BY x) AS cl, sum(s) OVER (ORDER BY x) AS sl FROM v), "
        f"tot AS (SELECT sum(c) AS n, sum(s) AS s FROM v), "
        f"cand AS (SELECT (x + nx) / 2 AS thr, cl, sl, n - cl AS cr, tot.s - sl AS sr, n, tot.s AS st FROM cum, tot WHERE nx IS NOT NULL), "
        f"g AS (SELECT *, (st / n) * (1 - st / n) - (cl / n) * (sl / cl) * (1 - sl / cl) - (cr / n) * (sr / cr) * (1 - sr / cr) AS gain FROM cand) "
        f"SELECT {O.q(x)} AS feature, round(thr, 6) AS threshold, CAST(cl AS BIGINT) AS left_n, CAST(cr AS BIGINT) AS right_n, "
        f"round(sl / cl, 6) AS left_p, round(sr / cr, 6) AS right_p FROM g ORDER BY gain DESC, thr LIMIT 1"
    ).replace("\n, tr", ",\ntr")


def _zpoints_sql() -> str:
    feats = list(ENTITY_CLUSTER_FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in feats)
    vec = ", ".join(f"({c} - m_{c}) / s_{c}" for c in feats)
    return (f"zs AS (SELECT {stats} FROM clean), "
            f"{O.stratified_sample_sql('clean', 'id', 'target', SAMPLE_SIZE, SPLIT_SEED)}, "
            f"pts AS (SELECT id, [{vec}] AS vec FROM smp, zs)")


def _pairwise_sql() -> str:
    return (f"WITH {O.CLEAN_CTE}, {_zpoints_sql()} "
            "SELECT a.id AS i, b.id AS j, "
            "round(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 6) AS euclidean, "
            "round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: abs(t[1] - t[2]))), 6) AS manhattan "
            "FROM pts a JOIN pts b ON a.id < b.id")


def _silhouette_sql() -> str:
    return (
        "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings), "
        "d AS (SELECT a.vec_id AS p, a.label AS cp, b.label AS cq, "
        "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS dist "
        "FROM x a JOIN x b ON a.vec_id <> b.vec_id), "
        "per AS (SELECT p, cp, cq, avg(dist) AS md FROM d GROUP BY p, cp, cq), "
        "ab AS (SELECT p, max(CASE WHEN cp = cq THEN md END) AS a, min(CASE WHEN cp <> cq THEN md END) AS b FROM per GROUP BY p) "
        "SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, "
        "CAST(0 AS DOUBLE) AS error_bound, count(*) AS n FROM ab"
    )


def _neighbours_sql() -> str:
    feats = list(ENTITY_CLUSTER_FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in feats)
    z = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in feats)
    names = ", ".join(f"z_{c}" for c in feats)
    square = " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in feats)
    return (f"WITH {O.CLEAN_CTE}, zs AS (SELECT {stats} FROM clean), z AS (SELECT id, {z} FROM clean, zs), "
            f"pts AS (SELECT min(id) AS id, {names} FROM z GROUP BY {names}) "
            f"SELECT a.id AS i, b.id AS j, round(sqrt({square}), 6) AS euclidean FROM pts a JOIN pts b ON a.id < b.id "
            f"AND abs(a.z_{feats[0]} - b.z_{feats[0]}) <= {NEIGHBOUR_RADIUS!r} AND sqrt({square}) <= {NEIGHBOUR_RADIUS!r}")


def _rule_cohorts_sql() -> str:
    return (
        f"WITH {O.CLEAN_CTE}, "
        f"b AS (SELECT department, avg({Y}) AS predicted FROM clean GROUP BY department), "
        f"sc AS (SELECT CAST(c.id AS VARCHAR) AS id, c.{Y} AS actual, CAST(c.n_lines >= {RULE_LEAVE_LINES!r} AS INTEGER) AS pa, "
        f"b.predicted, c.{Y} - b.predicted AS gap FROM clean c JOIN b USING (department)), "
        f"risk AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM clean WHERE disc > {RULE_RISK_DISC!r}), "
        "co AS (SELECT 'all' AS cohort, gap, actual, predicted FROM sc "
        "UNION ALL SELECT 'risk', gap, actual, predicted FROM sc WHERE id IN (SELECT id FROM risk) "
        "UNION ALL SELECT 'high_risk', gap, actual, predicted FROM sc WHERE pa = 1 AND id IN (SELECT id FROM risk) "
        "UNION ALL SELECT 'contradiction', gap, actual, predicted FROM sc WHERE pa = 0 AND id IN (SELECT id FROM risk)) "
        "SELECT cohort, count(*) AS n, count(*) FILTER (WHERE gap < 0) AS underpaid, "
        "round(count(*) FILTER (WHERE gap < 0) * 100.0 / count(*), 4) AS underpaid_pct, round(avg(gap), 4) AS mean_gap, "
        "round(avg(actual), 4) AS mean_actual, round(avg(predicted), 4) AS mean_predicted FROM co GROUP BY cohort"
    )


def oracle_sql() -> dict[str, str]:
    return {
        **tree_oracle.oracle_sql(EXACT_FEATURES),
        **linear_oracle.oracle_sql(),
        "q_rule_cohorts": _rule_cohorts_sql(),
        "q_vif_2f": _vif_2f_sql(),
        "q_ols_2f": _ols_2f_sql(),
        "q_enet_cv_1f": _enet_1f_sql(),
        "q_ridge_cv_1f": _ridge_1f_sql(),
        "q_stump": _stump_sql(),
        "q_pairwise": _pairwise_sql(),
        "q_silhouette": _silhouette_sql(),
        "q_neighbours": _neighbours_sql(),
    }
