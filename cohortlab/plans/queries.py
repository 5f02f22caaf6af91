"""The query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Quality / profile / rates / splits (all checked against SQL in
:mod:`cohortlab.plans.oracle`).  Model-based queries live in
:mod:`cohortlab.plans.model_queries`.  Float outputs are rounded the same way
on both sides (6 decimals unless noted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.columns import band
from cohortlab.operators import encode, moments, profile, quality, rates, sampling
from cohortlab.operators.joins import compare_sets
from cohortlab.plans.pipeline import pipeline
from cohortlab.roles import (
    BAND_CORR_PAIR,
    BAND_CORR_TARGET,
    BAND_MISSING_PCT,
    BAND_RATE,
    ENTITY,
    ENTITY_CORR_COLUMNS,
    SPLIT_SEED,
    TEST_FRACTION,
)
from cohortlab.session import scratch_path
from cohortlab.sources.fixtures import document_view, event_values
from cohortlab.sources.tables import read_entities, read_table, shape_report

R = ENTITY
NUM = list(R.numeric)
CAT = list(R.categorical)
BOX_COLS = ("balance", "gross", "supps", "tenure")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q_shape(spark: SparkSession, sf: str) -> DataFrame:
    p = pipeline(spark, sf)
    return shape_report(p.raw, p.clean)


def q_suspicious(spark, sf):
    return quality.suspicious_counts(pipeline(spark, sf).raw, R.rules)


def q_suspicious_rows(spark, sf):
    return quality.flag_suspicious(pipeline(spark, sf).raw, R.rules, R.id)


def q_dropped(spark, sf):
    return quality.dropped_rows(pipeline(spark, sf).raw, R.rules, R.id)


def q_missing(spark, sf):
    return quality.missing_report(pipeline(spark, sf).raw).withColumn("band", band("missing_pct", BAND_MISSING_PCT))


def q_value_counts(spark, sf):
    return quality.value_counts(pipeline(spark, sf).raw, CAT)


def q_mapping(spark, sf):
    return quality.mapping_report(pipeline(spark, sf).raw, R.canonical_column, R.canonical_map)


def q_clean(spark, sf):
    c = pipeline(spark, sf).clean
    return c.select("id", "hired", "target", *[r6(x).alias(x) for x in NUM], *CAT)


def q_imputation(spark, sf):
    p = pipeline(spark, sf)
    rep = quality.imputation_report(p.raw, p.clean, R, p.medians, p.modes)
    is_num = F.col("strategy") == "Median"
    return rep.select(
        "column", "missing_raw", "missing_clean", "strategy",
        F.when(is_num, F.round(F.col("imputed_value").cast("double"), 6)).alias("fill_num"),
        F.when(~is_num, F.col("imputed_value")).alias("fill_cat"),
        F.when(is_num, F.round(F.col("raw_stat").cast("double"), 6)).alias("raw_num"),
        F.when(~is_num, F.col("raw_stat")).alias("raw_cat"),
    )


def q_describe(spark, sf):
    d = profile.describe_numeric(pipeline(spark, sf).clean, NUM)
    return d.select("column", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_skew(spark, sf):
    s = profile.skew_report(profile.skewness(pipeline(spark, sf).clean, NUM))
    return s.select("column", r6("skew").alias("skew"), "direction", "top")


def _corr(spark, sf):
    return profile.corr_matrix(pipeline(spark, sf).encoded, list(ENTITY_CORR_COLUMNS))


def q_corr(spark, sf):
    return _corr(spark, sf).select("a", "b", r6("r").alias("r"))


def q_corr_target(spark, sf):
    c = profile.corr_with_target(_corr(spark, sf), R.regression_target, BAND_CORR_TARGET)
    return c.select("column", r6("r").alias("r"), "strength")


def q_intercorr(spark, sf):
    preds = [c for c in ENTITY_CORR_COLUMNS if c != R.regression_target]
    c = profile.intercorrelations(_corr(spark, sf), preds, BAND_CORR_PAIR)
    return c.select("a", "b", r6("r").alias("r"), "risk")


def q_rate_by(spark, sf):
    c = pipeline(spark, sf).clean
    parts = [rates.rate_by(c, by, R.target).select(F.lit(by).alias("by_column"), "*") for by in ("department", "emp_type")]
    return parts[0].unionByName(parts[1]).withColumn("band", band("rate_pct", BAND_RATE))


def q_rate_extremes(spark, sf):
    r = rates.rate_by(pipeline(spark, sf).clean, "department", R.target)
    return rates.extremes(r, "rate_pct", "group")


def q_crosstab(spark, sf):
    return rates.crosstab(pipeline(spark, sf).clean, "department", R.target, [0, 1], ["Stayed", "Left"])


def q_group_mean(spark, sf):
    g = rates.group_mean(pipeline(spark, sf).clean, "department", R.target)
    return g.select("group", r6("mean_scaled").alias("mean_scaled"))


def q_group_counts(spark, sf):
    c = pipeline(spark, sf).clean.withColumn("label", F.when(F.col(R.target) == 0, "Stayed").otherwise("Left"))
    return rates.group_counts(c, "department", "label")


def q_box(spark, sf):
    b = profile.box_stats(pipeline(spark, sf).raw, list(BOX_COLS))
    return b.select("column", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3", "lo_fence", "hi_fence", "whisker_lo", "whisker_hi")], "outliers")


def q_hist(spark, sf):
    h = profile.histogram(event_values(spark, sf), "value", 30)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def q_kde(spark, sf):
    k = profile.kde(event_values(spark, sf), "value", 200)
    return k.select(F.col("point").cast("int").alias("point"), r6("x").alias("x"), F.round("density", 12).alias("density"))


def _top_skewed(spark, sf) -> list[str]:
    report = profile.skew_report(profile.skewness(pipeline(spark, sf).clean, NUM))
    return [r["column"] for r in report.where("top").orderBy("column").collect()]  # three names


def q_skew_hist(spark, sf):
    """Histograms of the three most skewed columns."""
    h = profile.histograms(pipeline(spark, sf).clean, _top_skewed(spark, sf), 30)
    return h.select("column", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def q_skew_kde(spark, sf):
    """Densities of the three most skewed columns."""
    k = profile.kdes(pipeline(spark, sf).clean, _top_skewed(spark, sf), 200)
    return k.select("column", "point", r6("x").alias("x"), F.round("density", 12).alias("density"))


def q_csv_source(spark, sf):
    """Orders written as CSV lines, some with NA tokens, a malformed price or a field too many, and read back with a declared schema."""
    o = read_table(spark, sf, "orders")
    key = F.col("o_orderkey")
    lines = o.select(F.concat_ws(
        ",", key.cast("string"), F.when(key % 7 == 0, "N/A").when(key % 11 == 0, "12,5x").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.when(key % 13 == 0, "").otherwise(F.col("o_orderstatus")), F.when(key % 100 == 3, "one field too many")).alias("value"))
    path = scratch_path(spark, "orders-csv")
    lines.write.text(path)
    schema = T.StructType.fromDDL("o_orderkey long, price double, status string")
    return read_entities(spark, path, schema, header=False, corrupt="malformed")


def q_set_compare(spark, sf):
    """Column names of customers and suppliers, and the parts of returned and of kept items: shared or only on one side."""
    def names(table, prefix):
        return spark.createDataFrame([("column", c.removeprefix(prefix)) for c in read_table(spark, sf, table).columns], "kind string, name string")

    items = read_table(spark, sf, "lineitem").select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("name"), "l_returnflag")
    left = names("customer", "c_").unionByName(items.where("l_returnflag = 'R'").drop("l_returnflag"))
    right = names("supplier", "s_").unionByName(items.where("l_returnflag <> 'R'").drop("l_returnflag"))
    return compare_sets(left, right, "shared", "left only", "right only")


def q_label_encode(spark, sf):
    return pipeline(spark, sf).dictionary


def q_features(spark, sf):
    c = pipeline(spark, sf).clean
    specs = {
        "salary_per_tenure": ("gross", "tenure", 1.0, None),
        "overtime_to_satisfaction": ("qty", "tax", 1.0, None),
        "promotion_rate": ("n_lines", "tenure", 1.0, None),
        "absence_to_tenure": ("supps", "tenure", 1.0, None),
        "promotion_rate_floored": ("n_lines", "tenure", 0.0, 0.5),
    }
    out = encode.add_ratio_features(c, specs)
    return out.select("id", *[r6(k).alias(k) for k in specs])


def q_split(spark, sf):
    c = sampling.hash_split(pipeline(spark, sf).clean, R.id, TEST_FRACTION, SPLIT_SEED)
    return c.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.target), 6).alias("target_rate"))


def q_strat_split(spark, sf):
    t = pipeline(spark, sf).tree_data
    return t.groupBy("is_test", R.target).agg(F.count(F.lit(1)).alias("n"))


def q_sample300(spark, sf):
    return pipeline(spark, sf).sample.select("id", "target")


def q_folds(spark, sf):
    d = pipeline(spark, sf).reg_data.where(~F.col("is_test"))
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def q_zscore(spark, sf):
    p = pipeline(spark, sf)
    rep = moments.zscore_report(p.clean, p.scaler)
    return rep.select("column", *[r6(c).alias(c) for c in ("mean", "std", "z_mean", "z_std")])


def _doc_pred(spark, sf):
    return document_view(spark, sf).withColumn("predicted", (F.col("n_chars") > 2000).cast("int"))


def q_confusion(spark, sf):
    return rates.confusion(_doc_pred(spark, sf), "toxic", "predicted")


def q_class_report(spark, sf):
    r = rates.classification_report(_doc_pred(spark, sf), "toxic", "predicted", (0, 1), ("Stayed", "Left"))
    return r.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


QUERIES = {
    "q_shape": q_shape,
    "q_suspicious": q_suspicious,
    "q_suspicious_rows": q_suspicious_rows,
    "q_dropped": q_dropped,
    "q_missing": q_missing,
    "q_value_counts": q_value_counts,
    "q_mapping": q_mapping,
    "q_clean": q_clean,
    "q_imputation": q_imputation,
    "q_describe": q_describe,
    "q_skew": q_skew,
    "q_corr": q_corr,
    "q_corr_target": q_corr_target,
    "q_intercorr": q_intercorr,
    "q_rate_by": q_rate_by,
    "q_rate_extremes": q_rate_extremes,
    "q_crosstab": q_crosstab,
    "q_group_mean": q_group_mean,
    "q_group_counts": q_group_counts,
    "q_box": q_box,
    "q_hist": q_hist,
    "q_kde": q_kde,
    "q_skew_hist": q_skew_hist,
    "q_skew_kde": q_skew_kde,
    "q_csv_source": q_csv_source,
    "q_set_compare": q_set_compare,
    "q_label_encode": q_label_encode,
    "q_features": q_features,
    "q_split": q_split,
    "q_strat_split": q_strat_split,
    "q_sample300": q_sample300,
    "q_folds": q_folds,
    "q_zscore": q_zscore,
    "q_confusion": q_confusion,
    "q_class_report": q_class_report,
}
