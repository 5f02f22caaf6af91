import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import tree


def test_variance_tree_keeps_same_class_siblings(spark):
    # two groups with P(class 1) = 0.1 and 0.4: both leaves predict class 0,
    # a classifier would merge them; the variance tree keeps both
    rows = [(0.0, 1 if i < 10 else 0) for i in range(100)] + [(1.0, 1 if i < 40 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, label int")
    fit = tree.fit_tree(df, ["x"], "label", max_depth=3)
    nodes = {r.node: r for r in fit.nodes.collect()}
    preds = sorted(round(n.p, 6) for n in nodes.values() if n.is_leaf)
    assert preds == [0.1, 0.4]
    assert nodes[""].threshold == 0.5


def test_depth_curve_equals_refits(spark):
    rng = np.random.default_rng(3)
    n = 1500
    X = rng.integers(0, 6, size=(n, 3)).astype(float)
    y = ((X[:, 0] + rng.normal(scale=1.5, size=n) > 2.5) ^ (X[:, 1] > 3)).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y, is_test=np.arange(n) % 3 == 0, id=np.arange(n))
    df = spark.createDataFrame(pdf)
    train = df.where(~F.col("is_test"))
    deep = tree.fit_tree(train, ["a", "b", "c"], "label", max_depth=6)
    curve = tree.depth_curve(deep, tree.leaf_counts(deep, df, "label", "is_test")).orderBy("depth").collect()
    for d in range(1, 5):
        fit = tree.fit_tree(train, ["a", "b", "c"], "label", max_depth=d)
        sc = tree.with_leaf(fit, df).withColumn("ok", ((F.col("p") > 0.5).cast("int") == F.col("label")).cast("double"))
        acc = {r["is_test"]: r["a"] for r in sc.groupBy("is_test").agg(F.avg("ok").alias("a")).collect()}
        assert abs(curve[d - 1]["train_accuracy"] - acc[False]) < 1e-12
        assert abs(curve[d - 1]["test_accuracy"] - acc[True]) < 1e-12
    # train accuracy never decreases with depth
    tr = [r["train_accuracy"] for r in curve]
    assert all(b >= a - 1e-12 for a, b in zip(tr, tr[1:]))


def test_paths_value_at_threshold_goes_left(spark):
    rows = [(float(i % 4), 1 if i % 4 >= 2 else 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, label int, id int")
    fit = tree.fit_tree(df, ["x"], "label", max_depth=2)
    thr = fit.nodes.where("node = ''").collect()[0].threshold
    probe = spark.createDataFrame([(thr, 0, 999)], "x double, label int, id int")
    path = tree.trace_paths(fit, probe, "id").orderBy("step").collect()
    assert path[0]["direction"] == "left" and path[-1]["type"] == "leaf"
    imp = dict(tree.importances(fit).collect())
    assert abs(sum(imp.values()) - 1.0) < 1e-9


def test_probe_row_is_scored_like_the_model(spark):
    rows = [(float(i % 5), float(i % 3), 1 if (i % 5) >= 3 else 0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, label int, id int")
    fit = tree.fit_tree(df, ["a", "b"], "label", max_depth=3)
    probe = spark.createDataFrame([(4.0, 0.0, 0, -1)], "a double, b double, label int, id int")
    p = tree.with_leaf(fit, probe).collect()[0]
    path = tree.trace_paths(fit, probe, "id").orderBy("step").collect()
    leaf = {r.node: r for r in fit.nodes.collect()}[path[-1]["node"]]
    assert p["leaf"] == leaf.node and p["p"] == leaf.p and path[-1]["prediction"] == (1 if leaf.p > 0.5 else 0)


def brute_tree(X, y, max_depth=None):
    """Node -> (n, s, feature, threshold) by exhaustive search."""
    out, todo = {}, [("", list(range(len(y))))]
    while todo:
        node, rows = todo.pop()
        n, s = len(rows), sum(y[i] for i in rows)
        best = None
        if 0 < s < n and (max_depth is None or len(node) < max_depth):
            for f in range(len(X[0])):
                values = sorted({X[i][f] for i in rows})
                for v, w in zip(values, values[1:]):
                    left = [i for i in rows if X[i][f] <= v]
                    nl, sl = len(left), sum(y[i] for i in left)
                    gain = sl * sl / nl + (s - sl) * (s - sl) / (n - nl)
                    if best is None or gain > best[0]:
                        middle = (v + w) / 2
                        best = (gain, f, middle if middle < w else v)
        if best is None:
            out[node] = (n, s, None, None)
            continue
        _, f, t = best
        out[node] = (n, s, f, t)
        todo += [(node + "0", [i for i in rows if X[i][f] <= t]), (node + "1", [i for i in rows if X[i][f] > t])]
    return out


@pytest.mark.parametrize("local_rows, max_depth", [(0, 4), (40, None), (10_000, None), (10_000, 3)])
def test_splits_are_exact_in_both_phases(spark, local_rows, max_depth):
    rng = np.random.default_rng(9)
    n = 220
    X = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e9)])
    y = ((X[:, 0] + X[:, 1] * 0.3 + rng.normal(scale=0.8, size=n)) > 0.5).astype(int)
    X[:12, 0], X[5:20, 2] = np.inf, np.inf  # what nulls and NaN count as
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y, id=np.arange(n))
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") < 6, None).when(F.col("id") < 12, float("nan")).otherwise(F.col("a")))
    df = df.withColumn("c", F.when((F.col("id") >= 5) & (F.col("id") < 20), None).otherwise(F.col("c"))).repartition(5)
    fit = tree.fit_tree(df, ["a", "b", "c"], "label", max_depth, local_rows)
    got = {r.node: (r.n, r.s, r.feature, r.threshold) for r in fit.nodes.collect()}
    assert got == brute_tree(X.tolist(), y.tolist(), max_depth)
    assert fit.depth == max(map(len, got))
    scored = {r.id: (r.leaf, r.p) for r in tree.with_leaf(fit, df).collect()}
    for i in range(n):
        node = ""
        while got[node][2] is not None:
            node += "0" if X[i, got[node][2]] <= got[node][3] else "1"
        assert scored[i] == (node, got[node][1] / got[node][0])


def test_odd_training_tables(spark):
    schema = "x double, label int, p double, leaf string, node string"
    none = tree.fit_tree(spark.createDataFrame([], schema), ["x"], "label")
    assert none.nodes.count() == 0 and none.depth == 0
    rows = [(1.0, 1, 0.0, "a", "b"), (1.0, 0, 0.0, "a", "b"), (None, None, 0.0, "a", "b")]
    df = spark.createDataFrame(rows, schema)
    fit = tree.fit_tree(df, ["x"], "label")  # constant feature: one leaf
    assert [(r.n, r.s, r.is_leaf) for r in fit.nodes.collect()] == [(2, 1, True)]
    assert {(r.leaf, r.p, r.node) for r in tree.with_leaf(fit, df).collect()} == {("", 0.5, "b")}
    assert dict(tree.importances(fit).collect()) == {"x": 0.0}
