"""Queries on the pruned tree grow only its levels; nodes below one node are met together."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlab.operators import tree
from cohortlab.plans import model_queries, pipeline as plan
from cohortlab.roles import PRUNED_DEPTH


def test_paths_grow_the_pruned_tree_only(spark, monkeypatch):
    n = 1200
    rng = np.random.default_rng(8)
    X = rng.normal(size=(n, 2))
    y = (X[:, 0] * X[:, 1] + rng.normal(scale=0.3, size=n) > 0).astype(int)
    R = plan.ENTITY
    df = spark.createDataFrame(pd.DataFrame(X, columns=["f", "g"]).assign(**{R.id: np.arange(n), R.target: y, "is_test": np.arange(n) % 3 == 0}))
    p = plan.Pipeline(spark, "made")
    p.tree_data = df
    monkeypatch.setattr(plan.Pipeline, "tree_features", ["f", "g"])
    monkeypatch.setattr(model_queries, "pipeline", lambda *_: p)
    got = {tuple(r) for r in model_queries.q_paths(spark, "made").collect()}
    nodes = {tuple(r) for r in model_queries.q_tree_nodes(spark, "made").collect()}
    assert "tree" not in p.__dict__ and p.pruned_tree.depth == PRUNED_DEPTH
    full = plan.Pipeline(spark, "made")
    full.tree_data = df
    assert full.tree.depth > PRUNED_DEPTH and full.pruned_tree is full.tree
    monkeypatch.setattr(model_queries, "pipeline", lambda *_: full)
    assert got == {tuple(r) for r in model_queries.q_paths(spark, "made").collect()}
    assert nodes == {tuple(r) for r in model_queries.q_tree_nodes(spark, "made").collect()}


def test_rows_are_cut_by_node_and_small_nodes_have_fewer_bins(spark, monkeypatch):
    rng = np.random.default_rng(9)
    X = rng.integers(0, 400, size=(1500, 2)).astype(float)
    y = (X[:, 0] + X[:, 1] + rng.normal(scale=80, size=1500) > 400).astype(int)
    df = spark.createDataFrame(pd.DataFrame(X, columns=["f", "g"]).assign(label=y)).repartition(3)
    kinds, inner = [], tree._cut

    def cut(rows, kind):
        out = inner(rows, kind)
        if kind == "tree-rows" and "feature" not in rows.columns:
            spread = out.withColumn("at", F.input_file_name()).groupBy("at").agg(F.collect_list("node").alias("nodes")).collect()
            kinds.append(all(r["nodes"] == sorted(r["nodes"]) for r in spread))
        return out

    monkeypatch.setattr(tree, "_cut", cut)
    key = ["node", "n", "s", "feature", "threshold"]
    found = {tuple(r) for r in tree.fit_tree(df, ["f", "g"], "label", max_depth=5, local_rows=0).nodes.select(*key).collect()}
    monkeypatch.setattr(tree, "COARSE_ROWS", 0)
    fine = {tuple(r) for r in tree.fit_tree(df, ["f", "g"], "label", max_depth=5, local_rows=0).nodes.select(*key).collect()}
    local = {tuple(r) for r in tree.fit_tree(df, ["f", "g"], "label", max_depth=5).nodes.select(*key).collect()}
    assert found == fine == local
    assert len(kinds) >= 2 and all(kinds)
