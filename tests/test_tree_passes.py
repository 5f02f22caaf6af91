"""The tree on larger tables: pieces of many rows, subtrees grown level by level, scoring in at most one shuffle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import tree
from tests.test_tree import brute_tree


@pytest.mark.parametrize("max_depth", [None, 3])
def test_subtrees_grown_by_level_have_the_splits_of_all_cuts(max_depth):
    rng = np.random.default_rng(21)
    X = np.column_stack([rng.normal(size=150), rng.integers(0, 3, 150), np.where(rng.random(150) < 0.2, np.inf, rng.integers(0, 40, 150))]).astype(float)
    y = (X[:, 0] + rng.normal(size=150) > 0).astype(np.int64)
    X[:20] = X[0]  # equal rows of both classes
    rows = {}
    for batch in tree._grow(X, y, "", max_depth):
        for r in batch.to_pylist():
            rows[r["node"]] = r
    assert {k: (r["n"], r["s"], r["feature"], r["threshold"]) for k, r in rows.items()} == brute_tree(X.tolist(), y.tolist(), max_depth)
    place = {r["at"]: k for k, r in rows.items()}
    assert sorted(place) == list(range(len(rows)))
    for k, r in rows.items():
        assert (r["child"], r["other"]) == (-1, -1) if r["feature"] is None else (place[r["child"]], place[r["other"]]) == (k + "0", k + "1")


@pytest.fixture(scope="module")
def deep(spark):
    rng = np.random.default_rng(22)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float), "label": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") % 50 > 0, F.col("a"))).repartition(3)


@pytest.mark.parametrize("shared", [0, 10**6])
@pytest.mark.parametrize("local_rows", [400, 10_000])
def test_rows_meet_their_subtree_in_one_shuffle(spark, monkeypatch, deep, shared, local_rows):
    monkeypatch.setattr(tree, "SHARED_NODES", shared)
    fit = tree.fit_tree(deep, ["a", "b"], "label", local_rows=local_rows)
    assert fit.depth > 2 * tree.BLOCK
    scored = tree.with_leaf(fit, deep, ["id", F.col("label").alias("leaving")])
    assert scored.columns == ["id", "leaving", "leaf", "p"]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    before = deep._jdf.queryExecution().optimizedPlan().toString().count("Repartition")
    assert plan.count("Join ") == 0 and plan.count("Repartition") == before + (0 if shared else 1)
    nodes = {r.node: r for r in fit.nodes.collect()}
    values = {r.id: r for r in deep.collect()}
    rows = scored.collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    for r in rows:
        node, at = "", values[r.id]
        while nodes[node].feature is not None:
            v = (at.a, at.b)[nodes[node].feature]
            node += "0" if v is not None and v <= nodes[node].threshold else "1"
        assert (r.leaf, r.p, r.leaving) == (node, nodes[node].p, at.label)


def test_rows_are_stored_in_pieces_and_only_when_half_have_left(spark, monkeypatch, deep):
    stored, inner = [], tree._cut

    def cut(df, kind):
        out = inner(df, kind)
        if kind == "tree-rows":
            stored.append((out.count(), out.agg(F.sum("n")).collect()[0][0]))
        return out

    monkeypatch.setattr(tree, "_cut", cut)
    fit = tree.fit_tree(deep, ["a", "b"], "label", local_rows=300)
    assert stored[0][1] == 3000 and stored[0][0] <= 6  # not a row for each
    assert len(stored) > 1 and all(2 * b[1] < a[1] for a, b in zip(stored, stored[1:]))
    whole = tree.fit_tree(deep, ["a", "b"], "label", local_rows=10_000)
    key = ["node", "n", "s", "feature", "threshold", "decrease"]
    assert set(map(tuple, fit.nodes.select(*key).collect())) == set(map(tuple, whole.nodes.select(*key).collect()))
