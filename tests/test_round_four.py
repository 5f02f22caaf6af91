"""Sessions without Arrow, hot grid buckets, tree levels by bounds: findings of the third round."""

import numpy as np
import pytest

from cohortlab.operators import cells, segments, tree


def test_cells_become_a_table_without_arrow(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(c, 0.5, (20, 2)) for c in (0, 9)])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        found = cells.feature_cells(points, 10)
        rows = {r["cell"]: r for r in found.frame().collect()}
        lk = segments.agglomerate(found.frame().withColumnRenamed("cell", "id"), [("complete", "euclidean")])
    finally:
        spark.conf.set(key, before)
    assert sum(r["n"] for r in rows.values()) == 40 and len(rows) == len(found.table) <= 10
    for t in found.table.itertuples():
        assert rows[t.cell]["mean"] == pytest.approx(t.mean) and rows[t.cell]["high"] == pytest.approx(t.high)
    (labels,) = segments.cut_labels(lk, 2).values()
    sizes = [sum(rows[c]["n"] for c, k in labels.items() if k == cluster) for cluster in (0, 1)]
    assert sizes == [20, 20]


def test_neighbours_ask_few_buckets(spark):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.uniform(-3, 3, (250, 6)), rng.uniform(0, 0.4, (30, 6)), [[0.0] * 6, [1.0, 0, 0, 0, 0, 0], [-1.0, 0, 0, 0, 0, 0]]])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    found = segments.neighbours(points, 1.0)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = {(i, j): D[i, j] for i in range(len(X)) for j in range(i + 1, len(X)) if D[i, j] <= 1.0}
    rows = found.collect()
    assert len(rows) == len(want) > 400 and {(r.i, r.j): r.euclidean for r in rows} == pytest.approx(want)
    short = spark.createDataFrame([(1, [0.0]), (2, [0.5]), (3, [2.0]), (4, None), (5, [float("nan")]), (6, [None])], "id long, vec array<double>")
    assert [(r.i, r.j) for r in segments.neighbours(short, 1.0).collect()] == [(1, 2)]
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_4" in keys  # five coordinates in a bucket's key


@pytest.mark.parametrize("bins", [4, 64])
def test_split_search_by_bounds_finds_the_best_cut(spark, monkeypatch, bins):
    monkeypatch.setattr(tree, "BINS", bins)
    monkeypatch.setattr(tree, "EDGE_ROWS", 100)
    rng = np.random.default_rng(12)
    X = np.stack([rng.normal(size=400), rng.integers(0, 5, 400).astype(float), rng.exponential(size=400).round(1)], axis=1)
    y = ((X[:, 0] > 0.3) ^ (rng.random(400) < 0.3)).astype(int)
    rows = [(*(None if rng.random() < 0.05 else float(v) for v in x), int(c), i) for i, (x, c) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, id long")
    columns = ["node", "n", "s", "feature", "threshold"]
    one, many = (sorted(map(tuple, tree.fit_tree(df, ["a", "b", "c"], "label", max_depth=3, local_rows=k).nodes.select(*columns).collect()), key=str) for k in (0, 10_000))
    assert one == many and len(one) > 7


def test_paths_of_the_pruned_tree_walk_one_block(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, float(x), int(rng.random() < 0.5)) for i, x in enumerate(rng.random(300))], "id long, a double, label int")
    fit = tree.fit_tree(df, ["a"], "label")
    assert fit.depth > 2 * tree.BLOCK
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    short = tree.trace_paths(fit, df, "id", max_depth=4)
    assert short._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    spark.conf.set(key, "-1")
    try:
        whole = {(r.id, r.step, r.node, r.feature, r.threshold) for r in tree.trace_paths(fit, df, "id").where("step < 4").collect()}
    finally:
        spark.conf.set(key, before)
    got = short.collect()
    assert {(r.id, r.step, r.node, r.feature, r.threshold) for r in got if r.step < 4 and r.type == "split"} == {x for x in whole if x[3]}
    assert tree.with_leaf(fit, df, ["id"]).columns == ["id", "leaf", "p"]


def test_bins_are_counted_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(tree, "BINS", 3)
    monkeypatch.setattr(tree, "SLOTS", 2)  # five nodes: a task gives up its bins several times
    rng = np.random.default_rng(14)
    x, b, y, node = rng.normal(size=(300, 2)), rng.integers(0, 3, (300, 2)), rng.integers(0, 2, 300), rng.integers(0, 5, 300)
    x[:9, 0] = np.inf
    rows = [(format(int(k), "03b"), int(c), v.tolist(), w.tolist()) for k, c, v, w in zip(node, y, x, b)]
    found = tree._bin_counts(spark.createDataFrame(rows, "node string, y long, x array<double>, b array<int>").repartition(3))
    got = {(r.node, r.f, r.b): (r.n, r.s, r.low, r.high) for r in found.collect()}
    want = {}
    for k, c, v, w in rows:
        for f in range(2):
            want.setdefault((k, f, w[f]), []).append((v[f], c))
    assert got == {key: (len(z), sum(c for _, c in z), min(v for v, _ in z), max(v for v, _ in z)) for key, z in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # no row a value


def test_histograms_place_values_without_a_join(spark):
    from cohortlab.operators import profile

    df = spark.createDataFrame([(0.0, 1.0, None), (1.0, 1.0, None), (None, 1.0, None), (3.0, None, None), (2.9, 1.0, None)], "a double, b double, c double")
    found = profile.histograms(df, ["a", "b", "c"], 3)
    assert [(r.bin, r.lo, r.hi, r.n) for r in found.where("column = 'a'").orderBy("bin").collect()] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (2, 2.0, 3.0, 2)]
    assert [r.n for r in found.where("column = 'b'").orderBy("bin").collect()] == [4, 0, 0]
    assert found.where("column = 'c'").count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the grid with its counts
