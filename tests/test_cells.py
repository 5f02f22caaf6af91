"""Cells of whole tables: exactness for few points, bounds for many, linkage and silhouettes on weighted cells."""

import numpy as np
import pandas as pd
import pytest

from cohortlab.operators import cells, segments


def frame(spark, X, **more):
    pdf = pd.DataFrame({"id": np.arange(len(X)) * 3 + 1, "vec": [list(map(float, x)) for x in X], **more})
    return spark.createDataFrame(pdf, ", ".join(["id long", "vec array<double>", *(f"{k} int" for k in more)])).repartition(4)


def brute_silhouette(X, label):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    out = []
    for i in range(len(X)):
        mine = np.flatnonzero(label == label[i])
        others = [D[i, label == c].mean() for c in set(label.tolist()) if c != label[i]]
        if len(mine) < 2 or not others:
            out.append(0.0)
            continue
        a, b = D[i, mine].sum() / (len(mine) - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_cells_hold_every_row_and_its_statistics(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 1, (300, 4)), np.tile([9.0, 9, 9, 9], (150, 1)), rng.normal(50, 0.1, (1, 4))])
    found = cells.feature_cells(frame(spark, X), 40)
    assert 20 < len(found.table) <= 40 and found.table["n"].sum() == len(X)
    rows = found.rows.toPandas()
    assert sorted(rows["id"]) == [3 * i + 1 for i in range(len(X))]
    for r in found.table.itertuples():
        points = np.stack(rows[rows["cell"] == r.cell]["vec"])
        assert r.first == rows[rows["cell"] == r.cell]["id"].min() and r.n == len(points)
        assert np.allclose(r.mean, points.mean(0)) and np.allclose(r.ss, ((points - points.mean(0)) ** 2).sum(0), atol=1e-9)
        assert np.allclose(r.low, points.min(0)) and np.allclose(r.high, points.max(0))
    rare = rows[rows["id"] == 3 * (len(X) - 1) + 1]["cell"].iloc[0]
    assert (rows["cell"] == rare).sum() == 1  # one far row in 451 has a cell of its own


def test_distinct_points_get_their_own_cells(spark):
    X = np.array([[0.0, 0], [0, 0], [1, 0], [np.nextafter(1.0, 2), 0], [5, 5], [5, 5], [-0.0, 0]])
    found = cells.feature_cells(frame(spark, X), 100)
    assert sorted(found.table["n"]) == [1, 1, 2, 3] and all(v.sum() == 0 for v in found.table["ss"])


def test_odd_rows_and_groups(spark):
    data = [(1, [0.0, 1.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [0.0, 1.0], 2), (6, [0.0, 1.0], None), (None, [3.0, 1.0], 2)]
    points = spark.createDataFrame(data, "id long, vec array<double>, label int")
    found = cells.feature_cells(points, 1, by=["label"])
    assert sorted(found.table["n"]) == [1, 1, 2] and found.rows.count() == 4  # one cell a label at least
    none = cells.feature_cells(points.limit(0), 10)
    assert len(none.table) == 0 and none.rows.count() == 0
    assert cells.silhouettes(none, pd.DataFrame({"cell": [], "cluster": []})).count() == 0


def test_silhouette_is_exact_for_few_points_and_bounded_for_many(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 1.0, (60, 3)) for c in (0, 3, 6)] + [[[90.0, 0, 0]]])
    label = np.array([0] * 60 + [1] * 60 + [2] * 60 + [3])
    want = brute_silhouette(X, label)
    points = frame(spark, X, label=label)
    previous = None
    for budget in (8, 30, 100, 400):
        found = cells.feature_cells(points, budget, by=["label"])
        cluster = found.rows.groupBy("cell").agg({"label": "first"}).withColumnRenamed("first(label)", "cluster").toPandas()
        (r,) = cells.silhouettes(found, cluster).collect()
        assert r.n == len(X) and abs(r.silhouette - want) <= r.error_bound + 1e-9
        assert previous is None or r.error_bound < previous
        previous = r.error_bound
    assert previous < 1e-9


def test_silhouettes_of_several_labellings(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(0, 1, (25, 2))
    found = cells.feature_cells(frame(spark, X), 100)
    order = found.rows.orderBy("cell").toPandas()
    P = np.stack(order["vec"])
    parts = {"a": np.arange(25) % 3, "b": (P[:, 0] > 0).astype(int), "one": np.zeros(25, int)}
    labels = pd.concat([pd.DataFrame({"method": k, "cell": order["cell"], "cluster": v}) for k, v in parts.items()])
    got = {r.method: r.silhouette for r in cells.silhouettes(found, labels, ["method"]).collect()}
    assert got == pytest.approx({k: brute_silhouette(P, v) for k, v in parts.items()})


def sequential(pairs, n, method):
    """Heights of a sequential linkage on weighted cells: pairs[(i, j)] = (average distance, farthest, squared)."""
    size = dict(enumerate(n))
    avg = {k: v[0] for k, v in pairs.items()}
    far = {k: v[1] for k, v in pairs.items()}
    use, heights = (avg if method == "average" else far), []
    while len(size) > 1:
        (i, j), h = min(use.items(), key=lambda x: (x[1], x[0]))
        heights.append(h)
        for k in size:
            if k not in (i, j):
                a, b, c = (min(i, k), max(i, k)), (min(j, k), max(j, k)), (min(i, k), max(i, k))
                avg[c] = (size[i] * avg[a] + size[j] * avg[b]) / (size[i] + size[j])
                far[c] = max(far[a], far[b])
        size[i] += size.pop(j)
        for table in (avg, far):
            for key in [key for key in table if j in key]:
                del table[key]
    return heights


def test_linkage_of_weighted_cells(spark):
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(c, 0.7, (80, 3)) for c in (0, 4, 9)])
    found = cells.feature_cells(frame(spark, X), 64)
    t = found.table
    combos = [("average", "euclidean"), ("complete", "euclidean"), ("ward", "euclidean"), ("average", "manhattan"), ("complete", "manhattan")]
    lk = segments.agglomerate(found.frame().withColumnRenamed("cell", "id"), combos)
    n, mean, ss = t["n"].to_numpy(), np.stack(t["mean"]), np.stack(t["ss"])
    low, high = np.stack(t["low"]), np.stack(t["high"])
    for metric in ("euclidean", "manhattan"):
        pairs = {}
        for i in range(len(t)):
            for j in range(i + 1, len(t)):
                square = (mean[i] - mean[j]) ** 2 + ss[i] / n[i] + ss[j] / n[j]
                gap = np.maximum(high[i] - low[j], high[j] - low[i])
                pairs[i, j] = (np.sqrt(square.sum()), np.sqrt((gap**2).sum())) if metric == "euclidean" else (np.sqrt(square).sum(), gap.sum())
        for method in ("average", "complete"):
            got = [s[3] for s in lk.merges[combos.index((method, metric))]]
            assert np.allclose(sorted(got), sorted(sequential(pairs, n.tolist(), method)), atol=1e-9)
    # ward: the sum of squared heights is twice the scatter between cells
    center = (n @ mean) / n.sum()
    assert sum(s[3] ** 2 for s in lk.merges[2]) == pytest.approx(2 * float(n @ ((mean - center) ** 2).sum(1)))
    for lab in segments.cut_labels(lk, 3).values():
        sizes = {}
        for cell, cluster in lab.items():
            sizes[cluster] = sizes.get(cluster, 0) + int(n[cell])
        assert sizes == {0: 80, 1: 80, 2: 80}


def test_blocked_pairs_and_neighbours_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.uniform(-2, 2, (150, 4)), np.tile([0.5, 0.5, 0.5, 0.5], (40, 1))])
    points = frame(spark, X).unionByName(spark.createDataFrame([(5000, None)], "id long, vec array<double>"))
    ids = np.arange(len(X)) * 3 + 1
    monkeypatch.setattr(segments, "BLOCK_ROWS", 17)
    whole = segments.pairwise(points.where("vec is not null"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {(r.i, r.j): (r.euclidean, r.manhattan) for r in whole.collect()}
    assert len(got) == len(X) * (len(X) - 1) // 2
    assert all(np.isclose(got[ids[i], ids[j]], (np.sqrt(((X[i] - X[j]) ** 2).sum()), np.abs(X[i] - X[j]).sum())).all() for i in range(0, 190, 7) for j in range(i + 1, 190))
    near = {(r.i, r.j): r.euclidean for r in segments.neighbours(points, 0.9).collect()}
    D = np.sqrt(((X[:151, None] - X[None, :151]) ** 2).sum(-1))  # the 40 equal points are one
    want = {(int(ids[i]), int(ids[j])): D[i, j] for i in range(151) for j in range(i + 1, 151) if D[i, j] <= 0.9}
    assert near == pytest.approx(want) and len(want) > 50
