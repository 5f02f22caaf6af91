"""SQL (DuckDB dialect) of the exact decision tree: a recursive query that splits every node of a level at a time.

Each step looks at every midpoint of every feature in every open node (prefix sums by window), keeps the best one and
sends the rows, training and test, to the children.  All tree queries read its result: one row per (entity, node on its path).
"""

from __future__ import annotations

from collections.abc import Sequence

from cohortlab.plans import oracle as O
from cohortlab.roles import BAND_IMPORTANCE, DEPTH_GAP_BANDS, ENTITY, ENTITY_PROBE, PRUNED_DEPTH, SPLIT_SEED, TEST_FRACTION, TOP_N

R = ENTITY
FEATURES = R.tree_features()


def _value(c: str) -> str:
    if c in R.categorical:
        return f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS DOUBLE)"
    return f"CAST({c} AS DOUBLE)"


def grown(features: Sequence[str], max_depth: int | None = None) -> str:
    """CTEs: data (id, y, is_test, x), long (id, f, v), occ (id, node, pf, pt, y, is_test), node (node, depth, n, s, feature, threshold)."""
    x = ", ".join(map(_value, features))
    limit = "" if max_depth is None else f" AND length(node) < {max_depth}"
    name = "CASE f " + " ".join(f"WHEN {i} THEN {O.q(c)}" for i, c in enumerate(features)) + " END"
    return (
        f"WITH RECURSIVE {O.ENC_CTE}, "
        f"data AS MATERIALIZED (SELECT id, target AS y, row_number() OVER (PARTITION BY target ORDER BY {O._md5('id', SPLIT_SEED)}) "
        f"<= floor({TEST_FRACTION!r} * count(*) OVER (PARTITION BY target) + 0.5) AS is_test, [{x}] AS x FROM enc), "
        f"long AS MATERIALIZED (SELECT id, unnest(range({len(features)})) AS f, unnest(x) AS v FROM data), "
        "grow(id, node, pf, pt) AS (SELECT id, '', NULL::BIGINT, NULL::DOUBLE FROM data UNION ALL ("
        "WITH cur AS (SELECT g.id, g.node, d.y, d.is_test FROM grow g JOIN data d ON g.id = d.id), "
        f"st AS (SELECT node, count(*) AS n, sum(y) AS s FROM cur WHERE NOT is_test{limit} GROUP BY node HAVING sum(y) > 0 AND sum(y) < count(*)), "
        "v AS (SELECT c.node, l.f, l.v, st.n, st.s, count(*) AS c, sum(c.y) AS o FROM cur c JOIN st ON c.node = st.node JOIN long l ON c.id = l.id "
        "WHERE NOT c.is_test GROUP BY ALL), "
        "cum AS (SELECT node, f, v, n, CAST(s AS DOUBLE) AS s, lead(v) OVER w AS nv, sum(c) OVER w AS nl, CAST(sum(o) OVER w AS DOUBLE) AS sl FROM v "
        "WINDOW w AS (PARTITION BY node, f ORDER BY v)), "
        "best AS (SELECT node, f, v, nv FROM cum WHERE nv IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY node ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, v) = 1), "
        "pick AS (SELECT node, f, CASE WHEN (v + nv) / 2 < nv THEN (v + nv) / 2 ELSE v END AS t FROM best) "
        "SELECT c.id, c.node || CASE WHEN l.v <= a.t THEN '0' ELSE '1' END, a.f, a.t FROM cur c JOIN pick a ON c.node = a.node "
        "JOIN long l ON l.id = c.id AND l.f = a.f)), "
        "occ AS MATERIALIZED (SELECT g.*, d.y, d.is_test FROM grow g JOIN data d ON g.id = d.id), "
        "cnt AS (SELECT node, length(node) AS depth, count(*) FILTER (NOT is_test) AS n, sum(y) FILTER (NOT is_test) AS s FROM occ GROUP BY node), "
        "cuts AS (SELECT DISTINCT node[:length(node) - 1] AS node, pf AS f, pt AS threshold FROM occ WHERE node <> ''), "
        f"node AS MATERIALIZED (SELECT c.*, s / n AS p, f, {name} AS feature, threshold, f IS NULL AS is_leaf FROM cnt c LEFT JOIN cuts USING (node)) "
    )


def _heap(node: str) -> str:
    return (f"CAST((1 << length({node})) - 1 + coalesce(list_sum(list_transform(range(1, length({node}) + 1), "
            f"lambda i: CAST(substr({node}, i, 1) AS INTEGER) * (1 << (length({node}) - i)))), 0) AS INTEGER)")


def _exact(features: Sequence[str]) -> str:
    return grown(features, max_depth=3) + "SELECT node, feature, round(threshold, 6) AS threshold, n, round(p, 6) AS p FROM node"


def _struct() -> str:
    return grown(FEATURES) + (
        "SELECT CAST(max(depth) AS INTEGER) AS depth, CAST(count(*) FILTER (is_leaf) AS INTEGER) AS leaves, max(feature) FILTER (node = '') AS root_feature, "
        f"{len(FEATURES)} AS n_features, max(n) FILTER (node = '') AS n_train FROM node")


def _nodes() -> str:
    return grown(FEATURES, max_depth=PRUNED_DEPTH) + (
        f"SELECT {_heap('node')} AS node, CAST(depth AS INTEGER) AS depth, feature, round(threshold, 6) AS threshold, n, round(p, 6) AS p, is_leaf, "
        "CAST(p > 0.5 AS INTEGER) AS predicted FROM node")


CURVE = (
    ", lv AS (SELECT o.is_test, n.depth, n.is_leaf, sum(CAST(o.y = CAST(n.p > 0.5 AS INTEGER) AS INTEGER)) AS ok FROM occ o JOIN node n USING (node) GROUP BY ALL), "
    "tot AS (SELECT count(*) FILTER (NOT is_test) AS tr, count(*) FILTER (is_test) AS te FROM data), "
    "ds AS (SELECT unnest(range(1, (SELECT max(depth) + 1 FROM node))) AS depth), "
    "sz AS (SELECT d.depth, count(*) AS leaves FROM ds d JOIN node n ON n.depth = d.depth OR (n.is_leaf AND n.depth < d.depth) GROUP BY 1), "
    "curve AS (SELECT CAST(d.depth AS INTEGER) AS depth, round(sum(ok) FILTER (NOT is_test) / any_value(tr), 6) AS train_accuracy, "
    "round(sum(ok) FILTER (is_test) / any_value(te), 6) AS test_accuracy, CAST(any_value(sz.leaves) AS INTEGER) AS leaves "
    "FROM ds d JOIN lv ON lv.depth = d.depth OR (lv.is_leaf AND lv.depth < d.depth) JOIN sz ON sz.depth = d.depth, tot GROUP BY d.depth), "
    "opt AS (SELECT depth AS o FROM curve ORDER BY test_accuracy DESC, depth LIMIT 1) "
)


def _curve() -> str:
    return grown(FEATURES) + CURVE + (
        f"SELECT *, {O.band_sql('gap', DEPTH_GAP_BANDS)} AS gap_band, depth = o AS optimal, depth = {PRUNED_DEPTH} AS pruned, "
        "depth = (SELECT max(depth) FROM curve) AS unpruned FROM (SELECT *, round(train_accuracy - test_accuracy, 6) AS gap FROM curve), opt").replace("SELECT *, CASE", "SELECT * EXCLUDE (o), CASE")


def _prune_compare() -> str:
    return grown(FEATURES) + CURVE + (
        f", k AS (SELECT 'pruned' AS tree, least({PRUNED_DEPTH}, max(depth)) AS depth FROM curve UNION ALL SELECT 'unpruned', max(depth) FROM curve) "
        f"SELECT *, {O.band_sql('gap', DEPTH_GAP_BANDS)} AS gap_band FROM (SELECT k.tree, c.*, round(train_accuracy - test_accuracy, 6) AS gap FROM curve c JOIN k USING (depth))")


def _zones() -> str:
    return grown(FEATURES) + CURVE + (
        ", q AS (SELECT quantile_cont(test_accuracy, 0.33) AS q33, max(depth) AS d FROM curve) "
        "SELECT any_value(o) AS optimal_depth, max(test_accuracy) FILTER (depth = o) AS optimal_test_accuracy, "
        "max(train_accuracy) FILTER (depth = o) AS optimal_train_accuracy, max(depth) FILTER (test_accuracy < q33) AS underfit_max_depth, "
        "coalesce(min(depth) FILTER (depth > o AND train_accuracy - test_accuracy > 0.05), any_value(o) + 1) AS overfit_start, "
        "max(depth) AS full_depth, max(round(train_accuracy - test_accuracy, 6)) FILTER (depth = d) AS full_gap FROM curve, opt, q")


def _paths() -> str:
    return grown(FEATURES, max_depth=PRUNED_DEPTH) + (
        f"SELECT o.id, CAST(n.depth AS INTEGER) AS step, {_heap('o.node')} AS node, CASE WHEN n.is_leaf THEN 'leaf' ELSE 'split' END AS type, n.feature, "
        "round(n.threshold, 6) AS threshold, round(l.v, 6) AS value, CASE WHEN l.v <= n.threshold THEN 'left' WHEN l.v > n.threshold THEN 'right' END AS direction, "
        "CASE WHEN n.is_leaf THEN CAST(CAST(n.p > 0.5 AS INTEGER) AS VARCHAR) END AS prediction "
        "FROM occ o JOIN node n USING (node) LEFT JOIN long l ON l.id = o.id AND l.f = n.f")


def _probe() -> str:
    probe = ", ".join(repr(float(ENTITY_PROBE[f])) for f in FEATURES)
    return grown(FEATURES, max_depth=PRUNED_DEPTH) + (
        f", walk(node) AS (SELECT '' UNION ALL SELECT w.node || CASE WHEN [{probe}][n.f + 1] <= n.threshold THEN '0' ELSE '1' END "
        "FROM walk w JOIN node n ON n.node = w.node WHERE NOT n.is_leaf) "
        f"SELECT CAST(-1 AS BIGINT) AS id, CAST(n.depth AS INTEGER) AS step, {_heap('n.node')} AS node, CASE WHEN n.is_leaf THEN 'leaf' ELSE 'split' END AS type, "
        f"n.feature, round(n.threshold, 6) AS threshold, round([{probe}][n.f + 1], 6) AS value, "
        f"CASE WHEN [{probe}][n.f + 1] <= n.threshold THEN 'left' WHEN [{probe}][n.f + 1] > n.threshold THEN 'right' END AS direction, "
        "CASE WHEN n.is_leaf THEN CAST(CAST(n.p > 0.5 AS INTEGER) AS VARCHAR) END AS prediction FROM walk JOIN node n USING (node)")


def _importance() -> str:
    return grown(FEATURES) + (
        ", dec AS (SELECT a.feature, sum(l.s * l.s / l.n + r.s * r.s / r.n - a.s * a.s / a.n) AS d FROM node a JOIN node l ON l.node = a.node || '0' "
        "JOIN node r ON r.node = a.node || '1' GROUP BY 1), "
        f"names AS (SELECT unnest({list(FEATURES)!r}) AS feature), "
        "imp AS (SELECT n.feature, coalesce(d / (SELECT sum(d) FROM dec), 0) AS i FROM names n LEFT JOIN dec USING (feature)), "
        f"top AS (SELECT CAST(row_number() OVER (ORDER BY i DESC, feature) AS INTEGER) AS rank, feature, round_even(i * 100, 2) AS importance_pct FROM imp QUALIFY rank <= {TOP_N}) "
        f"SELECT *, round(importance_pct / max(importance_pct) OVER (), 6) AS share_of_max, {O.band_sql('importance_pct', BAND_IMPORTANCE, inclusive=True)} AS band FROM top")


SCORED = ", scored AS (SELECT o.id, o.y, o.is_test, n.p FROM occ o JOIN node n USING (node) WHERE n.is_leaf) "


def _probability() -> str:
    return grown(FEATURES) + SCORED + "SELECT id, round(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS predicted, is_test FROM scored"


def _confusion() -> str:
    return grown(FEATURES) + SCORED + "SELECT y AS actual, CAST(p > 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scored WHERE is_test GROUP BY 1, 2"


def _report() -> str:
    tail = O._class_report()
    start = "WITH v AS (SELECT toxic AS a, CAST(n_chars > 2000 AS INTEGER) AS p FROM documents d JOIN labels l USING (doc_id))"
    if not tail.startswith(start):
        raise ValueError("the report's first step changed")
    return grown(FEATURES) + SCORED + ", v AS (SELECT y AS a, CAST(p > 0.5 AS INTEGER) AS p FROM scored WHERE is_test)" + tail[len(start) :]


def oracle_sql(exact_features: Sequence[str]) -> dict[str, str]:
    return {
        "q_tree_exact": _exact(exact_features), "q_tree_struct": _struct(), "q_tree_nodes": _nodes(), "q_depth_curve": _curve(),
        "q_prune_compare": _prune_compare(), "q_depth_zones": _zones(), "q_paths": _paths(), "q_probe_path": _probe(), "q_importance": _importance(),
        "q_probability": _probability(), "q_tree_confusion": _confusion(), "q_tree_report": _report(),
    }
