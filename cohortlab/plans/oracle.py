"""Independent SQL (DuckDB dialect) for the registered queries.

The SQL rebuilds the entity view and the cleaning chain from the base
tables with its own functions (``median``, ``quantile_cont``, window ranks,
``md5``), so a match checks the Spark operators end to end.  Rule values and
maps come from :mod:`cohortlab.roles` so both sides use the same parameters.
"""

from __future__ import annotations

from cohortlab.roles import (
    BAND_CORR_PAIR,
    BAND_CORR_TARGET,
    BAND_MISSING_PCT,
    BAND_RATE,
    ENTITY,
    ENTITY_CLUSTER_FEATURES,
    ENTITY_CORR_COLUMNS,
    ENTITY_SHIFT_ORDER,
    RangeRule,
)
from cohortlab.sources.fixtures import NULL_EVERY, TENURE_AS_OF, VARIANT_MOD

R = ENTITY


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def title_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
        f"regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') THEN upper(substr({x}, i, 1)) "
        f"ELSE lower(substr({x}, i, 1)) END), '')"
    )


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def outside_sql(r: RangeRule) -> str:
    conds = []
    if r.lo is not None:
        conds.append(f"{r.column} {'<=' if r.lo_open else '<'} {r.lo!r}")
    if r.hi is not None:
        conds.append(f"{r.column} > {r.hi!r}")
    return f"({r.column} IS NOT NULL AND ({' OR '.join(conds)}))"


def band_sql(x: str, bands, inclusive: bool = False) -> str:
    op = ">=" if inclusive else ">"
    parts, default = [], None
    for bound, label in bands:
        if bound is None:
            default = label
        else:
            parts.append(f"WHEN {x} {op} {bound!r} THEN {q(label)}")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {q(default)} END"


NUM = list(R.numeric)
CAT = list(R.categorical)

RAW_CTE = f"""
li AS (
  SELECT l_orderkey,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned_,
         sum(l_extendedprice) AS gross, count(*) AS n_lines_, sum(l_quantity) AS qty,
         avg(l_discount) * 100 AS disc, avg(l_tax) * 100 AS tax,
         count(DISTINCT l_partkey) AS parts_, count(DISTINCT l_suppkey) AS supps_
  FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS hired,
         CAST(coalesce(li.returned_, 0) AS INTEGER) AS target,
         c.c_acctbal AS balance, li.gross AS gross,
         date_diff('day', CAST(o.o_orderdate AS DATE), DATE '{TENURE_AS_OF}') / 365.25 AS tenure,
         CAST(coalesce(li.n_lines_, 0) AS DOUBLE) AS n_lines, li.qty AS qty, li.disc AS disc, li.tax AS tax,
         CAST(coalesce(li.parts_, 0) AS DOUBLE) AS parts, CAST(coalesce(li.supps_, 0) AS DOUBLE) AS supps,
         CASE WHEN o.o_orderkey % {NULL_EVERY} = 0 THEN NULL
              WHEN o.o_orderkey % {VARIANT_MOD} = 0 THEN c.c_mktsegment || 'S'
              WHEN o.o_orderkey % {VARIANT_MOD} = 1 THEN lower(c.c_mktsegment)
              WHEN o.o_orderkey % {VARIANT_MOD} = 2 THEN substr(c.c_mktsegment, 1, 3)
              WHEN o.o_orderkey % {VARIANT_MOD} = 3 THEN 'X-' || c.c_mktsegment
              ELSE c.c_mktsegment END AS department,
         '  ' || lower(n.n_name) || chr(9) AS region,
         o.o_orderstatus AS emp_type, o.o_orderpriority AS shift
  FROM orders o
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_dept_case = "CASE department " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.canonical_map.items()) + " ELSE department END"
_std_cols = ", ".join(
    [f"{c}" for c in ["id", "hired", "target", *NUM]]
    + [f"{_dept_case} AS department"]
    + [f"{title_sql(strip_sql(c))} AS {c}" for c in R.title_columns]
)
_drop_where = " AND ".join(f"NOT {outside_sql(r)}" for r in R.drop_rules)
_clip = {r.column: f"CASE WHEN {r.column} < {r.lo!r} THEN {r.lo!r} ELSE {r.column} END" for r in R.clip_rules}
_filtered_cols = ", ".join(["id", "hired", "target"] + [f"{_clip.get(c, c)} AS {c}" for c in NUM] + CAT)
_med = ", ".join(f"median({c}) AS {c}" for c in NUM)
_modes = ", ".join(
    f"(SELECT {c} FROM f WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in CAT
)
_clean_cols = ", ".join(
    ["f.id AS id", "f.hired AS hired", "f.target AS target"]
    + [f"coalesce(f.{c}, med.{c}) AS {c}" for c in NUM]
    + [f"coalesce(f.{c}, modes.{c}) AS {c}" for c in CAT]
)

CLEAN_CTE = f"""{RAW_CTE},
std AS (SELECT {_std_cols} FROM raw),
f AS (SELECT {_filtered_cols} FROM std WHERE {_drop_where}),
med AS (SELECT {_med} FROM f),
modes AS (SELECT {_modes}),
clean AS (SELECT {_clean_cols} FROM f, med, modes)"""

_shift_case = "CASE shift " + " ".join(f"WHEN {q(v)} THEN {float(i)!r}" for i, v in enumerate(ENTITY_SHIFT_ORDER)) + " ELSE NULL END"
ENC_CTE = f"""{CLEAN_CTE},
enc AS (SELECT *, {_shift_case} AS shift_rank FROM clean)"""


def with_clean(select: str) -> str:
    return f"WITH {CLEAN_CTE}\n{select}"


def with_raw(select: str) -> str:
    return f"WITH {RAW_CTE}\n{select}"


def with_enc(select: str) -> str:
    return f"WITH {ENC_CTE}\n{select}"


def unpivot_union(cte: str, cols, value_expr) -> str:
    return " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", {value_expr(c)} AS value FROM {cte}" for c in cols)


def _suspicious() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(r.name)} AS rule, {q(r.column)} AS \"column\", {q(r.action)} AS action, "
        f"CAST(count(*) FILTER (WHERE {outside_sql(r)}) AS BIGINT) AS flagged, {q(r.decision)} AS decision FROM raw"
        for r in R.rules
    )
    return with_raw(parts)


def _suspicious_rows() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(r.name)} AS rule, id, CAST({r.column} AS DOUBLE) AS value FROM raw WHERE {outside_sql(r)}" for r in R.rules
    )
    return with_raw(parts)


def _fmt(x: float) -> str:
    return f"{x:g}"


def _dropped() -> str:
    reasons = []
    for r in R.drop_rules:
        parts = []
        if r.lo is not None:
            parts.append(f"{'<=' if r.lo_open else '<'} {_fmt(r.lo)}")
        if r.hi is not None:
            parts.append(f"> {_fmt(r.hi)}")
        reasons.append(f"CASE WHEN {outside_sql(r)} THEN {q(r.name + ' ' + ' or '.join(parts))} END")
    cols = sorted({r.column for r in R.drop_rules})
    any_out = " OR ".join(outside_sql(r) for r in R.drop_rules)
    return with_raw(f"SELECT id, {', '.join(cols)}, concat_ws('; ', {', '.join(reasons)}) AS reason FROM raw WHERE {any_out}")


def _missing() -> str:
    allc = ["id", "hired", "target", *NUM, *CAT]
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count, "
        f"round_even(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_pct FROM raw" for c in allc
    )
    return with_raw(f"SELECT *, {band_sql('missing_pct', BAND_MISSING_PCT)} AS band FROM ({parts}) WHERE missing_count > 0")


def _value_counts() -> str:
    parts = " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value FROM raw" for c in CAT)
    return with_raw(f"SELECT \"column\", value, count(*) AS n FROM ({parts}) GROUP BY \"column\", value")


def _mapping() -> str:
    m = "CASE value " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.canonical_map.items()) + " ELSE NULL END"
    return with_raw(
        f"SELECT value, n, coalesce({m}, 'UNMAPPED') AS maps_to, ({m}) IS NOT NULL AS mapped "
        f"FROM (SELECT department AS value, count(*) AS n FROM raw GROUP BY department)"
    )


def _clean() -> str:
    cols = ["id", "hired", "target"] + [f"round({c}, 6) AS {c}" for c in NUM] + CAT
    return with_clean(f"SELECT {', '.join(cols)} FROM clean")


def _shape() -> str:
    return with_clean(
        "SELECT r.raw_rows, CAST(16 AS BIGINT) AS raw_cols, c.clean_rows, CAST(16 AS BIGINT) AS clean_cols, "
        "r.raw_rows - c.clean_rows AS removed_rows FROM (SELECT count(*) AS raw_rows FROM raw) r, "
        "(SELECT count(*) AS clean_rows FROM clean) c"
    )


def _imputation() -> str:
    raw_missing = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_raw FROM raw" for c in ["id", "hired", "target", *NUM, *CAT]
    )
    clean_missing = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_clean FROM clean" for c in ["id", "hired", "target", *NUM, *CAT]
    )
    fill = " UNION ALL ".join(
        [f"SELECT {q(c)} AS \"column\", 'Median' AS strategy, round((SELECT {c} FROM med), 6) AS fill_num, NULL::VARCHAR AS fill_cat, "
         f"round((SELECT median({c}) FROM raw), 6) AS raw_num, NULL::VARCHAR AS raw_cat" for c in NUM]
        + [f"SELECT {q(c)}, 'Mode', NULL::DOUBLE, (SELECT {c} FROM modes), NULL::DOUBLE, "
           f"(SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CAT]
    )
    return with_clean(
        f"SELECT rm.\"column\", CAST(rm.missing_raw AS BIGINT) AS missing_raw, CAST(cm.missing_clean AS BIGINT) AS missing_clean, "
        f"coalesce(fl.strategy, 'Unknown') AS strategy, fl.fill_num, fl.fill_cat, fl.raw_num, fl.raw_cat "
        f"FROM ({raw_missing}) rm LEFT JOIN ({clean_missing}) cm USING (\"column\") LEFT JOIN ({fill}) fl USING (\"column\") "
        f"WHERE rm.missing_raw > 0"
    )


def _describe() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM clean" for c in NUM
    )
    return with_clean(parts)


def _skew() -> str:
    parts = " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", skewness({c}) AS skew FROM clean" for c in NUM)
    return with_clean(
        f"SELECT \"column\", round(skew, 6) AS skew, CASE WHEN skew > 0 THEN 'positive' ELSE 'negative' END AS direction, "
        f"row_number() OVER (ORDER BY abs(skew) DESC NULLS LAST, \"column\") <= 3 AS top FROM ({parts})"
    )


def _corr_pairs(cte: str) -> str:
    cols = list(ENTITY_CORR_COLUMNS)
    parts = []
    for i, a in enumerate(cols):
        for b in cols:
            if a == b:
                parts.append(f"SELECT {q(a)} AS a, {q(b)} AS b, 1.0::DOUBLE AS r")
            else:
                parts.append(f"SELECT {q(a)} AS a, {q(b)} AS b, corr({a}, {b}) AS r FROM {cte}")
    return " UNION ALL ".join(parts)


def _corr() -> str:
    return with_enc(f"SELECT a, b, round(r, 6) AS r FROM ({_corr_pairs('enc')})")


def _corr_target() -> str:
    t = R.regression_target
    return with_enc(
        f"SELECT a AS \"column\", round(r, 6) AS r, {band_sql('abs(r)', BAND_CORR_TARGET)} AS strength "
        f"FROM ({_corr_pairs('enc')}) WHERE b = {q(t)} AND a <> {q(t)}"
    )


def _intercorr() -> str:
    preds = [c for c in ENTITY_CORR_COLUMNS if c != R.regression_target]
    pos = "CASE {x} " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(preds)) + " END"
    return with_enc(
        f"SELECT a, b, round(r, 6) AS r, {band_sql('abs(r)', BAND_CORR_PAIR)} AS risk FROM ({_corr_pairs('enc')}) "
        f"WHERE a IN ({', '.join(q(c) for c in preds)}) AND b IN ({', '.join(q(c) for c in preds)}) "
        f"AND ({pos.format(x='a')}) < ({pos.format(x='b')})"
    )


def _rate_by() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(by)} AS by_column, {by} AS \"group\", count(*) AS total, "
        f"round_even(avg(target) * 100, 2) AS rate_pct, round_even((1 - avg(target)) * 100, 2) AS retained_pct "
        f"FROM clean WHERE {by} IS NOT NULL GROUP BY {by}" for by in ("department", "emp_type")
    )
    return with_clean(f"SELECT *, {band_sql('rate_pct', BAND_RATE)} AS band FROM ({parts})")


def _rate_extremes() -> str:
    return with_clean(
        "SELECT which, \"group\", rate_pct FROM ("
        "SELECT \"group\", rate_pct, row_number() OVER (ORDER BY rate_pct DESC, \"group\") AS h, "
        "row_number() OVER (ORDER BY rate_pct ASC, \"group\") AS l FROM ("
        "SELECT department AS \"group\", round_even(avg(target) * 100, 2) AS rate_pct FROM clean GROUP BY department)), "
        "(VALUES ('highest'), ('lowest')) e(which) WHERE (which = 'highest' AND h = 1) OR (which = 'lowest' AND l = 1)"
    )


def _crosstab() -> str:
    return with_clean(
        "SELECT department AS \"group\", count(*) FILTER (WHERE target = 0) AS Stayed, count(*) FILTER (WHERE target = 1) AS \"Left\", "
        "count(*) AS total, round_even(count(*) FILTER (WHERE target = 1) * 100.0 / count(*), 2) AS rate_pct "
        "FROM clean GROUP BY department"
    )


def _group_mean() -> str:
    return with_clean("SELECT department AS \"group\", round(avg(target) * 100, 6) AS mean_scaled FROM clean GROUP BY department")


def _group_counts() -> str:
    return with_clean(
        "SELECT department AS \"group\", CASE target WHEN 0 THEN 'Stayed' ELSE 'Left' END AS label, count(*) AS n "
        "FROM clean GROUP BY 1, 2"
    )


BOX_COLS = ("balance", "gross", "supps", "tenure")


def _box() -> str:
    parts = []
    for c in BOX_COLS:
        parts.append(
            f"SELECT {q(c)} AS \"column\", q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence, "
            f"(SELECT count({c}) FROM raw) AS n, "
            f"(SELECT min({c}) FROM raw WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_lo, "
            f"(SELECT max({c}) FROM raw WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi, "
            f"(SELECT count(*) FROM raw WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers "
            f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM raw)"
        )
    body = " UNION ALL ".join(parts)
    return with_raw(
        f"SELECT \"column\", n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo_fence, 6) AS lo_fence, "
        f"round(hi_fence, 6) AS hi_fence, round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, outliers FROM ({body})"
    )


def _hist() -> str:
    return (
        "WITH st AS (SELECT min(value) AS mn, max(value) AS mx FROM events), "
        "w AS (SELECT mn, mx, CASE WHEN mx > mn THEN (mx - mn) / 30 ELSE 1.0 END AS width FROM st) "
        "SELECT CAST(i AS INTEGER) AS bin, round(mn + width * i, 6) AS lo, round(mn + width * (i + 1), 6) AS hi, count(c.bin) AS n "
        "FROM w, range(30) t(i) LEFT JOIN (SELECT CAST(least(floor((value - mn) / width), 29) AS INTEGER) AS bin FROM events, w "
        "WHERE value IS NOT NULL) c ON c.bin = i GROUP BY i, mn, width"
    )


def _kde() -> str:
    return (
        "WITH st AS (SELECT min(value) AS mn, max(value) AS mx, count(value) AS n, stddev_samp(value) AS sd FROM events), "
        "p AS (SELECT mn, (mx - mn) / 199 AS step, n, sd * pow(n, -0.2) AS h FROM st), "
        "g AS (SELECT CAST(i AS INTEGER) AS point, mn + i * step AS x, n, h FROM p, range(200) t(i)) "
        "SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - e.value) / h) * ((x - e.value) / h))) / (n * h * sqrt(2 * pi())), 12) AS density "
        "FROM g, events e WHERE e.value IS NOT NULL GROUP BY point, x, n, h"
    )


def _top_skewed() -> str:
    """CTEs: top ("column"), long ("column", value) of the three most skewed columns."""
    return (with_clean("").strip() + f", sk AS ({_skew()[len(with_clean('')):]}), top AS (SELECT \"column\" FROM sk WHERE top), "
            f"long AS (SELECT \"column\", CAST(value AS DOUBLE) AS value FROM ({unpivot_union('clean', NUM, lambda c: f'CAST({c} AS DOUBLE)')}) JOIN top USING (\"column\") WHERE value IS NOT NULL) ")


def _skew_hist() -> str:
    return _top_skewed() + (
        ", w AS (SELECT \"column\", min(value) AS mn, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / 30 ELSE 1.0 END AS width FROM long GROUP BY 1), "
        "b AS (SELECT w.\"column\", CAST(least(floor((value - mn) / width), 29) AS INTEGER) AS bin, count(*) AS n FROM long JOIN w USING (\"column\") GROUP BY 1, 2) "
        "SELECT w.\"column\", CAST(i AS INTEGER) AS bin, round(mn + width * i, 6) AS lo, round(mn + width * (i + 1), 6) AS hi, coalesce(b.n, 0) AS n "
        "FROM w CROSS JOIN range(30) t(i) LEFT JOIN b ON b.\"column\" = w.\"column\" AND b.bin = i")


def _skew_kde() -> str:
    return _top_skewed() + (
        ", p AS (SELECT \"column\", min(value) AS mn, (max(value) - min(value)) / 199 AS step, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h FROM long GROUP BY 1), "
        "v AS (SELECT \"column\", value, count(*) AS c FROM long GROUP BY ALL) "
        "SELECT p.\"column\", CAST(i AS INTEGER) AS point, round(mn + i * step, 6) AS x, "
        "round(sum(c * exp(-0.5 * ((mn + i * step - value) / h) * ((mn + i * step - value) / h))) / (n * h * sqrt(2 * pi())), 12) AS density "
        "FROM p JOIN v USING (\"column\") CROSS JOIN range(200) t(i) GROUP BY p.\"column\", i, mn, step, n, h")


def _csv_source() -> str:
    return (
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 12.0::DOUBLE END ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price, "
        "CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN '5x' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status, "
        "(o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) OR o_orderkey % 100 = 3 AS malformed FROM orders")


def _set_compare() -> str:
    flag = "SELECT DISTINCT 'part' AS kind, CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_returnflag"
    return (
        f"WITH a AS (SELECT 'column' AS kind, substr(column_name, 3) AS name FROM (DESCRIBE SELECT * FROM customer) UNION {flag} = 'R'), "
        f"b AS (SELECT 'column' AS kind, substr(column_name, 3) AS name FROM (DESCRIBE SELECT * FROM supplier) UNION {flag} <> 'R') "
        "SELECT kind, name, CASE WHEN b.name IS NULL THEN 'left only' WHEN a.name IS NULL THEN 'right only' ELSE 'shared' END AS status "
        "FROM a FULL JOIN b USING (kind, name)")


def _label_encode() -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT {q(c)} AS \"column\", coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM enc" for c in CAT)
    return with_enc(f"SELECT \"column\", value, CAST(dense_rank() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS INTEGER) AS code FROM ({parts})")


def _features() -> str:
    return with_clean(
        "SELECT id, round(gross / (tenure + 1), 6) AS salary_per_tenure, round(qty / (tax + 1), 6) AS overtime_to_satisfaction, "
        "round(n_lines / (tenure + 1), 6) AS promotion_rate, round(supps / (tenure + 1), 6) AS absence_to_tenure, "
        "round(n_lines / (CASE WHEN tenure < 0.5 THEN 0.5 ELSE tenure END), 6) AS promotion_rate_floored FROM clean"
    )


def _md5(idc: str, seed: int) -> str:
    return f"md5(CAST({idc} AS VARCHAR) || '|{seed}')"


def _split() -> str:
    return with_clean(
        f"SELECT {_md5('id', 42)} < '4ccccccc' AS is_test, count(*) AS n, round(avg(target), 6) AS target_rate FROM clean GROUP BY 1"
    )


def _strat_split() -> str:
    return with_clean(
        f"SELECT is_test, target, count(*) AS n FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY {_md5('id', 42)}) "
        f"<= floor(0.3 * count(*) OVER (PARTITION BY target) + 0.5) AS is_test FROM clean) GROUP BY 1, 2"
    )


def stratified_sample_sql(table: str, idc: str, strata: str, n: int, seed: int) -> str:
    """Largest-remainder proportional allocation, then the smallest hashes per stratum."""
    return (
        f"sz AS (SELECT {strata} AS s, count(*) AS c FROM {table} GROUP BY 1), "
        f"tot AS (SELECT sum(c) AS t FROM sz), "
        f"al AS (SELECT s, c, {n} * c / t AS raw_, floor({n} * c / t) AS base FROM sz, tot), "
        f"rk AS (SELECT s, base, row_number() OVER (ORDER BY raw_ - base DESC, c DESC, CAST(s AS VARCHAR)) AS r, "
        f"{n} - sum(base) OVER () AS rest FROM al), "
        f"alloc AS (SELECT s, CAST(base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS k FROM rk), "
        f"ranked AS (SELECT t.*, row_number() OVER (PARTITION BY {strata} ORDER BY {_md5(idc, seed)}) AS rn FROM {table} t), "
        f"smp AS (SELECT ranked.* FROM ranked JOIN alloc ON ranked.{strata} IS NOT DISTINCT FROM alloc.s WHERE rn <= k)"
    )


def _sample300() -> str:
    return f"WITH {CLEAN_CTE}, {stratified_sample_sql('clean', 'id', 'target', 300, 42)} SELECT id, target FROM smp"


def _folds() -> str:
    return with_clean(
        f"SELECT CAST(('0x' || substr({_md5('id', 43)}, 1, 8))::BIGINT % 5 AS INTEGER) AS fold, count(*) AS n "
        f"FROM clean WHERE NOT ({_md5('id', 42)} < '4ccccccc') GROUP BY 1"
    )


def _zscore() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(avg(({c} - m) / s), 6) AS z_mean, round(stddev_samp(({c} - m) / s), 6) AS z_std "
        f"FROM clean, (SELECT avg({c}) AS m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s FROM clean)"
        for c in ENTITY_CLUSTER_FEATURES
    )
    return with_clean(parts)


def _confusion() -> str:
    return (
        "SELECT toxic AS actual, CAST(n_chars > 2000 AS INTEGER) AS predicted, count(*) AS n "
        "FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2"
    )


def _class_report() -> str:
    return (
        "WITH v AS (SELECT toxic AS a, CAST(n_chars > 2000 AS INTEGER) AS p FROM documents d JOIN labels l USING (doc_id)), "
        "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = p) AS correct, "
        "count(*) FILTER (WHERE a = 0 AND p = 0) AS tp0, count(*) FILTER (WHERE p = 0) AS pp0, count(*) FILTER (WHERE a = 0) AS s0, "
        "count(*) FILTER (WHERE a = 1 AND p = 1) AS tp1, count(*) FILTER (WHERE p = 1) AS pp1, count(*) FILTER (WHERE a = 1) AS s1 FROM v), "
        "per AS (SELECT 'Stayed' AS label, coalesce(tp0 / nullif(pp0, 0), 0) AS precision, coalesce(tp0 / nullif(s0, 0), 0) AS recall, s0 AS support FROM c "
        "UNION ALL SELECT 'Left', coalesce(tp1 / nullif(pp1, 0), 0), coalesce(tp1 / nullif(s1, 0), 0), s1 FROM c), "
        "per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per) "
        "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per2 "
        "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per2 "
        "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
        "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2 "
        "UNION ALL SELECT 'accuracy', round(correct / n, 6), round(correct / n, 6), round(correct / n, 6), CAST(n AS BIGINT) FROM c"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "q_shape": _shape(),
        "q_suspicious": _suspicious(),
        "q_suspicious_rows": _suspicious_rows(),
        "q_dropped": _dropped(),
        "q_missing": _missing(),
        "q_value_counts": _value_counts(),
        "q_mapping": _mapping(),
        "q_clean": _clean(),
        "q_imputation": _imputation(),
        "q_describe": _describe(),
        "q_skew": _skew(),
        "q_corr": _corr(),
        "q_corr_target": _corr_target(),
        "q_intercorr": _intercorr(),
        "q_rate_by": _rate_by(),
        "q_rate_extremes": _rate_extremes(),
        "q_crosstab": _crosstab(),
        "q_group_mean": _group_mean(),
        "q_group_counts": _group_counts(),
        "q_box": _box(),
        "q_hist": _hist(),
        "q_kde": _kde(),
        "q_skew_hist": _skew_hist(),
        "q_skew_kde": _skew_kde(),
        "q_csv_source": _csv_source(),
        "q_set_compare": _set_compare(),
        "q_label_encode": _label_encode(),
        "q_features": _features(),
        "q_split": _split(),
        "q_strat_split": _strat_split(),
        "q_sample300": _sample300(),
        "q_folds": _folds(),
        "q_zscore": _zscore(),
        "q_confusion": _confusion(),
        "q_class_report": _class_report(),
    }
