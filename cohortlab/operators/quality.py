"""Data-quality audit and cleaning.

Everything that inspects the raw table is one scan with conditional
aggregates (``count_if`` per column / rule), unpivoted afterwards; the
cleaning chain is lazy column expressions plus one statistics pass for the
imputation values, which come back to the driver as a handful of scalars.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import clip_lower, map_values, strip_ws, title_case
from cohortlab.operators.quantiles import exact_modes, exact_quantiles
from cohortlab.roles import RangeRule, Roles


def outside(rule: RangeRule) -> Column:
    """Not NULL and outside the rule's range (never NULL itself)."""
    c = F.col(rule.column)
    conds = []
    if rule.lo is not None:
        conds.append(c <= F.lit(rule.lo) if rule.lo_open else c < F.lit(rule.lo))
    if rule.hi is not None:
        conds.append(c > F.lit(rule.hi))
    return c.isNotNull() & reduce(or_, conds)


def drop_invalid(df: DataFrame, rules: tuple[RangeRule, ...]) -> DataFrame:
    """Remove rows outside any drop rule; NULLs are kept (null-safe negation)."""
    for r in rules:
        df = df.where(~outside(r))
    return df


def flag_suspicious(df: DataFrame, rules: tuple[RangeRule, ...], id_col: str) -> DataFrame:
    """Long table ``(rule, id, value)`` of every flagged cell, from one scan."""
    structs = [
        F.when(outside(r), F.struct(F.lit(r.name).alias("rule"), F.col(r.column).cast("double").alias("value")))
        for r in rules
    ]
    return (
        df.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("s"))
        .select(F.col("s.rule").alias("rule"), "id", F.col("s.value").alias("value"))
    )


def suspicious_counts(df: DataFrame, rules: tuple[RangeRule, ...]) -> DataFrame:
    """``(rule, column, flagged, decision)`` — every rule, zero counts included."""
    counts = df.agg(*[F.count_if(outside(r)).alias(r.name) for r in rules])
    long = counts.unpivot([], [r.name for r in rules], "rule", "flagged")
    meta = df.sparkSession.createDataFrame(
        [(r.name, r.column, r.action, r.decision) for r in rules], "rule string, column string, action string, decision string"
    )
    return long.join(meta, "rule").select("rule", "column", "action", F.col("flagged").cast("bigint").alias("flagged"), "decision")


def _fmt(x: float) -> str:
    return f"{x:g}"


def dropped_rows(df: DataFrame, rules: tuple[RangeRule, ...], id_col: str) -> DataFrame:
    """Rows any drop rule removes, with the reasons joined by ``"; "``."""
    drop = [r for r in rules if r.action == "drop"]
    reasons = []
    for r in drop:
        parts = []
        if r.lo is not None:
            parts.append(f"{'<=' if r.lo_open else '<'} {_fmt(r.lo)}")
        if r.hi is not None:
            parts.append(f"> {_fmt(r.hi)}")
        reasons.append(F.when(outside(r), F.lit(f"{r.name} {' or '.join(parts)}")))
    cols = sorted({r.column for r in drop})
    return df.where(reduce(or_, [outside(r) for r in drop])).select(
        F.col(id_col).alias("id"), *cols, F.concat_ws("; ", *reasons).alias("reason")
    )


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, missing_count, missing_pct)`` for columns with missing > 0."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot(["_n"], cols, "column", "missing_count")
    return long.where(F.col("missing_count") > 0).select(
        "column",
        F.col("missing_count").cast("bigint").alias("missing_count"),
        F.bround(F.col("missing_count") / F.col("_n") * 100, 2).alias("missing_pct"),
    )


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)`` including NULL values (unpivot + one groupBy)."""
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return cast.unpivot([], cols, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def mapping_report(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """``(value, n, maps_to, mapped)``: raw spellings, counts and canonical target."""
    vc = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    target = map_values(F.col("value"), mapping, keep_unmapped=False)
    return vc.select("value", "n", F.coalesce(target, F.lit("UNMAPPED")).alias("maps_to"), target.isNotNull().alias("mapped"))


def standardize_text(df: DataFrame, roles: Roles) -> DataFrame:
    """Canonical-name mapping (exact match, unmapped kept) then strip + title."""
    if roles.canonical_column:
        df = df.withColumn(roles.canonical_column, map_values(roles.canonical_column, roles.canonical_map))
    for c in roles.title_columns:
        df = df.withColumn(c, title_case(strip_ws(c)))
    return df


def filtered(df: DataFrame, roles: Roles) -> DataFrame:
    """Standardise, drop out-of-range rows, clip — the frame the statistics use."""
    out = drop_invalid(standardize_text(df, roles), roles.drop_rules)
    for r in roles.clip_rules:
        out = out.withColumn(r.column, clip_lower(r.column, r.lo))
    return out


def impute_values(df: DataFrame, roles: Roles) -> tuple[dict[str, float], dict[str, str]]:
    """Median per numeric column and mode per categorical column (driver scalars)."""
    med = exact_quantiles(df, list(roles.numeric), [0.5]).select("column", "value").collect()
    mode = exact_modes(df, list(roles.categorical)).select("column", "value").collect()
    return {r["column"]: r["value"] for r in med}, {r["column"]: r["value"] for r in mode}


def clean(df: DataFrame, roles: Roles) -> tuple[DataFrame, dict[str, float], dict[str, str]]:
    """map -> strip/title -> drop rules -> clip -> median / mode imputation.

    Statistics are computed on the filtered, clipped rows (order matters).
    Returns the lazy clean frame and the fill values used.
    """
    base = filtered(df, roles)
    medians, modes = impute_values(base, roles)
    return fill(base, roles, medians, modes), medians, modes


def fill(base: DataFrame, roles: Roles, medians: dict, modes: dict) -> DataFrame:
    """Replace NULLs by the per-column fill values (literals in the projection)."""
    out = base
    for c in roles.numeric:
        if medians.get(c) is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(medians[c]))))
    for c in roles.categorical:
        if modes.get(c) is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(modes[c])))
    return out


def imputation_report(raw: DataFrame, clean_df: DataFrame, roles: Roles, medians: dict, modes: dict) -> DataFrame:
    """``(column, missing_raw, missing_clean, strategy, imputed_value, raw_stat)``.

    ``imputed_value`` is the value actually filled (from filtered rows);
    ``raw_stat`` is the same statistic over the unfiltered raw column.
    """
    raw_missing = missing_report(raw).select("column", F.col("missing_count").alias("missing_raw"))
    clean_counts = clean_df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in raw.columns])
    clean_missing = clean_counts.unpivot([], raw.columns, "column", "missing_clean")
    raw_std = standardize_text(raw, roles)
    raw_med = exact_quantiles(raw_std, list(roles.numeric), [0.5]).select("column", F.col("value").cast("string").alias("raw_stat"))
    raw_mode = exact_modes(raw_std, list(roles.categorical)).select("column", F.col("value").alias("raw_stat"))
    strategy = [(c, "Median", None if medians.get(c) is None else repr(float(medians[c]))) for c in roles.numeric]
    strategy += [(c, "Mode", modes.get(c)) for c in roles.categorical]
    meta = raw.sparkSession.createDataFrame(strategy, "column string, strategy string, imputed_value string")
    return (
        raw_missing.join(clean_missing, "column", "left")
        .join(meta, "column", "left")
        .join(raw_med.unionByName(raw_mode), "column", "left")
        .select(
            "column",
            F.col("missing_raw").cast("bigint").alias("missing_raw"),
            F.col("missing_clean").cast("bigint").alias("missing_clean"),
            F.coalesce(F.col("strategy"), F.lit("Unknown")).alias("strategy"),
            "imputed_value",
            "raw_stat",
        )
    )
