"""Exact quantiles and modes by repeated narrowing, without a shuffle or a sort of all values.

Spark's ``percentile``/``median``/``mode`` aggregates keep a value->count map
per group and merge it in one task; for a global group over a
high-cardinality column that is unbounded.  Here the work is:

1. a mergeable sketch (``percentile_approx`` on a grid) of each (group, column) puts every wanted rank between two values: a pass with
   partial aggregation, nothing else is shuffled;
2. while a rank may still have more than ``SMALL_KEY`` values strictly between its bounds, a pass counts the
   rows up to the lower bound and sketches those in between; each pass leaves about three grid cells of them;
3. the last pass counts the values between the bounds, all values beyond a bound as one, and cumulative counts give the value at
   the rank exactly.

A value that many rows share becomes a bound, so it doesn't stop the narrowing.  Bounds and results are DataFrames with a row for each
(group, column, rank); the driver sees one number, the greatest group size, which sets the number of passes.

Interpolation is linear between the order statistics at ``floor`` and
``ceil`` of ``(n-1)q``, the rule used by pandas, numpy and SQL
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import scratch_path


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Unpivot ``cols`` to ``(by..., column, value)``, dropping NULL values."""
    cast = df.select(*by, *[F.col(c).cast(dtype).alias(c) for c in cols])
    return cast.unpivot(list(by), list(cols), "column", "value").where(F.col("value").isNotNull())


def value_histogram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    return long_values(df, cols, by, dtype).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL meets NULL; the left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = left.join(renamed, cond, how)
    return out if how == "left_semi" else out.drop(*(f"_right_{k}" for k in keys))


SMALL_KEY = 100_000  # values that a window partition of the last pass may sort
GRID = 1_000
ACCURACY = 10_000  # a sketch's rank error is at most its rows / ACCURACY


def _sketch(value, grid: int):
    return F.percentile_approx(value, [i / grid for i in range(grid + 1)], max(ACCURACY, 8 * grid))


def _cell(rank, rows, grid: int):
    """Grid cell of a rank; its bounds are one cell below and two above, far beyond the sketch's error."""
    return F.least(F.floor(rank / rows * grid), F.lit(grid - 1)).cast("int")


def _at(sketch, index, grid: int):
    return F.when((index >= 1) & (index <= grid - 1), F.get(sketch, index))


def _cut(df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_statistics(values: DataFrame, keys: Sequence[str], ranks, grid: int = GRID) -> DataFrame:
    """``(keys..., n, rank, value)``: the values at the 0-based ranks of each key's ``value`` column (double, not null).

    ``ranks``: the array column of wanted ranks (long), from ``n``.
    """
    keys = list(keys)
    first = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _sketch("value", grid).alias("_sketch"))
    cell = _cell(F.col("rank"), F.col("n"), grid)
    targets = _cut(first.withColumn("rank", F.explode(F.array_distinct(ranks))).select(
        *keys, "n", "rank", _at(F.col("_sketch"), cell - 1, grid).alias("_lo"), _at(F.col("_sketch"), cell + 2, grid).alias("_hi")), "ranks")
    most = targets.agg(F.max("n").alias("n")).collect()[0]["n"] or 0
    share = 3 / grid + 2 / max(ACCURACY, 8 * grid)
    between = most * share

    def met() -> DataFrame:
        """Every value with each target of its key; the targets are a few rows for each (group, column)."""
        listed = targets.groupBy(*keys).agg(F.collect_list(F.struct("rank", "_lo", "_hi")).alias("_t"))
        return join_null_safe(values, listed, keys).select(*keys, "value", F.explode("_t").alias("_t")).select(*keys, "value", "_t.*")

    while between > SMALL_KEY:
        v, lo, hi = F.col("value"), F.col("_lo"), F.col("_hi")
        inside = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
        counted = met().groupBy(*keys, "rank", "_lo", "_hi").agg(
            F.count_if(v <= lo).alias("_below"), F.count_if(inside).alias("_rows"), _sketch(F.when(inside, v), grid).alias("_sketch"))
        rest = F.col("rank") - F.col("_below")
        cell = _cell(rest, F.col("_rows"), grid)
        at_lo, at_hi = rest < 0, rest >= F.col("_rows")
        counted = counted.withColumns({
            "_low": F.when(at_lo, lo).when(at_hi, hi).otherwise(F.coalesce(_at(F.col("_sketch"), cell - 1, grid), lo)),
            "_high": F.when(at_lo, lo).when(at_hi, hi).otherwise(F.coalesce(_at(F.col("_sketch"), cell + 2, grid), hi)),
        }).select(*keys, "rank", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"))
        targets = _cut(join_null_safe(targets.drop("_lo", "_hi"), counted, [*keys, "rank"]), "ranks")
        between *= share
    clamped = F.when(F.col("value") <= F.col("_lo"), F.col("_lo")).when(F.col("value") >= F.col("_hi"), F.col("_hi")).otherwise(F.col("value"))
    counts = met().groupBy(*keys, "rank", clamped.alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(*keys, "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    picked = counts.withColumn("_end", F.sum("_c").over(up_to)).where((F.col("_end") > F.col("rank")) & (F.col("_end") - F.col("_c") <= F.col("rank")))
    return join_null_safe(targets.select(*keys, "rank", "n"), picked.select(*keys, "rank", "value"), [*keys, "rank"])


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    buckets: int = GRID,
) -> DataFrame:
    """``(by..., column, prob, value)`` — exact linear-interpolated quantiles; ``buckets`` is the sketches' grid."""
    keys = [*by, "column"]
    each = F.array(*(F.lit(float(p)) for p in probs))
    place = (F.col("n") - 1).cast("double")
    ranks = F.flatten(F.transform(each, lambda p: F.array(F.floor(place * p), F.ceil(place * p))))
    found = order_statistics(long_values(df, cols, by), keys, ranks, buckets)
    per_key = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    pos = place * F.col("prob")
    low, high = F.try_element_at("at", F.floor(pos)), F.try_element_at("at", F.ceil(pos))
    return per_key.withColumn("prob", F.explode(each)).select(*keys, "prob", (low + (high - low) * (pos - F.floor(pos))).alias("value"))


def exact_modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, value, n)`` — most frequent value; ties -> smallest value."""
    keys = [*by, "column"]
    hist = value_histogram(df, cols, by, dtype="string")
    top = hist.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), "value", "n")).alias("top"))
    return top.select(*keys, F.col("top.value").alias("value"), F.col("top.n").alias("n"))


def quantile_map(quantiles: DataFrame) -> dict[tuple[str, float], float]:
    """Collect a (column, prob) -> value dict; the input has one row per column×prob."""
    return {(r["column"], round(r["prob"], 12)): r["value"] for r in quantiles.collect()}
