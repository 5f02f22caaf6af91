"""Descriptive profile: describe, skewness, correlations, box and histogram data.

Each report is one aggregation pass (all columns / all pairs in one
``agg``), unpivoted into a long table afterwards.  Ordering is left to the
caller (results are small).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import band
from cohortlab.operators.quantiles import exact_quantiles, join_null_safe


def _wide_to_long(row_df: DataFrame, names: Sequence[str], var: str, val: str) -> DataFrame:
    return row_df.unpivot([], list(names), var, val)


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                     accuracy: int = 10_000) -> DataFrame:
    """``(by..., column, prob, value)`` from one ``percentile_approx`` pass
    (rank error ≤ n/accuracy); the cheaper path for very large columns."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value")
    q = long.groupBy(*by, "column").agg(F.percentile_approx("value", list(probs), accuracy).alias("q"))
    return q.select(*by, "column", F.posexplode("q").alias("i", "value")).select(
        *by, "column", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("prob"), "value")


def _quantiles(df, cols, probs, by=(), exact=True):
    return exact_quantiles(df, cols, probs, by=by) if exact else approx_quantiles(df, cols, probs, by=by)


def describe_numeric(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """``(column, count, mean, std, min, p25, p50, p75, max)`` — exact quartiles
    (``exact=False``: one approximate pass), n-1 std."""
    cols = list(cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max"),
            ).alias(c)
        )
    moments = _wide_to_long(df.agg(*aggs), cols, "column", "s").select("column", "s.*")
    q = _quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    quart = q.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    quart = quart.select("column", *[F.col(f"`{p}`").alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return moments.join(quart, "column", "left").select(
        "column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def skewness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, n, skew)``: bias-corrected G1 = g1·sqrt(n(n-1))/(n-2); n < 3 -> NULL.

    Spark's ``skewness`` is the population g1; the correction matches the
    sample statistic that pandas and SQL engines report.
    """
    cols = list(cols)
    aggs = [F.struct(F.count(F.col(c)).alias("n"), F.skewness(F.col(c).cast("double")).alias("g1")).alias(c) for c in cols]
    long = _wide_to_long(df.agg(*aggs), cols, "column", "s").select("column", "s.n", "s.g1")
    n = F.col("n").cast("double")
    g = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return long.select("column", F.col("n").cast("bigint").alias("n"), g.alias("skew"))


def skew_report(skew: DataFrame, top: int = 3) -> DataFrame:
    """Adds direction and a top-k-by-|skew| flag (small table)."""
    w = Window.orderBy(F.abs("skew").desc_nulls_last(), "column")
    return skew.select(
        "column", "skew",
        F.when(F.col("skew") > 0, "positive").otherwise("negative").alias("direction"),
        (F.row_number().over(w) <= top).alias("top"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(a, b, r)`` for every ordered pair; pairwise-complete rows (one pass)."""
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    names = [f"{a}\u0001{b}" for a, b in pairs]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(n) for (a, b), n in zip(pairs, names)])
    long = _wide_to_long(row, names, "pair", "r")
    ab = long.select(F.split("pair", "\u0001").alias("p"), "r").select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "r")
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diag)


def corr_with_target(corr: DataFrame, target: str, bands=None) -> DataFrame:
    out = corr.where((F.col("b") == target) & (F.col("a") != target)).select(F.col("a").alias("column"), "r")
    return out.withColumn("strength", band(F.abs("r"), bands)) if bands else out


def intercorrelations(corr: DataFrame, cols: Sequence[str], bands=None) -> DataFrame:
    """Upper triangle by list position: ``(a, b, r, risk)``."""
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    out = corr.where(order[F.col("a")] < order[F.col("b")]).select("a", "b", "r")
    return out.withColumn("risk", band(F.abs("r"), bands)) if bands else out


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Box-plot data: quartiles, 1.5·IQR fences, whiskers (extreme values inside
    the fences) and outlier counts, per column (and group)."""
    cols = list(cols)
    keys = [*by, "column"]
    q = _quantiles(df, cols, [0.25, 0.5, 0.75], by=by, exact=exact)
    quart = q.groupBy(*keys).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    quart = quart.select(*keys, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    quart = quart.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), cols, "column", "value")
    long = long.where(F.col("value").isNotNull())
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    # quart has one row per (group, column): a small table
    agg = join_null_safe(long, F.broadcast(quart), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )
    return join_null_safe(quart, agg, keys).select(
        *keys, F.col("n").cast("bigint").alias("n"), "q1", "median", "q3", "lo_fence", "hi_fence",
        "whisker_lo", "whisker_hi", F.col("outliers").cast("bigint").alias("outliers"),
    )


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``(bin, lo, hi, n)``: all equal-width bins over [min, max], empty ones too (max falls in the last bin)."""
    return histograms(df, [col], bins).drop("column")


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """``(column, bin, lo, hi, n)`` of several columns: one aggregation for the ranges, one for the counts.  Columns without values have no bins."""
    cols = list(cols)
    spark = df.sparkSession
    st = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("mn"), F.max(F.col(c).cast("double")).alias("mx")).alias(c) for c in cols]).collect()[0]
    ranges = [(c, st[c]["mn"], (st[c]["mx"] - st[c]["mn"]) / bins if st[c]["mx"] > st[c]["mn"] else 1.0) for c in cols if st[c]["mn"] is not None]
    every = F.broadcast(spark.createDataFrame(ranges, "column string, mn double, width double"))  # one row a column
    x = {c: F.col(c).cast("double") for c in cols}
    at = {c: F.when(x[c].isNotNull(), F.least(F.floor((x[c] - F.lit(mn)) / F.lit(width)), F.lit(bins - 1))).cast("int") for c, mn, width in ranges}
    placed = df.select(*[at.get(c, F.lit(None).cast("int")).alias(c) for c in cols])  # a value's bin is known where it is read: no join
    counted = placed.unpivot([], cols, "column", "bin").where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin", (F.col("mn") + F.col("width") * F.col("bin")).alias("lo"), (F.col("mn") + F.col("width") * (F.col("bin") + 1)).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


KDE_CELLS = 1 << 20


def kde(df: DataFrame, col: str, grid_points: int = 200, bins: int | None = None) -> DataFrame:
    """``(point, x, density)`` of one column; see :func:`kdes`."""
    return kdes(df, [col], grid_points, bins).drop("column")


def kdes(df: DataFrame, cols: Sequence[str], grid_points: int = 200, bins: int | None = None) -> DataFrame:
    """``(column, point, x, density)``: Gaussian KDE on an even grid over [min, max], Scott's bandwidth ``sd·n^(-1/5)``.

    Exact by default: each task sums the kernels of its own values at every grid point (blocks of values × grid in numpy) and gives
    ``columns × grid`` partial sums, whatever its number of rows.  With ``bins`` the values are first reduced to that many equal-width bins
    (count and mean per bin, one aggregation) and the bins are evaluated instead — error ≤ half a bin width in each kernel.
    Columns without spread have no density.
    """
    cols = list(cols)
    spark = df.sparkSession
    x = {c: F.col(c).cast("double") for c in cols}
    st = df.agg(*[F.struct(F.min(x[c]).alias("mn"), F.max(x[c]).alias("mx"), F.count(x[c]).alias("n"), F.stddev_samp(x[c]).alias("sd")).alias(c) for c in cols]).collect()[0]
    shape = {c: (st[c]["mn"], (st[c]["mx"] - st[c]["mn"]) / max(grid_points - 1, 1), st[c]["n"], st[c]["sd"] * st[c]["n"] ** -0.2) for c in cols if st[c]["sd"]}
    meta = F.broadcast(spark.createDataFrame([(c, *v) for c, v in shape.items()], "column string, mn double, step double, n long, h double"))
    long = df.select(*[x[c].alias(c) for c in cols]).unpivot([], cols, "column", "v").where(F.col("v").isNotNull()).withColumn("w", F.lit(1.0))
    if bins:
        cell = F.least(F.floor((F.col("v") - F.col("mn")) / (F.col("step") * (grid_points - 1) / bins)), F.lit(bins - 1))
        long = long.join(meta, "column").groupBy("column", cell.alias("cell")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {c: np.zeros(grid_points) for c in shape}
        block = max(1, KDE_CELLS // grid_points)
        for pdf in batches:
            for c, part in pdf.groupby("column"):
                if c not in total:
                    continue
                mn, step, _, h = shape[c]
                grid = mn + np.arange(grid_points) * step
                v, w = part["v"].to_numpy(), part["w"].to_numpy()
                for k in range(0, len(v), block):
                    z = (grid - v[k : k + block, None]) / h
                    total[c] += w[k : k + block] @ np.exp(-0.5 * z * z)
        for c, t in total.items():
            yield pd.DataFrame({"column": c, "point": np.arange(grid_points), "s": t})

    partial = long.select("column", "v", "w").mapInPandas(sums, "column string, point int, s double")
    norm = F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5
    return partial.groupBy("column", "point").agg(F.sum("s").alias("s")).join(meta, "column").select(
        "column", "point", (F.col("mn") + F.col("point") * F.col("step")).alias("x"), (F.col("s") / norm).alias("density"))
