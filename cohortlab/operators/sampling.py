"""Deterministic splits, folds and samples keyed on a hash of the id.

Nothing here uses ``rand``/``randomSplit``: membership is a pure function of
``md5("<id>|<seed>")``, so it is identical under any partitioning, after an
executor is lost and recomputed, and in any SQL engine.

Exact per-stratum sizes need the k-th smallest hash of each stratum: rows are counted by the first 16 bits of
their hash (at most 65,536 map-side counters a stratum, rows aren't shuffled), and only within the cell that holds the rank by the
next bits, until few rows are left.  The split is then a plain filter ``hash <= threshold``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import hash_key, in_test_split
from cohortlab.operators.quantiles import _cut, join_null_safe

HASH_BITS = 60
RADIX_BITS = 16


def hash_long(id_col: str | Column, seed: int) -> Column:
    """First 60 bits of the md5 as a non-negative long (order = md5 order)."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 15), 16, 10).cast("bigint")


def hash_split(df: DataFrame, id_col: str, fraction: float, seed: int, flag: str = "is_test") -> DataFrame:
    """Adds ``flag``: about ``fraction`` of ids are test rows (no shuffle)."""
    return df.withColumn(flag, in_test_split(id_col, fraction, seed))


def _stratum_thresholds(df: DataFrame, id_col: str, strata: str, seed: int, size_for) -> dict:
    """Per stratum, the hash value of its ``size_for(stratum, n)``-th smallest row (None for no rows).

    The driver sees one row for each stratum and step.
    """
    spark = df.sparkSession
    rows = df.select(F.col(strata).alias("stratum"), hash_long(id_col, seed).alias("h"))
    kind = f"stratum {rows.schema['stratum'].dataType.simpleString()}"
    shift = HASH_BITS - RADIX_BITS
    up_to = Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)

    def counters(of: DataFrame) -> DataFrame:
        """(stratum, cell, c, end): rows by hash prefix and their cumulative count; at most 2^RADIX_BITS cells a stratum."""
        return of.groupBy("stratum", F.shiftright("h", shift).alias("cell")).agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.sum("c").over(up_to))

    first = _cut(counters(rows), "hash-cells")
    totals = {r["stratum"]: r["n"] for r in first.groupBy("stratum").agg(F.sum("c").alias("n")).collect()}
    wanted = [(k, size_for(k, n) - 1) for k, n in totals.items()]
    out = {k: None for k, rank in wanted if rank < 0}
    todo = [(k, rank, 0) for k, rank in wanted if rank >= 0]  # rank among the rows of the prefix found so far
    cells = first
    while todo:
        ranks = F.broadcast(spark.createDataFrame(todo, f"{kind}, rank long, prefix long"))
        hit = join_null_safe(cells, ranks, ["stratum"]).where((F.col("end") > F.col("rank")) & (F.col("end") - F.col("c") <= F.col("rank")))
        found = hit.select("stratum", "cell", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), "c").collect()
        if shift == 0:
            return out | {r["stratum"]: r["cell"] for r in found}
        todo = [(r["stratum"], r["rank"], r["cell"]) for r in found]
        narrowed = F.broadcast(spark.createDataFrame([(k, c) for k, _, c in todo], f"{kind}, prefix long"))
        within = join_null_safe(rows, narrowed, ["stratum"]).where(F.shiftright("h", shift) == F.col("prefix"))
        few = max(r["c"] for r in found) <= 1 << RADIX_BITS  # then the cell's own hashes are no more counters than a step's
        shift = 0 if few else max(0, shift - RADIX_BITS)
        cells = counters(within)
    return out


def _below(df: DataFrame, id_col: str, strata: str, seed: int, thresholds: dict, flag: str) -> DataFrame:
    h = hash_long(id_col, seed)
    cond = None
    for s, t in thresholds.items():
        c = (F.col(strata).eqNullSafe(F.lit(s))) & (h <= F.lit(t) if t is not None else F.lit(False))
        cond = c if cond is None else cond | c
    return df.withColumn(flag, F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(False))


def stratified_split(df: DataFrame, id_col: str, strata: str, fraction: float, seed: int,
                     exact: bool = True, flag: str = "is_test") -> DataFrame:
    """Test rows = the round(fraction·n_s) smallest hashes of each stratum.

    ``exact=False`` falls back to :func:`hash_split` (stratified in expectation).
    """
    if not exact:
        return hash_split(df, id_col, fraction, seed, flag)
    th = _stratum_thresholds(df, id_col, strata, seed, lambda _s, n: int(math.floor(fraction * n + 0.5)))
    return _below(df, id_col, strata, seed, th, flag)


def allocate(sizes: dict, n: int) -> dict:
    """Proportional allocation of ``n`` over strata by largest remainder
    (ties -> larger stratum, then key order)."""
    total = sum(sizes.values())
    if total == 0:
        return {k: 0 for k in sizes}
    n = min(n, total)
    raw = {k: n * v / total for k, v in sizes.items()}
    alloc = {k: int(math.floor(x)) for k, x in raw.items()}
    rest = n - sum(alloc.values())
    order = sorted(sizes, key=lambda k: (-(raw[k] - alloc[k]), -sizes[k], str(k)))
    for k in order[:rest]:
        alloc[k] += 1
    return alloc


def stratified_sample(df: DataFrame, id_col: str, strata: str, n: int, seed: int, flag: str = "in_sample") -> DataFrame:
    """Fixed-size sample with proportional allocation (the sample size is the
    operator's parameter; the table itself may be any size)."""
    sizes = {r["s"]: r["c"] for r in df.groupBy(F.col(strata).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}
    alloc = allocate(sizes, n)
    th = _stratum_thresholds(df, id_col, strata, seed, lambda s, _n: alloc.get(s, 0))
    return _below(df, id_col, strata, seed, th, flag)


def assign_folds(df: DataFrame, id_col: str, k: int, seed: int, col: str = "fold") -> DataFrame:
    """Fold in ``0..k-1`` from an independent hash of the id."""
    return df.withColumn(col, (F.conv(F.substring(hash_key(id_col, seed + 1), 1, 8), 16, 10).cast("bigint") % k).cast("int"))
