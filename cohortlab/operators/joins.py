"""Join helpers: size-checked broadcast, id-set membership, lookups.

A side is broadcast only after its row count was checked against a bound;
beyond the bound the plain join is returned and the planner picks a
shuffle join (AQE may still convert it at runtime from real sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def left_lookup(df: DataFrame, other: DataFrame, on: str, dedupe_right: bool = False) -> DataFrame:
    """Left outer equi-join on ``on`` (string-cast both sides).

    Without ``dedupe_right`` duplicate keys on the right fan out, as a plain
    merge does.
    """
    right = other.withColumn(on, F.col(on).cast("string"))
    if dedupe_right:
        right = right.dropDuplicates([on])
    return df.withColumn(on, F.col(on).cast("string")).join(right, on, "left")


def compare_sets(left: DataFrame, right: DataFrame, shared: str = "shared", only_left: str = "dropped", only_right: str = "new") -> DataFrame:
    """The distinct rows of both sides with a ``status``: set operators, so NULL equals NULL and neither side is collected."""
    parts = ((left.intersect(right), shared), (left.subtract(right), only_left), (right.subtract(left), only_right))
    out = None
    for rows, status in parts:
        rows = rows.withColumn("status", F.lit(status))
        out = rows if out is None else out.unionByName(rows)
    return out


def in_set(df: DataFrame, ids: DataFrame, on: str, max_rows: int = 1_000_000) -> DataFrame:
    """Rows whose ``on`` is in the one-column id set (left-semi join)."""
    ids = ids.select(F.col(on).cast("string").alias(on)).distinct()
    return df.withColumn(on, F.col(on).cast("string")).join(bounded_broadcast(ids, max_rows), on, "left_semi")


def not_in_set(df: DataFrame, ids: DataFrame, on: str, max_rows: int = 1_000_000) -> DataFrame:
    ids = ids.select(F.col(on).cast("string").alias(on)).distinct()
    return df.withColumn(on, F.col(on).cast("string")).join(bounded_broadcast(ids, max_rows), on, "left_anti")


def mark_membership(df: DataFrame, ids: DataFrame, on: str, flag: str = "in_set", max_rows: int = 1_000_000) -> DataFrame:
    """Add a boolean ``flag`` column: is the row's id in the set (left join + marker)."""
    ids = ids.select(F.col(on).cast("string").alias(on)).distinct().withColumn(flag, F.lit(True))
    out = df.withColumn(on, F.col(on).cast("string")).join(bounded_broadcast(ids, max_rows), on, "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
