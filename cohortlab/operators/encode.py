"""Category encoders and engineered features.

Label codes are the rank of the string among the column's sorted distinct
values (the dictionary is itself a DataFrame, reusable on new data).  Small
dictionaries are applied as literal maps inside the projection; large ones
by a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import map_values, ratio_feature

LITERAL_DICTIONARY_LIMIT = 64  # a literal map is searched entry by entry; beyond this a join


def label_dictionary(df: DataFrame, cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``(column, value, code)``; NULL is encoded as the string ``"nan"``.

    The distinct (column, value) pairs are range-partitioned, so each
    partition holds a contiguous run of values; per-partition counts (a
    ``partitions × columns`` table on the driver) give each run's starting
    code, and values are ranked inside their own partition only.
    """
    cols = list(cols)
    spark = df.sparkSession
    vals = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols])
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = (
        vals.unpivot([], cols, "column", "value").distinct()
        .repartitionByRange(parts, "column", "value")
        .withColumn("pid", F.spark_partition_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counts = sorted((r["column"], r["pid"], r["n"]) for r in distinct.groupBy("column", "pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc, prev = [], 0, None
    for col, pid, n in counts:
        acc = 0 if col != prev else acc
        offsets.append((col, pid, acc))
        acc, prev = acc + n, col
    off = spark.createDataFrame(offsets, "column string, pid int, start bigint")
    w = Window.partitionBy("column", "pid").orderBy("value")
    out = (
        distinct.join(F.broadcast(off), ["column", "pid"])  # partitions × columns rows, collected above
        .select("column", "value", (F.col("start") + F.row_number().over(w) - 1).cast("int").alias("code"))
    )
    return out


def apply_dictionary(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by its code (unknown values -> NULL)."""
    n = dictionary.limit(LITERAL_DICTIONARY_LIMIT + 1).count()
    if n <= LITERAL_DICTIONARY_LIMIT:
        maps: dict[str, dict[str, int]] = {}
        for r in dictionary.collect():
            maps.setdefault(r["column"], {})[r["value"]] = r["code"]
        for c in cols:
            key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
            df = df.withColumn(c, map_values(key, maps.get(c, {}), keep_unmapped=False).cast("int"))
        return df
    for c in cols:
        d = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_k_{c}"))
        key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        df = df.join(d, key == F.col(f"_v_{c}"), "left").withColumn(c, F.col(f"_k_{c}")).drop(f"_v_{c}", f"_k_{c}")
    return df


def label_encode(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    d = label_dictionary(df, cols)
    return apply_dictionary(df, d, cols), d


def ordinal_encode(df: DataFrame, col: str, order: Sequence[str], out: str) -> DataFrame:
    """Rank of the value in ``order`` (0-based); unmapped -> NULL."""
    return df.withColumn(out, map_values(F.col(col), {v: i for i, v in enumerate(order)}, keep_unmapped=False).cast("double"))


def add_ratio_features(df: DataFrame, specs: Mapping[str, tuple]) -> DataFrame:
    """``specs[name] = (num, den, offset, floor)``."""
    for name, (num, den, offset, floor) in specs.items():
        df = df.withColumn(name, ratio_feature(num, den, offset=offset, floor=floor))
    return df
