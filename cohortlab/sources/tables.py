"""Table scans.

Parquet is read with Spark's own reader (column pruning and filter pushdown
happen in the scan).  CSV is read with an explicit schema of strings and then
cast with ``try_cast`` so malformed cells become NULL instead of failing the
job; a list of NA tokens is mapped to NULL first (the CSV reader's
``nullValue`` accepts a single token only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES — the default NA tokens of the pandas CSV reader.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_entities(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    na_tokens: tuple[str, ...] = DEFAULT_NA_TOKENS,
    header: bool = True,
    corrupt: str | None = None,
) -> DataFrame:
    """Read an entity table with a declared schema (never inferred).

    A cell that can't be cast is NULL.  ``corrupt`` names a boolean column: the line has more or fewer fields than the schema; it
    is read as far as it goes.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raw_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    if corrupt:
        raw_schema = raw_schema.add("_corrupt_line", T.StringType())
    raw = spark.read.schema(raw_schema).options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_line").csv(path)
    tokens = list(na_tokens)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        c = F.when(c.isin(tokens), F.lit(None)).otherwise(c)
        if not isinstance(f.dataType, T.StringType):
            c = F.try_cast(c, f.dataType.simpleString()) if hasattr(F, "try_cast") else c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    if corrupt:
        cols.append(F.col("_corrupt_line").isNotNull().alias(corrupt))
    out = raw.select(*cols)
    # NaN is not NULL in Spark: normalise floating NaN to NULL at the source.
    for f in schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)))
    return out


def shape_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows and columns before / after cleaning, and rows removed (one row)."""
    marks = raw.select(F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        clean.select(F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    )
    return (
        marks.agg(F.sum("_r").alias("raw_rows"), F.sum("_c").alias("clean_rows"))
        .select(
            "raw_rows",
            F.lit(len(raw.columns)).cast("bigint").alias("raw_cols"),
            "clean_rows",
            F.lit(len(clean.columns)).cast("bigint").alias("clean_cols"),
            (F.col("raw_rows") - F.col("clean_rows")).alias("removed_rows"),
        )
    )
