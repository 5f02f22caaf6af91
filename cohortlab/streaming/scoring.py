"""Score arriving raw entity rows with the artifacts of a batch analysis.

The transformation is row-wise and identical to the batch path: the same
cleaning expressions with the *batch* fill values (medians / modes are not
recomputed per micro-batch), the same label dictionary as literal maps, the
tree model's JVM transform and the lasso benchmark as a Catalyst
expression.  It therefore works unchanged on a streaming DataFrame; the sink
and its checkpoint live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlab.functions.columns import clip_lower
from cohortlab.operators import encode, quality, tree
from cohortlab.plans.pipeline import Pipeline
from cohortlab.session import scratch_path


def score_entities(rows: DataFrame, p: Pipeline) -> DataFrame:
    """Clean, encode and score raw entity rows (batch or streaming)."""
    r = p.roles
    df = quality.drop_invalid(quality.standardize_text(rows, r), r.drop_rules)
    for rule in r.clip_rules:
        df = df.withColumn(rule.column, clip_lower(rule.column, rule.lo))
    df = quality.fill(df, r, p.medians, p.modes)
    df = encode.ordinal_encode(df, r.ordinal_column, r.ordinal_order, "shift_rank")
    df = encode.apply_dictionary(df, p.dictionary, list(r.categorical))
    lasso = p.lasso_cv[1]
    scored = tree.with_leaf(p.tree, df)
    return scored.select(
        F.col(r.id).cast("string").alias("id"), F.col(r.regression_target).alias("actual"),
        F.col("p").alias("attrition_probability"), (F.col("p") >= 0.5).cast("int").alias("predicted_attrition"),
        lasso.predict_column().alias("predicted"),
    ).withColumn("gap", F.col("actual") - F.col("predicted"))


def start_scoring(stream: DataFrame, p: Pipeline, out_path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append scored rows to Parquet; checkpoint under ``spark.checkpoint.dir``."""
    spark = stream.sparkSession
    out_path = out_path or scratch_path(spark, "scored")
    writer = (
        score_entities(stream, p).writeStream.format("parquet").outputMode("append")
        .option("path", out_path).option("checkpointLocation", scratch_path(spark, "scoring-checkpoint"))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
