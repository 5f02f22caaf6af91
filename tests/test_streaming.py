from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortlab.plans.model_queries import master
from cohortlab.plans.pipeline import pipeline
from cohortlab.session import scratch_path
from cohortlab.streaming import start_scoring


def test_stream_scores_equal_batch(spark):
    p = pipeline(spark, E.SMOKE_DIR)
    src = scratch_path(spark, "stream-src")
    p.raw.write.parquet(src)
    out = scratch_path(spark, "stream-out")
    stream = spark.readStream.schema(p.raw.schema).parquet(src)
    q = start_scoring(stream, p, out_path=out, available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = master(p).select("id", "attrition_probability", "predicted")
    assert got.count() == batch.count()
    diff = got.join(batch, "id").where(
        (got.attrition_probability != batch.attrition_probability) | (F.abs(got.predicted - batch.predicted) > 1e-6)
    )
    assert diff.count() == 0
