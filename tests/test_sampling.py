import math

from pyspark.sql import functions as F

from cohortlab.operators import sampling


def test_stratified_split_exact_sizes(spark):
    df = spark.range(5000).withColumn("s", (F.col("id") % 7 == 0).cast("int"))
    out = sampling.stratified_split(df, "id", "s", 0.3, 42)
    got = {(r["s"], r["is_test"]): r["n"] for r in out.groupBy("s", "is_test").count().withColumnRenamed("count", "n").collect()}
    sizes = {r["s"]: r["n"] for r in df.groupBy("s").count().withColumnRenamed("count", "n").collect()}
    for s, n in sizes.items():
        assert got[(s, True)] == math.floor(0.3 * n + 0.5)
    again = sampling.stratified_split(df.repartition(11), "id", "s", 0.3, 42).where("is_test").select("id")
    assert out.where("is_test").select("id").exceptAll(again).count() == 0


def test_stratified_sample_allocation(spark):
    df = spark.range(3001).withColumn("s", (F.col("id") % 3).cast("int"))
    out = sampling.stratified_sample(df, "id", "s", 300, 42).where("in_sample")
    assert out.count() == 300
    assert sampling.allocate({"a": 2, "b": 1}, 2) == {"a": 1, "b": 1}


def test_folds_cover_rows(spark):
    df = sampling.assign_folds(spark.range(1000), "id", 5, 42)
    n = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert sorted(n) == [0, 1, 2, 3, 4] and sum(n.values()) == 1000


def test_thresholds_are_the_order_statistics_of_the_hash(spark):
    df = spark.range(4000).withColumn("s", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3)).unionByName(
        spark.range(1).crossJoin(spark.range(700).select(F.lit(7).cast("bigint").alias("s"))))  # one id many times: equal hashes
    hashes = {}
    for r in df.select("s", sampling.hash_long("id", 42).alias("h")).collect():
        hashes.setdefault(r["s"], []).append(r["h"])
    for size in (lambda s, n: 1, lambda s, n: n // 2, lambda s, n: n, lambda s, n: 0 if s is None else 3):
        got = sampling._stratum_thresholds(df, "id", "s", 42, size)
        assert got == {s: sorted(h)[size(s, len(h)) - 1] if size(s, len(h)) else None for s, h in hashes.items()}
    assert sampling._stratum_thresholds(df.limit(0), "id", "s", 42, lambda s, n: 1) == {}


def test_no_row_is_shuffled_by_its_hash(spark):
    df = spark.range(3000).withColumn("s", F.col("id") % 2)
    plan = sampling.stratified_split(df, "id", "s", 0.3, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
