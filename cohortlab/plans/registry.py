"""Registry of every query and its SQL oracle (where one exists)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.plans import model_queries, oracle, queries


def all_queries() -> dict:
    return {**queries.QUERIES, **model_queries.QUERIES}


def all_oracles() -> dict:
    return {**oracle.oracle_sql(), **model_queries.oracle_sql()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_queries.q_high_risk(spark, sf_dir)
