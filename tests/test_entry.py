import __spark_entry__ as E


def test_registry_has_oracles_for_named_queries():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 70 and len(orc) >= 35


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) >= {"id", "attrition_probability", "predicted_attrition", "gap"}
    assert len(rows) <= 10
