from cohortlab.operators import quality
from cohortlab.roles import RangeRule, Roles

RULES = (
    RangeRule("age", "age", lo=15.0, hi=80.0, action="drop"),
    RangeRule("pay_low", "pay", lo=0.0, action="drop", lo_open=True),
    RangeRule("tenure", "tenure", lo=0.0, action="clip"),
    RangeRule("score", "score", lo=1.0, hi=5.0, action="flag"),
)
ROLES = Roles(id="id", target="t", numeric=("age", "pay", "tenure", "score"), categorical=("dept", "kind"),
              canonical_column="dept", canonical_map={"OPS": "Operations", "Ops": "Operations"},
              title_columns=("kind",), rules=RULES)


def _raw(spark):
    rows = [
        (1, 0, 30.0, 100.0, -1.0, 3.0, "OPS", " full-time "),
        (2, 1, 10.0, 100.0, 2.0, 9.0, "Ops", "PART-TIME"),   # age too low -> dropped
        (3, 0, None, 0.0, 3.0, None, "Sales", None),           # pay <= 0 -> dropped
        (4, 1, 40.0, None, None, 2.0, None, "full-time"),
        (5, 0, 50.0, 300.0, 5.0, 4.0, "Sales", "contract"),
    ]
    return spark.createDataFrame(rows, "id int, t int, age double, pay double, tenure double, score double, dept string, kind string")


def test_clean_order_and_imputation(spark):
    raw = _raw(spark)
    clean, med, modes = quality.clean(raw, ROLES)
    rows = {r["id"]: r for r in clean.collect()}
    assert set(rows) == {1, 4, 5}
    assert rows[1]["tenure"] == 0.0  # clipped before the median
    assert med["tenure"] == 2.5 and rows[4]["tenure"] == 2.5  # median of (0, 5)
    assert med["pay"] == 200.0 and rows[4]["pay"] == 200.0
    assert rows[1]["dept"] == "Operations" and rows[4]["dept"] == modes["dept"]
    assert rows[1]["kind"] == "Full-Time"


def test_flags_and_dropped_reasons(spark):
    raw = _raw(spark)
    counts = {r["rule"]: r["flagged"] for r in quality.suspicious_counts(raw, RULES).collect()}
    assert counts == {"age": 1, "pay_low": 1, "tenure": 1, "score": 1}
    dropped = {r["id"]: r["reason"] for r in quality.dropped_rows(raw, RULES, "id").collect()}
    assert dropped == {2: "age < 15 or > 80", 3: "pay_low <= 0"}
    miss = {r["column"]: r["missing_count"] for r in quality.missing_report(raw).collect()}
    assert miss == {"age": 1, "pay": 1, "tenure": 1, "score": 1, "dept": 1, "kind": 1}


def test_read_entities_csv_na_tokens_and_bad_cells(spark, tmp_path):
    from pyspark.sql import types as T

    from cohortlab.sources.tables import read_entities, shape_report

    p = tmp_path / "raw.csv"
    p.write_text("id,age,dept\n1,30,OPS\n2,NA,n/a\n3,abc,\n4,NaN,Sales\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("age", T.DoubleType()),
                           T.StructField("dept", T.StringType())])
    df = read_entities(spark, str(p), schema)
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["age"] == 30.0 and rows[2]["age"] is None and rows[3]["age"] is None and rows[4]["age"] is None
    assert rows[2]["dept"] is None and rows[3]["dept"] is None and rows[4]["dept"] == "Sales"
    shape = shape_report(df, df.where("age IS NOT NULL")).collect()[0]
    assert (shape["raw_rows"], shape["clean_rows"], shape["removed_rows"], shape["raw_cols"]) == (4, 1, 3, 3)


def test_label_dictionary_ranks_across_range_partitions(spark):
    from cohortlab.operators.encode import label_dictionary

    vals = [(f"v{i:04d}", f"w{(i * 7) % 50:03d}") for i in range(500)] + [(None, "w000")]
    df = spark.createDataFrame(vals, "a string, b string")
    d = {(r["column"], r["value"]): r["code"] for r in label_dictionary(df, ["a", "b"], partitions=7).collect()}
    a_vals = sorted({v if v is not None else "nan" for v, _ in vals})
    assert [d[("a", v)] for v in a_vals] == list(range(len(a_vals)))
    b_vals = sorted({w for _, w in vals})
    assert [d[("b", v)] for v in b_vals] == list(range(len(b_vals)))
