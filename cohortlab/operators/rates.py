"""Group rates, crosstabs and classification / regression metrics.

All are single ``groupBy`` aggregations (partial aggregation before the
shuffle) producing small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_by(df: DataFrame, by: str, target: str) -> DataFrame:
    """``(group, total, rate_pct, retained_pct)``; NULL keys / targets excluded."""
    valid = df.where(F.col(by).isNotNull() & F.col(target).isNotNull())
    g = valid.groupBy(F.col(by).alias("group")).agg(
        F.count(F.lit(1)).alias("total"), F.avg(F.col(target).cast("double")).alias("r")
    )
    return g.select(
        "group",
        F.col("total").cast("bigint").alias("total"),
        F.bround(F.col("r") * 100, 2).alias("rate_pct"),
        F.bround((1 - F.col("r")) * 100, 2).alias("retained_pct"),
    )


def extremes(rates: DataFrame, value: str, label: str) -> DataFrame:
    """A "highest" and a "lowest" row; ties -> smallest label.  One group gives both rows; NULL values are left out."""
    row = F.struct(F.col(label).alias("l"), F.col(value).alias("v"))
    ends = rates.where(F.col(value).isNotNull()).agg(
        F.min_by(row, F.struct(-F.col(value), F.col(label))).alias("hi"), F.min_by(row, F.struct(F.col(value), F.col(label))).alias("lo")
    )
    which = F.explode(F.array(F.struct(F.lit("highest").alias("which"), F.col("hi").alias("r")), F.struct(F.lit("lowest").alias("which"), F.col("lo").alias("r"))))
    out = ends.where(F.col("hi").isNotNull()).select(which.alias("x"))
    return out.select("x.which", F.col("x.r.l").alias(label), F.col("x.r.v").alias(value))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, labels: Sequence[str] | None = None) -> DataFrame:
    """Count crosstab with explicit pivot values, totals and the rate of the last value."""
    labels = list(labels or [str(v) for v in values])
    g = df.groupBy(F.col(row).alias("group")).pivot(col, list(values)).agg(F.count(F.lit(1)))
    g = g.fillna(0)
    renamed = g.select("group", *[F.col(f"`{v}`").cast("bigint").alias(lab) for v, lab in zip(values, labels)])
    total = sum((F.col(lab) for lab in labels), F.lit(0)).cast("bigint")
    return renamed.withColumn("total", total).withColumn(
        "rate_pct", F.bround(F.try_divide(F.col(labels[-1]) * 100.0, F.col("total")), 2)
    )


def group_mean(df: DataFrame, by: str, value: str, scale: float = 100.0) -> DataFrame:
    return df.groupBy(F.col(by).alias("group")).agg((F.avg(F.col(value).cast("double")) * scale).alias("mean_scaled"))


def group_counts(df: DataFrame, by: str, label: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("group"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1),
                          names: Sequence[str] | None = None) -> DataFrame:
    """Precision / recall / F1 / support per class, macro and weighted averages,
    and accuracy — one aggregation; zero denominators give 0."""
    names = list(names or [str(c) for c in classes])
    a, p = F.col(actual), F.col(predicted)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(a == p).alias("correct")]
    for c in classes:
        aggs += [
            F.count_if((a == c) & (p == c)).alias(f"tp{c}"),
            F.count_if(p == c).alias(f"pp{c}"),
            F.count_if(a == c).alias(f"s{c}"),
        ]
    one = df.agg(*aggs)

    def _div(x, y):
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))

    rows = []
    for c, nm in zip(classes, names):
        prec = _div(F.col(f"tp{c}"), F.col(f"pp{c}"))
        rec = _div(F.col(f"tp{c}"), F.col(f"s{c}"))
        f1 = _div(2 * prec * rec, prec + rec)
        rows.append(F.struct(F.lit(nm).alias("label"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                             F.col(f"s{c}").cast("bigint").alias("support")))
    per = one.select(F.explode(F.array(*rows)).alias("r"), "n", "correct").select("r.*", "n", "correct")
    macro = per.groupBy().agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"),
    )
    weighted = per.groupBy().agg(
        F.lit("weighted avg").alias("label"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
        F.sum("support").cast("bigint").alias("support"),
    )
    acc = per.groupBy().agg(
        F.lit("accuracy").alias("label"),
        (F.first("correct") / F.first("n")).alias("precision"),
        (F.first("correct") / F.first("n")).alias("recall"),
        (F.first("correct") / F.first("n")).alias("f1"),
        F.first("n").cast("bigint").alias("support"),
    )
    return per.drop("n", "correct").unionByName(macro).unionByName(weighted).unionByName(acc)


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, r2, rmse, mae)``; R² uses the group's own mean of y."""
    e = F.col(y) - F.col(pred)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(F.col(y)) * F.count(F.lit(1))).alias("sst"),
    )
    return g.select(
        *by, F.col("n").cast("bigint").alias("n"),
        (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        "mae",
    )
