"""Clustering-feature cells: a whole table of points as a bounded number of weighted cells.

A cell keeps the count, mean, sum of squared deviations, least and greatest value of each coordinate.  Cells are made by splitting:
every pass cuts the cells of greatest scatter at the means of their three widest coordinates, until the budget is used
or each cell holds one distinct point.  A pass is one partial aggregation; the driver holds the cell table only, which the budget
bounds.  A row finds its cell through broadcast joins with the split tables (one row per split cell).

What is computed on cells is exact where each cell holds one distinct point (as for any table of at most ``max_cells``
rows) and has a proven error bound elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import scratch_path

CUTS = 3  # coordinates cut in one pass: up to eight children a cell
CHAIN = 5  # passes whose split tables are joined before the assignment is written
BATCH = 512


@dataclass
class Cells:
    """``rows``: the given rows that have a whole vector, with their ``cell``; ``table``: one row per cell (driver side, bounded)."""

    rows: DataFrame
    table: pd.DataFrame  # cell, first, n, mean, ss, low, high

    def frame(self) -> DataFrame:
        # plain numbers: without Arrow, Spark takes no numpy values inside arrays
        rows = [(int(r.cell), int(r.n), *(v.tolist() for v in (r.mean, r.ss, r.low, r.high))) for r in self.table.itertuples()]
        return self.rows.sparkSession.createDataFrame(
            rows, "cell int, n long, mean array<double>, ss array<double>, low array<double>, high array<double>")


def _statistics(rows: DataFrame) -> pd.DataFrame:
    """Count, mean, sum of squared deviations and range of each cell: one aggregation."""
    summary = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(array_to_vector("vec"))
    s = rows.groupBy("cell").agg(summary.alias("s"), F.min("id").alias("first"))
    pdf = s.select(
        "cell", "first", F.col("s.count").alias("n"),
        *(vector_to_array(f"s.{a}").alias(b) for a, b in (("mean", "mean"), ("variance", "ss"), ("min", "low"), ("max", "high"))),
    ).toPandas()
    for c in ("mean", "ss", "low", "high"):
        pdf[c] = [np.asarray(v, float) for v in pdf[c]]
    pdf["ss"] = [np.where(hi > lo, v * (n - 1), 0.0) for v, n, lo, hi in zip(pdf["ss"], pdf["n"], pdf["low"], pdf["high"])]
    return pdf


def _splits(table: pd.DataFrame, budget: int) -> list[tuple[int, list[int], list[float]]]:
    """(cell, coordinates, thresholds) of the cells to cut now: greatest scatter first, as far as the budget goes.

    A threshold lies in [low, high), so each cut has points on both sides.
    """
    out = []
    for r in table.assign(scatter=[v.sum() for v in table["ss"]]).sort_values(["scatter", "first"], ascending=[False, True]).itertuples():
        wide = [int(k) for k in np.argsort(-r.ss, kind="stable")[:CUTS] if r.high[k] > r.low[k]]
        while wide and 2 ** len(wide) - 1 > budget:
            wide.pop()
        if budget < 1:
            break
        if wide:
            budget -= 2 ** len(wide) - 1
            out.append((int(r.cell), wide, [float(max(r.low[k], min(r.mean[k], np.nextafter(r.high[k], -np.inf)))) for k in wide]))
    return out


def feature_cells(points: DataFrame, max_cells: int, by: Sequence[str] = ()) -> Cells:
    """Cells of ``points`` (columns id and vec, any others; no column named cell), at most ``max_cells`` and one for each
    combination of ``by`` at least; a cell lies within one combination.

    Rows whose vector is null or holds a null or NaN are left out.  Cells are numbered by their smallest id.  No rows give
    no cells; repeated points share a cell.
    """
    spark = points.sparkSession
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    rows = points.where(whole).withColumn("vec", F.col("vec").cast("array<double>"))
    rows = rows.withColumn("cell", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    table = _statistics(rows)
    passes = 0
    # half of what is left at a time: later passes cut what has the greatest scatter by then
    while splits := _splits(table, min(max_cells - len(table), max(2**CUTS - 1, (max_cells - len(table)) // 2))):
        cuts = F.broadcast(spark.createDataFrame(splits, "cell long, _at array<int>, _over array<double>"))
        side = F.zip_with("_at", "_over", lambda k, t: F.get("vec", k) > t)
        moved = F.when(F.col("_at").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", side))
        rows = rows.join(cuts, "cell", "left").withColumn("cell", moved).drop("_at", "_over")
        passes += 1
        if passes % CHAIN == 0:
            path = scratch_path(spark, "cells")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
        old = table[~table["cell"].isin([s[0] for s in splits])]
        kept = spark.createDataFrame([(int(c),) for c in old["cell"]], "cell long")
        table = pd.concat([old, _statistics(rows.join(F.broadcast(kept), "cell", "left_anti"))], ignore_index=True)
    table = table.sort_values(["first", "cell"], ignore_index=True)
    number = spark.createDataFrame([(int(c), i) for i, c in enumerate(table["cell"])], "cell long, _number int")
    rows = rows.join(F.broadcast(number), "cell").withColumn("cell", F.col("_number")).drop("_number")
    return Cells(rows, table.assign(cell=np.arange(len(table), dtype=np.int32)))


def silhouettes(cells: Cells, labels: pd.DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., silhouette, error_bound, n)``: mean euclidean silhouette of all rows for each labelling of the cells.

    ``labels``: (keys..., cell, cluster).  The mean distance m of a row x to the points of a cell (mean c, mean squared deviation r²)
    satisfies |x-c| <= m <= sqrt(|x-c|² + r²): by the triangle inequality and by Jensen.  So the means to the own and the nearest
    other cluster, and with them the silhouette, lie in an interval; its middle is reported and half its mean width is the
    error bound, 0 up to rounding where every cell holds one distinct point.  A row that is alone in its cluster counts 0, and so
    do all rows of a labelling with one cluster.
    """
    spark = cells.rows.sparkSession
    keys = list(keys)
    kinds = ", ".join([*(f"{k} string" for k in keys), ""])
    if not len(cells.table):
        return spark.createDataFrame([], f"{kinds}silhouette double, error_bound double, n long")
    table = cells.table.set_index("cell").sort_index()
    n = table["n"].to_numpy(float)
    mean = np.stack(table["mean"].to_list())
    spread = np.array([v.sum() for v in table["ss"]]) / n
    center = (n @ mean) / n.sum()
    groups = list(labels.groupby(keys, sort=True)) if keys else [((), labels)]
    member = [g.set_index("cell")["cluster"].reindex(table.index).rank(method="dense").to_numpy(int) - 1 for _, g in groups]
    shared = spark.sparkContext.broadcast((n, mean - center, spread, center, member))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, spread, center, member = shared.value
        norm = (mean * mean).sum(axis=1)
        total = np.zeros((len(member), 3))
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                x = np.stack(part["vec"].to_list()) - center
                cell = part["cell"].to_numpy(int)
                square = np.maximum((x * x).sum(axis=1)[:, None] + norm - 2 * x @ mean.T, 0)
                low = np.sqrt(square)
                high = np.sqrt(square + spread)
                for bound in (low, high):  # a cell of one distinct point is at distance 0 from its own rows
                    own = bound[np.arange(len(cell)), cell]
                    bound[np.arange(len(cell)), cell] = np.where(spread[cell] > 0, own, 0)
                for k, cluster in enumerate(member):
                    weight = np.zeros((len(n), cluster.max() + 1))
                    weight[np.arange(len(n)), cluster] = n
                    size = weight.sum(axis=0)
                    mine = cluster[cell]
                    rows = np.arange(len(mine))
                    others = size[mine] - 1
                    sums = low @ weight, high @ weight
                    a = [np.divide(s[rows, mine], others, out=np.zeros(len(mine)), where=others > 0) for s in sums]
                    for s in sums:
                        s /= size
                        s[rows, mine] = np.inf
                    b = [s.min(axis=1) for s in sums]
                    scored = (others > 0) & np.isfinite(b[0])
                    ends = []
                    for near, far in ((a[1], b[0]), (a[0], b[1])):
                        top = np.maximum(near, far)
                        ends.append(np.where(scored & (top > 0), np.divide(np.where(scored, far - near, 0), top, out=np.zeros(len(top)), where=scored & (top > 0)), 0.0))
                    total[k] += ends[0].sum(), ends[1].sum(), len(mine)
        yield pd.DataFrame({"labelling": np.arange(len(member)), "low": total[:, 0], "high": total[:, 1], "n": total[:, 2]})

    sums = cells.rows.select("vec", "cell").mapInPandas(run, "labelling int, low double, high double, n double")
    names = [(i, *(k if isinstance(k, tuple) else (k,))) for i, (k, _) in enumerate(groups)]
    named = spark.createDataFrame(names, ", ".join(["labelling int", *(f"{k} string" for k in keys)]))
    rows = F.sum("n")
    return (
        sums.groupBy("labelling")
        .agg(((F.sum("low") + F.sum("high")) / (2 * rows)).alias("silhouette"), ((F.sum("high") - F.sum("low")) / (2 * rows)).alias("error_bound"), rows.cast("long").alias("n"))
        .join(F.broadcast(named), "labelling")
        .select(*keys, "silhouette", "error_bound", "n")
    )
