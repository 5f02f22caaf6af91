"""Standardisation and one-pass sufficient statistics.

``gram`` is the enabler of every linear model here: one ``groupBy(group)``
aggregation returns n, Σx, Σy, XᵀX, Xᵀy and yᵀy per group (fold / split), with
partial aggregation in every task, so the shuffle carries
``tasks × groups × p²`` numbers whatever the row count.  Columns are shifted
by a reference point (e.g. the medians) before summing to keep the sums well
conditioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *population* std per column (std 0 -> 1)."""
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).collect()[0]
    out = {}
    for c in cols:
        m, s = row[c]["m"], row[c]["s"]
        out[c] = (float(m or 0.0), float(s) if s else 1.0)
    return out


def zscore_apply(df: DataFrame, params: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    for c, (m, s) in params.items():
        df = df.withColumn(c + suffix, (F.col(c) - F.lit(m)) / F.lit(s))
    return df


def zscore_report(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Before/after mean and sample std (n-1) per column, one pass."""
    cols = list(params)
    aggs = []
    for c in cols:
        m, s = params[c]
        z = (F.col(c) - F.lit(m)) / F.lit(s)
        aggs.append(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                             F.avg(z).alias("z_mean"), F.stddev_samp(z).alias("z_std")).alias(c))
    return df.agg(*aggs).unpivot([], cols, "column", "s").select("column", "s.*")


@dataclass
class Gram:
    """Sufficient statistics of shifted data ``x - shift_x``, ``y - shift_y``."""

    n: float
    sx: np.ndarray
    sy: float
    sxx: np.ndarray
    sxy: np.ndarray
    syy: float
    shift_x: np.ndarray
    shift_y: float
    features: list[str]

    def __add__(self, o: Gram) -> Gram:
        return Gram(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.sxx + o.sxx, self.sxy + o.sxy, self.syy + o.syy,
                    self.shift_x, self.shift_y, self.features)

    def __sub__(self, o: Gram) -> Gram:
        return Gram(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.sxx - o.sxx, self.sxy - o.sxy, self.syy - o.syy,
                    self.shift_x, self.shift_y, self.features)

    def select(self, idx: Sequence[int]) -> Gram:
        idx = list(idx)
        return Gram(self.n, self.sx[idx], self.sy, self.sxx[np.ix_(idx, idx)], self.sxy[idx], self.syy,
                    self.shift_x[idx], self.shift_y, [self.features[i] for i in idx])

    def centered(self) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, float]:
        mx, my = self.sx / self.n, self.sy / self.n
        cxx = self.sxx - self.n * np.outer(mx, mx)
        cxy = self.sxy - self.n * mx * my
        cyy = self.syy - self.n * my * my
        return mx, my, cxx, cxy, cyy


def gram(df: DataFrame, xcols: Sequence[str], y: str, group: str | None = None,
         shift: Mapping[str, float] | None = None) -> dict[object, Gram]:
    """One aggregation → {group value: Gram}.  ``group=None`` → key ``None``.

    Rows with a NULL feature or target are left out (complete cases), so n and all sums cover the same rows.
    """
    xcols = list(xcols)
    df = df.dropna(subset=[*xcols, y])
    shift = shift or {}
    sx = [F.col(c).cast("double") - F.lit(float(shift.get(c, 0.0))) for c in xcols]
    sy = F.col(y).cast("double") - F.lit(float(shift.get(y, 0.0)))
    p = len(xcols)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(sy).alias("sy"), F.sum(sy * sy).alias("syy")]
    aggs += [F.sum(sx[i]).alias(f"x{i}") for i in range(p)]
    aggs += [F.sum(sx[i] * sy).alias(f"xy{i}") for i in range(p)]
    aggs += [F.sum(sx[i] * sx[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)]
    g = df.groupBy(F.col(group).alias("_g")) if group else df.groupBy(F.lit(None).alias("_g"))
    out = {}
    for r in g.agg(*aggs).collect():
        xx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                xx[i, j] = xx[j, i] = r[f"xx{i}_{j}"] or 0.0
        out[r["_g"]] = Gram(
            float(r["n"]), np.array([r[f"x{i}"] or 0.0 for i in range(p)]), float(r["sy"] or 0.0), xx,
            np.array([r[f"xy{i}"] or 0.0 for i in range(p)]), float(r["syy"] or 0.0),
            np.array([float(shift.get(c, 0.0)) for c in xcols]), float(shift.get(y, 0.0)), xcols,
        )
    return out


def total(grams: Mapping[object, Gram], keys: Sequence | None = None) -> Gram:
    ks = list(keys) if keys is not None else list(grams)
    acc = grams[ks[0]]
    for k in ks[1:]:
        acc = acc + grams[k]
    return acc
