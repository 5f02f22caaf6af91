"""Scalar Column expressions.

All of these compile to Catalyst expressions and stay inside whole-stage
codegen.  Semantics follow the analysis scripts, not Spark's defaults where
the two differ (see the notes on each function).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: str | Column) -> Column:
    """Strip *all* leading/trailing whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def title_case(col: str | Column) -> Column:
    """Python ``str.title``: a letter is upper-cased when it follows a non-letter.

    ``initcap`` only starts words after whitespace (``full-time`` ->
    ``Full-time``); here the string is split after every non-letter and each
    piece is ``initcap``-ed, so ``full-time`` -> ``Full-Time``, ``2ND`` -> ``2Nd``.
    """
    pieces = F.split(F.lower(_c(col)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda x: F.initcap(x)), "")


def clip_lower(col: str | Column, lo: float) -> Column:
    """Raise values below ``lo`` to ``lo``; NULL stays NULL (``greatest`` would not)."""
    c = _c(col)
    return F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)


def band(col: str | Column, bands: Iterable[tuple[float | None, str]], inclusive: bool = False) -> Column:
    """Label by the first lower bound the value exceeds (``>=`` when inclusive).

    ``bands`` is ``((bound, label), ..., (None, default))``.  NULL has no band.
    """
    c = _c(col)
    expr = None
    default = None
    for bound, label in bands:
        if bound is None:
            default = label
            continue
        cond = c >= F.lit(bound) if inclusive else c > F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.when(c.isNotNull(), F.lit(default))
    return F.when(c.isNotNull(), expr.otherwise(F.lit(default)))


def below_band(col: str | Column, bands: Iterable[tuple[float, str]], default: str) -> Column:
    """Label by the first upper bound the value is below; NULL has no label."""
    c = _c(col)
    expr = None
    for bound, label in bands:
        cond = c < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(c.isNotNull(), expr.otherwise(F.lit(default)))


def ratio_feature(num: str | Column, den: str | Column, offset: float = 0.0, floor: float | None = None) -> Column:
    """``num / (den + offset)``, or ``num / max(den, floor)`` (NULL-preserving).

    Division by zero yields NULL (``try_divide``) instead of failing under ANSI.
    """
    d = _c(den)
    if floor is not None:
        d = clip_lower(d, floor)
    if offset:
        d = d + F.lit(offset)
    return F.try_divide(_c(num), d)


def map_values(col: str | Column, mapping: Mapping[str, object], keep_unmapped: bool = True) -> Column:
    """Dictionary lookup as a literal map (broadcast with the plan, no join).

    ``keep_unmapped`` keeps the original value when the key is absent
    (``Series.map(d).fillna(original)``); otherwise unmapped -> NULL.
    """
    if not mapping:
        return _c(col) if keep_unmapped else F.lit(None)
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    looked = m[_c(col)]
    return F.coalesce(looked, _c(col)) if keep_unmapped else looked


def hash_key(id_col: str | Column, seed: int) -> Column:
    """Hex md5 of ``"<id>|<seed>"``: uniform, stable under repartitioning."""
    return F.md5(F.concat(_c(id_col).cast("string"), F.lit(f"|{seed}")))


def hash_prefix(fraction: float) -> str:
    """The 8-hex-digit prefix below which a fraction of md5 values fall."""
    return format(int(fraction * 0x100000000), "08x")


def in_test_split(id_col: str | Column, fraction: float, seed: int) -> Column:
    """True for the ~``fraction`` of ids whose md5 falls below the prefix."""
    return hash_key(id_col, seed) < F.lit(hash_prefix(fraction))
