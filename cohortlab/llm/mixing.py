"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted into cells (source, language, topic) with their tokens.  Raking
scales the cells' weights to the target share of each margin in turn until all margins agree.
A cell's factor (raked over present tokens) gives its documents' inclusion probability
min(1, scale * factor); the scale is set so that the expected tokens are a share of the corpus.
Everything is DataFrame work: one scan, grouped sums with partial aggregation (a source with a third of the
rows is a few partial sums), and a join of documents to their cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import column, fresh_name, materialize, maybe_broadcast

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    #: Share of the corpus' tokens that the sample is expected to hold.
    budget: float = 0.5
    #: Targets are present shares to this power, normalized: 1 keeps the mix, 0 levels it.
    source_power: float = 0.5
    lang_power: float = 0.7
    topic_power: float = 0.7
    sweeps: int = 60
    #: Raking stops when a sweep changes no cell's weight by more than this share.
    tolerance: float = 1e-5
    seed: int = 17

    def power(self, margin: str) -> float:
        return getattr(self, f"{margin}_power")


def topic_of(text: Column) -> Column:
    """A text's topic by rules over the whole text, first match first; null and blank texts are "empty"."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(F.contains(t, F.lit("icense")) | F.contains(t, F.lit("ights reserved")), "legal")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.contains(t, F.lit(" | ")), "listing")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words of a whole text (runs without space, tab and line breaks)."""
    t = F.coalesce(text, F.lit(""))
    # white space is one byte each; words start where white space (or the start) is followed by something else
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens and documents of each cell of a table with source, lang, topic, tokens."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _margin(cells: DataFrame, m: str, value: str) -> DataFrame:
    return cells.groupBy(F.col(m).alias("level")).agg(F.sum(value).alias("total"))


def default_targets(cells: DataFrame, params: MixParams) -> dict[str, DataFrame]:
    """Target shares of each margin: level, share (tempered present shares)."""
    out = {}
    for m in MARGINS:
        raised = _margin(cells, m, "tokens").where("total > 0").withColumn("share", F.pow("total", F.lit(params.power(m))))
        total = raised.agg(F.sum("share")).first()[0] or 1.0
        out[m] = raised.select("level", (F.col("share") / F.lit(total)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], params: MixParams = MixParams()) -> DataFrame:
    """``cells`` with ``weight``: their share of the mix after proportional fitting.

    ``targets[m]`` has (level, share).  Levels are matched null-safely.  A level that no cell has can't be
    reached, and levels without a target get no weight; the shares of the levels present are
    scaled to one.  Cells without tokens have the weight 0.  Raking stops at the tolerance, or
    after ``sweeps`` rounds (targets that contradict each other have no exact solution).
    """
    now = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    aims = {}
    for m in MARGINS:
        present = _margin(now, m, "weight").where("total > 0")
        aim = targets[m].withColumnRenamed("level", "aim").join(present, F.col("aim").eqNullSafe(F.col("level"))).select("aim", "share")
        total = aim.agg(F.sum("share")).first()[0] or 1.0
        aims[m] = materialize(aim.select("aim", (F.col("share") / F.lit(total)).alias("share")), "targets")
    sizes = {m: a.count() for m, a in aims.items()}
    for _ in range(params.sweeps):
        new = now.withColumn("before", F.col("weight"))
        for m in MARGINS:  # the cells are few: a sweep is one job over them
            factor = _margin(new, m, "weight").join(aims[m], F.col("level").eqNullSafe(F.col("aim")), "left")
            factor = factor.select("level", F.when(F.col("total") > 0, F.coalesce("share", F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("factor"))
            new = new.join(maybe_broadcast(factor, sizes[m]), F.col(m).eqNullSafe(F.col("level")))
            new = new.withColumn("weight", F.col("weight") * F.col("factor")).drop("level", "factor")
        new = materialize(new, "cells")
        moved = new.agg(F.max(F.when(F.col("before") > 0, F.abs(F.col("weight") / F.col("before") - 1)))).first()[0] or 0.0
        now = new.drop("before")
        if moved <= params.tolerance:
            break
    return now


def sampling_rates(cells: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Raked ``cells`` with ``rate``: the inclusion probability of a cell's documents.

    rate = min(1, scale * weight / tokens), with the scale at which the expected tokens are
    the budget.  The scale is found by evaluating 64 scales in one aggregate, four times
    (each time inside the step found before).  Cells without weight have the rate 0.
    """
    cells = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    head = cells.agg(
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(F.col("factor") > 0, F.col("tokens")).otherwise(0)).alias("reachable"),
        F.min(F.when(F.col("factor") > 0, F.col("factor"))).alias("least"),
    ).first()
    if not head["reachable"]:
        return cells.withColumn("rate", F.lit(0.0)).drop("factor")
    wanted = min(params.budget * head["tokens"], float(head["reachable"]))
    low, high = 0.0, 1.0 / head["least"]  # at the high end every reachable cell is taken whole
    for _ in range(4):
        grid = [low + (high - low) * i / 63 for i in range(64)]
        got = cells.agg(*(F.sum(F.least(F.lit(1.0), F.lit(s) * F.col("factor")) * F.col("tokens")).alias(f"s{i}") for i, s in enumerate(grid))).first()
        k = next((i for i in range(64) if got[i] >= wanted), 63)
        low, high = grid[max(0, k - 1)], grid[k]
    return cells.withColumn("rate", F.least(F.lit(1.0), F.lit(high) * F.col("factor"))).drop("factor")


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from the id: the same under any partitioning and after a retry."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, params: MixParams = MixParams(), targets: dict[str, DataFrame] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with topic, tokens, weight, rate, sampled.

    ``weight`` is the document's share of the target mix, ``rate`` its inclusion probability, ``sampled`` the draw
    from its id (repeated ids agree; null ids share one draw).  Null sources and languages
    are levels of their own; documents without words have the weight and rate 0.  Existing columns
    with these names stay, the new ones then get an underscore.  An empty table gives an empty result.
    """
    names = {c: fresh_name(docs, c) for c in ("topic", "tokens", "weight", "rate", "sampled")}
    source, lang, topic = (F.col(names["topic"]) if m == "topic" else column(m).cast("string") for m in MARGINS)
    text = column("text")
    wide = docs.withColumn(names["topic"], topic_of(text)).withColumn(names["tokens"], token_count(text))
    if keep is not None:  # without the texts: written once, read by both passes
        wide = wide.select(*(column(c) for c in dict.fromkeys([*keep, "doc_id", "source", "lang"])), names["topic"], names["tokens"])
        wide = materialize(wide, "mix")
    narrow = wide.select(source.alias("source"), lang.alias("lang"), topic.alias("topic"), F.col(names["tokens"]).alias("tokens"))
    cells = materialize(cells_of(narrow), "cells")
    raked = rake(cells, targets or default_targets(cells, params), params)
    rates = materialize(sampling_rates(raked, params), "rates")
    mine = {c: fresh_name(wide, f"cell_{c}") for c in (*MARGINS, "tokens", "weight", "rate")}
    side = rates.select(*(F.col(c).alias(n) for c, n in mine.items()))
    on = [a.eqNullSafe(F.col(mine[m])) for m, a in zip(MARGINS, (source, lang, topic), strict=True)]
    out = wide.join(maybe_broadcast(side, side.count()), on[0] & on[1] & on[2], "left")
    share = F.when(F.col(mine["tokens"]) > 0, F.col(mine["weight"]) * F.col(names["tokens"]) / F.col(mine["tokens"])).otherwise(0.0)
    out = out.withColumn(names["weight"], share).withColumn(names["rate"], F.col(mine["rate"])).drop(*mine.values())
    rate = F.when(F.col(names["tokens"]) > 0, F.col(names["rate"])).otherwise(0.0)
    return out.withColumn(names["rate"], rate).withColumn(names["sampled"], draw(column("doc_id").cast("long"), params.seed) < F.col(names["rate"]))


def report(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, weight, rate, sampled."""
    plain = docs.select(*(column(c) for c in ("doc_id", "source", "lang", "text")))
    return mix(plain, params, keep=["doc_id"]).select("doc_id", "source", "lang", "topic", "tokens", "weight", "rate", "sampled")


def sample(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The sampled rows of ``docs`` with their columns and topic, tokens, weight and rate."""
    out = mix(docs, params)
    chosen = out.columns[-1]
    return out.where(column(chosen)).drop(chosen)
