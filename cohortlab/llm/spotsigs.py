"""Document fingerprints from spot signatures.

An anchor is a common word; the content word behind it starts a chain of ``chain`` content words (common words
in between are skipped).  Anchor and chain, hashed to 32 bits, are a signature; the set of a text's signatures is its
fingerprint, written with its length class.  A text without any spot takes every word as an
anchor, one without words its own hash.  Two fingerprints are compared by Jaccard similarity; if
their lengths alone bound it under ``prune``, they aren't intersected and count as 0.

DataFrame functions only.  A document's successor comes from a window over slices of
the ids; only the first document of each slice is looked up by its predecessor slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import column
from cohortlab.llm.quality import STOP_WORDS


QUANTILES = 64


@dataclass(frozen=True)
class SpotParams:
    chain: int = 2
    prune: float = 0.05
    #: Documents in one slice of the id range, on average.
    slice_rows: int = 1_000
    anchors: tuple[str, ...] = tuple(sorted(STOP_WORDS))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(*parts: Column) -> Column:
    return F.hash(*parts)


def signatures(text: Column, params: SpotParams = SpotParams()) -> Column:
    """The sorted distinct signatures of a non-null text; empty for an empty text."""
    common = list(params.anchors)

    def of(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.struct(
            w.alias("w"), w.isin(common).alias("common"), F.when(i > 0, F.element_at(words, i)).alias("before")
        ))
        content = F.filter(marked, lambda x: ~x["common"])

        def spots(c: Column) -> Column:
            chains = F.transform(c, lambda x, i: F.when(
                x["before"].isin(common),
                _hash(x["before"], *(F.get(c, i + F.lit(j))["w"] for j in range(params.chain))),
            ))
            found = F.array_distinct(F.filter(chains, lambda s: s.isNotNull()))
            every = F.array_distinct(F.transform(words, lambda w, i: _hash(*(F.get(words, i + F.lit(j)) for j in range(params.chain)))))
            bare = F.when(F.length(text) > 0, F.array(_hash(text))).otherwise(F.array().cast("array<int>"))
            return F.when(F.size(found) > 0, found).when(F.size(words) > 0, every).otherwise(bare)

        return _let(content, spots)

    return F.array_sort(_let(words_of(text), of))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def fingerprint(sigs: Column) -> Column:
    """Length class, then the signatures in hexadecimal."""
    size = F.size(sigs)
    klass = F.when(size > 0, F.floor(F.log2(size)) + 1).otherwise(0)
    return F.concat(klass.cast("string"), F.lit(":"), F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column, prune: float) -> Column:
    """Jaccard similarity of two signature arrays, 0 where their lengths bound it under ``prune``; of two empty ones 1."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = _let(both, lambda n: n / (low + high - n))
    return F.when(high == 0, 1.0).when(low < prune * high, 0.0).otherwise(exact).cast("double")


def with_next(docs: DataFrame, params: SpotParams = SpotParams()) -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: each row with its successor by doc_id (after the last: the first).

    Rows with equal ids follow each other in the order of their texts; null ids come last.  Ids are cut into slices
    at their quantiles, and between two quantiles into equal parts, so far or uneven ids don't make a slice large; only the rows of one
    id (or none) stay together, and spill if they are many.
    """
    base = docs.select(column("doc_id").cast("long").alias("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"))
    span = base.agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES)], 100 * QUANTILES).alias("cuts")
    ).first()
    cuts = sorted({*(span["cuts"] or [0])})
    parts = max(1, -(-span["n"] // (params.slice_rows * len(cuts))))
    ends = [*cuts[1:], span["hi"] or 0]
    # number of the last cut at or below the id, then the part of the way to the next cut (in doubles: no overflow, order kept)
    number = F.greatest(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))
    low, high = (F.get(F.lit([float(x) for x in xs]), number) for xs in (cuts, ends))
    share = (F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    sliced = base.withColumn("slice", F.when(F.col("doc_id").isNotNull(), number * parts + part).otherwise(F.lit((len(cuts) + 1) * parts)).cast("long"))
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    rows = sliced.withColumn("sigs", signatures(F.col("text"), params))
    rows = rows.withColumn("after", F.lead(F.struct("text", "sigs")).over(Window.partitionBy("slice").orderBy(*order)))
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text")
    heads = sliced.groupBy("slice").agg(F.min(key).alias("head")).select("slice", F.col("head.text").alias("head_text"))
    # one row for each slice: its successor among the slices that hold documents
    ring = sliced.select("slice").distinct()
    ring = ring.withColumn("follows", F.lead("slice").over(Window.orderBy("slice")))
    first = sliced.agg(F.min("slice")).first()[0] or 0
    ring = ring.withColumn("follows", F.coalesce("follows", F.lit(first)))
    heads = ring.join(heads.withColumnRenamed("slice", "follows"), "follows").select("slice", "head_text")
    heads = heads.withColumn("head_sigs", signatures(F.col("head_text"), params))
    out = rows.join(heads, "slice", "left")
    return out.select(
        "doc_id", "text", "sigs", F.coalesce(F.col("after.text"), F.col("head_text")).alias("next_text"),
        F.when(F.col("after").isNotNull(), F.col("after.sigs")).otherwise(F.col("head_sigs")).alias("next_sigs"),
    )


def fingerprints(docs: DataFrame, params: SpotParams = SpotParams()) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the
    next document, or all it has.  Null texts count as empty; empty texts have an empty fingerprint, and two
    empty ones are alike.  One row for every input row; an empty table gives an empty result.
    """
    rows = with_next(docs, params).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited"), params))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs"), params.prune).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), params.prune).alias("near_next"), F.size("sigs").alias("n_signatures"),
    )
