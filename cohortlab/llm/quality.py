"""Quality classifier: document evidence combined with host and path posteriors (empirical Bayes).

1. Evidence.  Cheap whole-text features and a learnt lexicon feed two logistic
   regressions (quality, toxicity).  They are fitted on a bounded sample of labelled
   documents (``fit_rows``, smallest hashes first).  For the weights, each half's lexicon features come
   from the other half's lexicon, so that a lexicon's own training texts don't flatter it.
2. Sites.  The evidence of all documents is summed by path (source and language) and
   host (source) in grouped aggregation.  Method-of-moments priors shrink hosts
   toward the global rate and paths toward their host: a sparse site has its parent's rate.
3. Posterior.  logit(document) + logit(path) - logit(global): a site moves the odds of its documents by as much
   as its shrunk rate differs from the overall rate.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import column, fresh_name, map_frames, materialize, maybe_broadcast, quoted, small_batches

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was
    were which will with you au aux ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas
    pour qui que sa se ses son sur un une vous al como con del el es esta las lo los mas no para pero por su sus una y der die
    das dem den des ein eine einen einer ist im mit nicht sich sie und von zu auf""".split()
)
PREFIX = 5
N_FEATURES = 14


@dataclass(frozen=True)
class QualityParams:
    fit_rows: int = 20_000
    lexicon: int = 5_000
    #: A term is learnt from this many toxic texts at least, and this share of them.
    least_docs: int = 3
    least_share: float = 0.015
    least_weight: float = 3.0
    ridge: float = 1.0
    reject_quality_below: float = 0.5
    reject_toxic_above: float = 0.5


def _terms(words: list[str]) -> set[str]:
    """Distinct lower-case words without outer punctuation, and the stems (first letters) of longer ones."""
    plain = {w.lower().strip(".,;:!?\"'()[]*#%&$|") for w in set(words)}
    return plain | {"^" + w[:PREFIX] for w in plain if len(w) >= PREFIX}


def text_features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Features of a whole text; null and blank texts have zeros but for the bias and the blank flag."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (N_FEATURES - 2) + [1.0]
    distinct = set(words)
    weights = [lexicon[t] for t in _terms(words) & lexicon.keys()] if lexicon else []
    lines = text.split("\n")
    return [
        1.0,
        float(np.log1p(n)),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        len(distinct) / n,
        sum(map(eq, words, words[1:])) / n,
        text.count("|") / n,
        sum(map(len, words)) / n / 10,
        sum(map(STOP_WORDS.__contains__, words)) / n,
        1.0 - len(set(lines)) / len(lines),
        min(1.0, len(weights)),
        min(10.0, sum(weights)) / 10,
        min(3, len(weights)) / 3,
        0.0,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardized features (Newton steps)."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> Logistic:
        center = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        scale = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        center[0], scale[0] = 0.0, 1.0
        scale[scale < 1e-9] = 1.0
        w = np.zeros(N_FEATURES)
        if len(x) and 0 < y.sum() < len(y):
            z = (x - center) / scale
            penalty = np.full(N_FEATURES, ridge)
            penalty[0] = 1e-6
            for _ in range(50):
                p = _sigmoid(z @ w)
                h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
                step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
                w += np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
        elif len(x):  # one class only: the smoothed rate
            w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return Logistic(center, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.center) / self.scale) @ self.weights)


@dataclass
class Evidence:
    """What is fitted: the lexicon and the two regressions."""

    lexicon: dict[str, float]
    quality: Logistic
    toxic: Logistic

    def score(self, texts: pd.Series) -> pd.DataFrame:
        x = np.array([text_features(t, self.lexicon) for t in texts], dtype=float).reshape(-1, N_FEATURES)
        return pd.DataFrame({"quality": self.quality(x), "toxic": self.toxic(x)})


def _term_counts(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """How many texts of each toxic label and half hold a term; the term '' counts the texts.  Held is one number a term, not one row a text and term."""
    counts: dict[tuple[int, int], Counter] = {}
    for x, y, h in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
        counts.setdefault((y, h), Counter()).update(("", *_terms(x.split())))
    rows = [(t, y, h, n) for (y, h), found in counts.items() for t, n in found.items()]
    return pd.DataFrame(rows, columns=["term", "toxic", "half", "size"]) if rows else None


def _lexicon(counts: DataFrame, bad: str, good: str, params: QualityParams) -> dict[str, float]:
    """Terms of at least a share of the toxic texts, with a high log odds ratio; at most ``lexicon`` of them."""
    both = counts.select("term", F.expr(bad).alias("bad"), F.expr(good).alias("good"))
    total = both.where("term = ''").first()
    if not total or not total["bad"] or not total["good"]:
        return {}
    weight = F.log((F.col("bad") + 0.5) / F.lit(total["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(total["good"] + 1.0))
    least = max(params.least_docs, params.least_share * total["bad"])
    found = both.where((F.col("term") != "") & (F.col("bad") >= least)).withColumn("weight", weight).where(F.col("weight") >= params.least_weight)
    return {r["term"]: r["weight"] for r in found.orderBy(F.desc("weight"), "term").limit(params.lexicon).collect()}


def fit_evidence(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Evidence:
    """Fit on at most ``fit_rows`` labelled documents.

    Null labels and labels of unknown documents are left out.  A document's labels are taken by majority (a tie counts as low
    quality and as toxic), and of rows with its id the smallest text, so the order of rows doesn't matter.  Without labels every document has the
    evidence 0.5 and nothing is rejected; with one class only, that class's smoothed rate.
    """
    small_batches(docs.sparkSession)
    some = (
        labels.select(
            column("doc_id").cast("long").alias("label_id"), column("quality").cast("int").alias("quality"), column("toxic").cast("int").alias("toxic")
        )
        .where("label_id is not null and quality is not null and toxic is not null")
        .groupBy("label_id")
        .agg((F.avg("quality") > 0.5).cast("int").alias("quality"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(params.fit_rows)
    )
    texts = docs.select(column("doc_id").cast("long").alias("label_id"), column("text").alias("text"))
    labelled = texts.join(F.broadcast(some), "label_id").where("text is not null")
    sample = labelled.groupBy("label_id", "quality", "toxic").agg(F.min("text").alias("text")).withColumn("half", F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(2)))

    once = sample.withColumn("same", F.xxhash64("text")).groupBy("same", "toxic").agg(F.min("text").alias("text"), F.min("half").alias("half")).select("text", "toxic", "half")
    counts = map_frames(once, _term_counts, "term string, toxic int, half int, size long").groupBy("term").agg(*(
        F.sum(F.when((F.col("toxic") == y) & (F.col("half") == h), F.col("size")).otherwise(0)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)
    ))
    counts = materialize(counts.where(f"n10 + n11 >= {params.least_docs} or term = ''"), "terms")
    lexicons = {h: _lexicon(counts, f"n1{1 - h}", f"n0{1 - h}", params) for h in (0, 1)}
    lexicon = _lexicon(counts, "n10 + n11", "n00 + n01", params)

    def numbers(pdf: pd.DataFrame) -> pd.DataFrame:
        x = [text_features(t, lexicons[h]) for t, h in zip(pdf["text"], pdf["half"], strict=True)]
        return pd.DataFrame({"id": pdf["label_id"], "x": x, "quality": pdf["quality"], "toxic": pdf["toxic"]})

    rows = map_frames(sample, numbers, "id long, x array<double>, quality int, toxic int").toPandas().sort_values(["id"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    fitted = [Logistic.fit(x.copy(), rows[k].to_numpy(dtype=float), params.ridge) for k in ("quality", "toxic")]
    return Evidence(lexicon, *fitted)


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _shrunk(target: str, parent, variance: float):
    """Posterior mean under a Beta prior around the parent's rate; its strength m(1-m)/v - 1 is kept in [1, 1e6]."""
    k = F.least(F.greatest(parent * (1 - parent) / F.lit(max(variance, 1e-12)) - 1, F.lit(1.0)), F.lit(1e6))
    return (F.col(target) + k * parent) / (F.col("n") + k)


def site_posteriors(paths: DataFrame) -> DataFrame:
    """Shrunk rates from sums of evidence by path: columns host, path, n, quality, toxic (sums).

    Returns host, path, and for each target ``_global``, ``_host`` and ``_path`` rates.
    Null hosts and paths are sites of their own.
    """
    kinds = ("quality", "toxic")
    sums = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", *kinds)))
    total = sums.agg(*(F.sum(c).alias(c) for c in ("n", *kinds))).first()
    n = total["n"] or 0
    rate = {t: ((total[t] or 0.0) + 0.5) / (n + 1.0) for t in kinds}

    def spread(df: DataFrame, parent) -> dict[str, float]:
        squares = (F.sum(F.col("n") * F.pow(F.col(t) / F.col("n") - parent(t), 2)) / F.sum("n") for t in kinds)
        row = df.agg(*(s.alias(t) for s, t in zip(squares, kinds, strict=True))).first()
        return {t: row[t] or 0.0 for t in kinds}

    between = spread(sums, lambda t: F.lit(rate[t]))
    hosts = sums.select(
        F.col("host").alias("site"),
        *(_shrunk(t, F.lit(rate[t]), between[t]).alias(f"{t}_host") for t in kinds),
    )
    out = paths.join(hosts, paths["host"].eqNullSafe(hosts["site"])).drop("site")
    within = spread(out, lambda t: F.col(f"{t}_host"))
    return out.select(
        "host",
        "path",
        *(F.lit(rate[t]).alias(f"{t}_global") for t in kinds),
        *(f"{t}_host" for t in kinds),
        *(_shrunk(t, F.col(f"{t}_host"), within[t]).alias(f"{t}_path") for t in kinds),
    )


def with_posteriors(
    docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), host: str = "source", path: str = "lang", keep: list[str] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (or its columns ``keep``) with the classifier's columns, and the names these have there.

    Sites are ``host`` and (``host``, ``path``).  Null and blank texts are scored by their
    features like any other text; all rows are kept.
    """
    evidence = fit_evidence(docs, labels, params)

    @F.pandas_udf("quality double, toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return evidence.score(texts)

    narrow = docs.select(column(host).cast("string").alias("host"), column(path).cast("string").alias("path"), score(column("text")).alias("s"))
    paths = narrow.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("s.quality").alias("quality"), F.sum("s.toxic").alias("toxic"))
    sites = materialize(site_posteriors(materialize(paths, "paths")), "sites")
    rows = sites.count()
    names = {k: fresh_name(docs, k) for k in (
        "evidence", "site_host", "site_path", "quality_evidence", "toxic_evidence", "quality_host", "quality_path", "toxic_host", "toxic_path",
        "quality_global", "toxic_global", "quality_posterior", "toxic_posterior", "rejected")}
    rename = {"host": "site_host", "path": "site_path"}
    sites = sites.select(*(F.col(c).alias(names[rename.get(c, c)]) for c in sites.columns))
    out = docs.withColumn(names["evidence"], score(column("text")))
    if keep is not None:
        out = out.select(*(column(c) for c in dict.fromkeys([*keep, host, path])), column(names["evidence"]))
    on = column(host).cast("string").eqNullSafe(F.col(names["site_host"])) & column(path).cast("string").eqNullSafe(F.col(names["site_path"]))
    out = out.join(maybe_broadcast(sites, rows), on, "left")
    for t in ("quality", "toxic"):
        e = F.col(quoted(names["evidence"]) + f".{t}")
        post = _logit(e) + _logit(F.col(names[f"{t}_path"])) - _logit(F.col(names[f"{t}_global"]))
        out = out.withColumn(names[f"{t}_evidence"], e).withColumn(names[f"{t}_posterior"], 1 / (1 + F.exp(-post)))
    bad = (F.col(names["quality_posterior"]) < params.reject_quality_below) | (F.col(names["toxic_posterior"]) > params.reject_toxic_above)
    return out.withColumn(names["rejected"], bad), names


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Per row: doc_id, evidence, host and path rates, posteriors for quality and toxicity, and ``rejected``.

    One row for every input row, repeated rows and null ids too; empty tables give an empty result.
    """
    out, n = with_posteriors(docs, labels, params, keep=["doc_id"])
    cols = [c for c in n if c not in ("evidence", "site_host", "site_path", "quality_global", "toxic_global")]
    return out.select(column("doc_id").cast("long").alias("doc_id"), *(F.col(n[c]).alias(c) for c in cols))


def accepted(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns unchanged."""
    out, n = with_posteriors(docs, labels, params)
    return out.where(~F.col(n["rejected"])).select(*(column(c) for c in docs.columns))
