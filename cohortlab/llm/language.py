"""Language identification of texts and of spans within them.

A word's script (by code-point ranges) narrows the languages it may be of to those whose training words use
that script.  Among these it is scored by character n-grams, relative to its best language.  Viterbi over the words of
a text, with a penalty for each change of language, labels spans; the language of the most letters is the text's.

Fitted on a bounded sample of labelled documents (``fit_documents`` for each language, chosen by hash; the
``grams_per_language`` most frequent n-grams stay); every text is labelled in full.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import column, map_frames, mix64, small_batches

UNKNOWN = "und"
FIT_DOCUMENTS = 2_000
GRAMS_PER_LANGUAGE = 30_000
LANGUAGES = 1_000
ORDERS = (2, 3, 4)
RARE = 1e-6
WORD_LIMIT = 5.0
SWITCH = 10.0
SCRIPT_SHARE = 0.01
CHUNK_CHARS = 2_400_000
CELLS = 1 << 23
LETTERS = re.compile(r"[^\W\d_]+")

# FIXED VALUES: first code point of Unicode ranges and the script of their letters, in code-point order.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAB30, "Latin"), (0xAB70, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"),
    (0x1B000, "Kana"), (0x1B300, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
_FIRST = [first for first, _ in SCRIPT_RANGES]
_GREEK = chr(_FIRST[1])


def script_of(character: str) -> str:
    return SCRIPT_RANGES[bisect.bisect_right(_FIRST, ord(character)) - 1][1]


def pieces(word: str) -> list[tuple[int, str, str]]:
    """(offset, piece, script) of the parts of a run of letters that are of one script; other signs are left out."""
    if word.isalpha() and max(word) < _GREEK:
        return [(0, word, "Latin")]
    out: list[tuple[int, str, str]] = []
    open_ = False
    for i, c in enumerate(word):
        if not c.isalpha():
            open_ = False
            continue
        script = script_of(c)
        if open_ and out[-1][2] == script:
            out[-1] = (out[-1][0], out[-1][1] + c, script)
        else:
            out.append((i, c, script))
        open_ = True
    return out


def gram_keys(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams of all words (lower-cased, ends marked), and how many each word has."""
    lower = [w.lower() for w in words]
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    keys = points + np.uint64(1)
    for n in range(2, ORDERS[-1] + 1):
        keys = keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in ORDERS:
            yield n, mix64(keys[left[: len(keys)] >= n]), np.maximum(sizes - n + 1, 0)


@dataclass
class LanguageModel:
    """Languages in name order, their log shares, the languages of each script, and log frequencies of n-grams by hash."""

    languages: list[str]
    prior: np.ndarray
    scripts: dict[str, np.ndarray]
    keys: np.ndarray
    weights: np.ndarray

    def scores(self, words: list[tuple[str, str]]) -> np.ndarray:
        """For (word, script): 0 for the best language, less for others, -WORD_LIMIT at least.

        A language that doesn't write the script gets -WORD_LIMIT; a script that no language writes says nothing, and an
        n-gram that the model doesn't have neither.
        """
        names = sorted({script for _, script in words})
        able = np.array([self.scripts.get(name, np.zeros(len(self.languages), bool)) for name in names]).reshape(len(names), -1)
        number = {name: i for i, name in enumerate(names)}
        mine = able[np.fromiter((number[script] for _, script in words), np.int64, len(words))].reshape(len(words), -1)
        out = np.where(mine | ~mine.any(axis=1, keepdims=True), 0, -WORD_LIMIT).astype(np.float32)
        asked = np.flatnonzero(mine.sum(axis=1) > 1)
        step = max(1, CELLS // (16 * max(1, len(self.languages))))
        for low in range(0, len(asked), step):
            rows = asked[low : low + step]
            total = np.zeros((len(rows), len(self.languages)))
            for _, keys, count in gram_keys([words[k][0] for k in rows]):
                place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                place[self.keys[place] != keys] = len(self.keys)
                some = count > 0
                if some.any():
                    total[some] += np.add.reduceat(self.weights[place], (np.cumsum(count) - count)[some], axis=0)
            total = np.where(mine[rows], total / len(ORDERS), -np.inf)
            out[rows] = np.maximum(total - total.max(axis=1, keepdims=True), -WORD_LIMIT)
        return out


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
    fit_documents: int = FIT_DOCUMENTS, grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageModel:
    """A model of the documents that aren't held out and have text and label; the ``LANGUAGES`` most frequent labels at most.

    A language with more than ``fit_documents`` documents gives about that many, chosen by a hash of id and text;
    equal rows count once.  Without any such document the model has no language.
    """
    small_batches(docs.sparkSession)
    usable = docs.select(
        column(doc_id).cast("string").alias("id"), column(text).cast("string").alias("text"), column(lang).cast("string").alias("lang"),
        held_out(column(doc_id)).alias("out"),
    ).where("not out and text is not null and lang is not null")
    counts = {r.lang: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return LanguageModel([], np.zeros(0), {}, np.zeros(1, np.uint64), np.zeros((1, 0)))
    rates = usable.sparkSession.createDataFrame([(k, min(1.0, fit_documents / n)) for k, n in counts.items()], "lang string, rate double")
    key = F.xxhash64("id", "text")
    sample = (
        usable.withColumn("key", key)
        .join(F.broadcast(rates), "lang")
        .where((F.shiftrightunsigned("key", 11) / float(1 << 53)) < F.col("rate"))
        .groupBy("lang", "key")
        .agg(F.first("text").alias("text"))
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for language, texts in pdf.groupby("lang")["text"]:
            found, scripts = Counter(), Counter()
            for word, n in Counter(w for t in texts for w in LETTERS.findall(t)).items():
                for _, piece, script in pieces(word):
                    found[piece] += n
                    scripts[script] += n
            times = np.fromiter(found.values(), np.int64, len(found))
            for order, keys, sizes in gram_keys(list(found)) if found else ():
                kinds, which = np.unique(keys, return_inverse=True)
                n = np.bincount(which, np.repeat(times, sizes), len(kinds)).astype(np.int64)
                out.append(pd.DataFrame({"lang": language, "part": order, "name": None, "key": kinds.view(np.int64), "n": n}))
            out.append(pd.DataFrame({"lang": language, "part": 0, "name": list(scripts), "key": 0, "n": list(scripts.values())}))
        return pd.concat(out) if out else None

    counted = map_frames(sample.select("lang", "text"), count, "lang string, part int, name string, key long, n long")
    by_rank = Window.partitionBy("lang", F.col("part") > 0).orderBy(F.desc("n"), "key", "name")
    kept = (
        counted.groupBy("lang", "part", "name", "key").agg(F.sum("n").alias("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("lang", "part")))
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= grams_per_language)
        .select("lang", "part", "name", "key", (F.col("n") / F.col("total")).alias("share"))
        .toPandas()
    )
    languages = sorted(counts)
    number = {name: i for i, name in enumerate(languages)}
    scripts: dict[str, np.ndarray] = {}
    for r in kept[kept["part"] == 0].itertuples(index=False):
        if r.share >= SCRIPT_SHARE:
            scripts.setdefault(r.name, np.zeros(len(languages), bool))[number[r.lang]] = True
    grams = kept[kept["part"] > 0]
    keys, row = np.unique(grams["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    weights = np.full((len(keys) + 1, len(languages)), RARE)
    weights[row, grams["lang"].map(number).to_numpy(np.int64)] += grams["share"].to_numpy(np.float64)
    weights = np.log(weights)
    weights[-1] = 0
    prior = np.log(np.array([counts[name] for name in languages]) / sum(counts.values()))
    return LanguageModel(languages, prior, scripts, keys, weights)


def steady(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """The one language of each text whose best path provably never changes, else -1 (also for texts without words).

    It is the language of the greatest total, if no stretch of words favours another one by more than half the penalty:
    each change of language would then cost more than it gains.  (Greatest sum of a stretch: sums less the least
    sum so far, text by text.)
    """
    out = np.full(len(sizes), -1)
    texts = np.flatnonzero(sizes > 0)
    if not len(texts):
        return out
    size = sizes[texts]
    first = np.cumsum(size) - size
    score = table[codes].astype(np.float64)
    best = (np.add.reduceat(score, first, axis=0) + prior).argmax(axis=1)
    text = np.repeat(np.arange(len(texts)), size)
    score -= score[np.arange(len(codes)), best[text]][:, None]
    start = prior - prior[best][:, None]
    largest = np.zeros(len(texts))
    apart = 2.0 * (len(codes) + len(texts)) * (WORD_LIMIT + np.abs(start).max()) + 1
    for k in range(table.shape[1]):
        total = np.cumsum(score[:, k])
        before = total - score[:, k]
        before[first] -= np.maximum(start[:, k], 0)
        least = np.minimum.accumulate(before - text * apart) + text * apart
        largest = np.maximum(largest, np.maximum.reduceat(total - least, first))
    out[texts] = np.where(largest <= switch / 2 - 1e-3, best, -1)
    return out


def viterbi(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word: ``sizes`` words a text, word i scored by ``table[codes[i]]``; all texts advance together."""
    by = np.argsort(-sizes, kind="stable")
    first, length = (np.cumsum(sizes) - sizes)[by], sizes[by]
    stays = np.ones((len(codes), table.shape[1]), bool)
    before = np.zeros(len(codes), np.int16)
    value = np.tile(prior.astype(np.float64), (len(by), 1))
    longest = int(length[0]) if len(length) else 0
    going = np.searchsorted(-length, -np.arange(longest), "left")
    for t in range(longest):
        m = going[t]
        at = first[:m] + t
        if t:
            now = value[:m]
            best = now.argmax(axis=1)
            least = now[np.arange(m), best][:, None] - switch
            stays[at] = now >= least
            before[at] = best
            value[:m] = np.maximum(now, least)
        value[:m] += table[codes[at]]
    label = np.empty(len(codes), np.int16)
    current = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = going[t]
        at = first[:m] + t
        label[at] = current[:m]
        current[:m] = np.where(stays[at, current[:m]], current[:m], before[at])
    return label


def best_languages(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on its text's best path; only texts that may change language go through Viterbi."""
    one = steady(codes, sizes, table, prior, switch)
    label = np.repeat(one, sizes)
    mixed = label < 0
    if mixed.any():
        label[mixed] = viterbi(codes[mixed], sizes[one < 0], table, prior, switch)
    return label


def _identified(texts: list[str | None], model: LanguageModel, switch: float) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text."""
    if not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    found = [LETTERS.findall(value) if value else [] for value in texts]
    token, tokens_ = pd.factorize(np.array([t for tokens in found for t in tokens], dtype=object))
    known: dict[tuple[str, str], int] = {}
    split = [[known.setdefault((p, s), len(known)) for _, p, s in pieces(t)] for t in tokens_]
    many = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.array([k for ks in split for k in ks], np.int64)
    # the pieces of every token in text order
    each = many[token]
    codes_ = flat[np.repeat((np.cumsum(many) - many)[token] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum([len(tokens) for tokens in found], dtype=np.int64)))]
    sizes_ = np.diff(ends)
    table = model.scores(list(known))
    letters = np.array([len(p) for p, _ in known] or [0])
    label = best_languages(codes_, sizes_, table, model.prior, switch)
    out, at = [], 0
    for value, size, tokens in zip(texts, sizes_.tolist(), found):
        if not size:
            out.append((UNKNOWN, 0.0, []))
            continue
        mine, word = label[at : at + size], codes_[at : at + size]
        at += size
        held = np.bincount(mine, letters[word], minlength=len(model.languages))
        total = table[word].sum(axis=0, dtype=np.float64) + model.prior
        best = max(np.flatnonzero(held == held.max()), key=lambda k: total[k])
        share = np.exp(total - total.max())
        score = float(held[best] / held.sum() * (1.0 if (mine != mine[0]).any() else share[best] / share.sum()))
        out.append((model.languages[best], score, _spans(value, tokens, mine, model.languages)))
    return out


def _spans(value: str, tokens: list[str], label: np.ndarray, languages: list[str]) -> list[dict]:
    if (label == label[0]).all():
        begin, end = pieces(tokens[0]), pieces(tokens[-1])
        if begin and end:
            first, last = LETTERS.search(value).start() + begin[0][0], value.rfind(tokens[-1]) + end[-1][0] + len(end[-1][1])
            return [{"start": first, "end": last, "lang": languages[label[0]]}]
    places = [(m.start() + i, m.start() + i + len(p)) for m in LETTERS.finditer(value) for i, p, _ in pieces(m.group())]
    firsts = np.flatnonzero(np.append(True, label[1:] != label[:-1])).tolist()
    lasts = [*(k - 1 for k in firsts[1:]), len(places) - 1]
    return [{"start": places[a][0], "end": places[b][1], "lang": languages[label[a]]} for a, b in zip(firsts, lasts)]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id", switch: float = SWITCH) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, spans (start, end in code points, lang).

    lang_pred has the most letters in the spans (ties: the higher sum of scores); score is its share of the letters,
    times its probability given all words if the text has one span.  Null texts and texts without a letter, and all texts under a
    model without languages, are ``und`` with score 0 and no spans.  Null ids, repeated rows and other columns don't matter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(doc_id).alias("doc_id"), held_out(column(doc_id)).alias("held_out"), column(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            out: list[tuple[str, float, list[dict]]] = []
            chunk: list[str | None] = []
            size = 0
            for t in texts:
                if chunk and size + len(t or "") > CHUNK_CHARS:
                    out += _identified(chunk, model, switch)
                    chunk, size = [], 0
                chunk.append(t)
                size += len(t or "")
            if chunk:
                out += _identified(chunk, model, switch)
            result = pdf[["doc_id", "held_out"]].copy()
            for k, name in enumerate(("lang_pred", "score", "spans")):
                result[name] = pd.Series([r[k] for r in out], index=pdf.index, dtype="float64" if name == "score" else object)
            yield result

    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return rows.mapInPandas(run, schema)
