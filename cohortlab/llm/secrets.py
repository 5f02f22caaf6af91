"""Secret scans: base patterns plus formats learnt by grammar inference.

Labelled credentials (the values that the base patterns find, by kind) are written
as strings of character classes.  For each kind a prefix tree with counts is built and
its states are merged as long as the Hoeffding bound finds their futures
(stopping and next-symbol frequencies, recursively) compatible - red/blue state
merging as in ALERGIA.  The result is a deterministic probabilistic automaton
per kind.  All tokens outside the base spans that are as long as the shortest training string
or longer are scored by their format likelihood (bits per symbol); a token is reported if an
automaton generates it with a likelihood inside the range of its training strings, and ``odds`` bits likelier
in all than ordinary text does (character classes, each given the two before it), so words, dates and numbers stay.

The automata are fitted on a bounded sample of the labelled values
(``train_per_kind`` distinct values of a kind, smallest hashes first), ordinary text on all texts; every whole
text is scanned and every candidate scored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import column, fresh_name, map_frames, materialize, small_batches

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
LEARNT = {k: f"format_{k}" for k in KINDS}
ORDER = {k: i for i, k in enumerate((*KINDS, *LEARNT.values()))}

LONG_TOKEN = re.compile(r"(?<!\S)\S{20,}")
#: Tokens of the signs that values may hold; dots at the ends are punctuation.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=.-]*[A-Za-z0-9+/_=-])?(?![A-Za-z0-9+/_=@-]|\.[A-Za-z0-9])")
MASK = "[SECRET]"
CLASSES = "0agAG+/_=.-"
FORMAT_CACHE = 50_000


@dataclass(frozen=True)
class SecretParams:
    train_per_kind: int = 300
    #: Hoeffding test: smaller values merge more.
    alpha: float = 0.05
    #: Deviations under the mean training likelihood that are still accepted.
    slack: float = 3.0
    #: Bits by which a token must be likelier as a credential than as ordinary text: log2 of the prior odds.
    odds: float = 13.0


def _symbol(c: str) -> str:
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "G"
    return c


SYMBOLS = {i: _symbol(chr(i)) for i in range(128)}


def as_format(value: str) -> str:
    return value.translate(SYMBOLS)


#: Class of each byte; what no value holds is a boundary.
OTHER = len(CLASSES)
WIDTH = OTHER + 1
BYTE_CLASS = np.array([CLASSES.find(_symbol(chr(i))) % WIDTH if i < 128 else OTHER for i in range(256)], dtype=np.int16)


#: Bytes whose classes are held at once.
PIECE = 1 << 18


def class_counts(texts: list[str]) -> np.ndarray:
    """How often each three character classes follow each other; texts are set apart by boundaries."""
    data = f"\n\n{chr(10).join(texts)}\n".encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH**3, np.int64)
    for at in range(0, len(data) - 2, PIECE):
        c = BYTE_CLASS[np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at)]
        out += np.bincount((c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:], minlength=WIDTH**3)
    return out


class Ordinary:
    """Log2 likelihood of a token's format in ordinary text, from counts of three classes in a row (smoothed by one half)."""

    def __init__(self, counts: np.ndarray | None = None):
        n = (np.zeros(WIDTH**3) if counts is None else np.asarray(counts, float)).reshape(WIDTH, WIDTH, WIDTH) + 0.5
        first = n[:, OTHER, :OTHER].sum(axis=0)
        self.first = np.log2(first / first.sum()).tolist()
        self.next = np.log2(n / n.sum(axis=2, keepdims=True)).tolist()

    def bits(self, form: str) -> float:
        codes = [CLASSES.find(c) % WIDTH for c in form]
        before, here, total = OTHER, codes[0], self.first[codes[0]]
        for c in (*codes[1:], OTHER):
            total += self.next[before][here][c]
            before, here = here, c
        return total


class Scorer:
    """The likeliest kind of a format (None: ordinary text), remembered by format."""

    def __init__(self, automata: dict[str, Automaton], ordinary: Ordinary, odds: float):
        self.automata, self.ordinary, self.odds = automata, ordinary, odds
        self.least = min((x.shortest for x in automata.values()), default=0)
        self.known: dict[str, str | None] = {}

    def kind(self, form: str) -> str | None:
        if form not in self.known:
            if len(self.known) >= FORMAT_CACHE:
                self.known.clear()
            self.known[form] = self._kind(form)
        return self.known[form]

    def _kind(self, form: str) -> str | None:
        scored = [(x.bits(form), k) for k, x in self.automata.items() if len(form) >= x.shortest and x.accepts(form)]
        if not scored:
            return None
        best, kind = max(scored)
        return kind if best * (len(form) + 1) >= self.ordinary.bits(form) + self.odds else None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}


class Automaton:
    """A probabilistic automaton from strings, by compatible merges of prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float, slack: float):
        self.shortest = min(map(len, strings))
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            state = 0
            for c in s:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.ends.append(0)
                self.taken[state][c] = self.taken[state].get(c, 0) + 1
                state = self.next[state][c]
            self.ends[state] += 1
        self.alpha = alpha
        self.states = self._merge()
        scores = [x for x in map(self.bits, strings) if x is not None]
        mean = sum(scores) / len(scores)
        spread = math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
        self.least = mean - slack * max(spread, 0.05)

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(self.taken[s].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self._total(a), self._total(b)
            if not n1 or not n2:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in {*self.taken[a], *self.taken[b]}:
                if self._differ(self.taken[a].get(c, 0), n1, self.taken[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> int:
        red = [0]
        while True:
            known = set(red)
            blue = [(r, c, s) for r in red for c, s in sorted(self.next[r].items()) if s not in known]
            if not blue:
                return len(red)
            r, c, b = blue[0]
            for old in red:
                if self._compatible(old, b):
                    self.next[r][c] = old
                    self._fold(old, b)
                    break
            else:
                red.append(b)

    def bits(self, s: str) -> float | None:
        """Mean log2 likelihood of a symbol (the end counts as one); None if it isn't generated."""
        state, total = 0, 0.0
        for c in s:
            if c not in self.next[state]:
                return None
            total += math.log2(self.taken[state][c] / self._total(state))
            state = self.next[state][c]
        if not self.ends[state]:
            return None
        return (total + math.log2(self.ends[state] / self._total(state))) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        score = self.bits(s)
        return score is not None and score >= self.least


def base_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns: leftmost, non-overlapping for each kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for t in LONG_TOKEN.finditer(text):  # the other kinds lie inside long tokens
        a, b = t.span()
        if "AKIA" in t[0]:
            out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text, a, b) if len(m[0]) >= LEAST_ACCESS]
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text, a, b)]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def scorer(automata: dict[str, Automaton], ordinary: Ordinary | None = None, params: SecretParams = SecretParams()) -> Scorer:
    return Scorer(automata, ordinary or Ordinary(), params.odds)


def learnt_spans(text: str | None, base: list[tuple[int, int, str, str]], formats: Scorer) -> list[tuple[int, int, str, str]]:
    """Further tokens whose format one of the automata generates (the likeliest kind)."""
    if not text or not formats.automata:
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < formats.least:
            continue
        kind = formats.kind(m[0].translate(SYMBOLS))
        if kind is not None and not any(a < y and x < b for x, y, *_ in base):
            out.append((a, b, LEARNT[kind], m[0]))
    return out


def all_spans(text: str | None, formats: Scorer | dict[str, Automaton]) -> tuple[list, list]:
    base = base_spans(text)
    if isinstance(formats, dict):
        formats = scorer(formats)
    return base, sorted([*base, *learnt_spans(text, base, formats)], key=lambda x: (x[0], ORDER[x[2]]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def _without(text: str, spans: list) -> str:
    """The text with a line break for every span (spans may overlap)."""
    out, at = [], 0
    for a, b, *_ in spans:
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "\n".join([*out, text[at:]])


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Labelled values by kind, and the class counts of what lies outside them (kind null)."""
    rows, rest = set(), []
    for t in pdf["text"]:
        if t:
            base = base_spans(t)
            rows.update((k, v) for _, _, k, v in base)
            rest.append(_without(t, base) if base else t)
    if not rest:
        return None
    n = class_counts(rest)
    some = np.flatnonzero(n)
    found = pd.DataFrame(sorted(rows), columns=["kind", "value"]).assign(place=-1, n=1)
    return pd.concat([found, pd.DataFrame({"kind": None, "value": None, "place": some, "n": n[some]})])


def fit_formats(docs: DataFrame, params: SecretParams = SecretParams()) -> Scorer:
    """One automaton for each kind that has labelled values (none if the texts have no credential), and ordinary text.

    The texts are read once; what is collected is ``train_per_kind`` values a kind and a fixed number of class counts.
    """
    small_batches(docs.sparkSession)
    found = map_frames(docs.select(column("text").alias("text")), _labelled, "kind string, value string, place int, n long")
    found = materialize(found.groupBy("kind", "value", "place").agg(F.sum("n").alias("n")), "formats")
    rows = None
    for kind in KINDS:
        top = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(params.train_per_kind).select("kind", "value")
        rows = top if rows is None else rows.unionByName(top)
    values: dict[str, list[str]] = {}
    for r in rows.collect():
        values.setdefault(r["kind"], []).append(r["value"])
    automata = {k: Automaton([as_format(v) for v in sorted(values[k])], params.alpha, params.slack) for k in KINDS if k in values}
    counts = np.zeros(WIDTH**3)
    for r in found.where("kind is null").collect():
        counts[r["place"]] = r["n"]
    return scorer(automata, Ordinary(counts), params)


def scan(docs: DataFrame, formats: Scorer | None = None, params: SecretParams = SecretParams()) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_learnt, base_sha256, spans.

    Null texts count as empty; an empty text has no spans (the digest is that of the empty
    string).  Repeated rows and null ids are reported row by row; other columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    if formats is None:
        formats = fit_formats(docs, params)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            base, spans = all_spans(t, formats)
            n = {k: sum(x[2] == k for x in base) for k in KINDS}
            rows.append((i, *n.values(), len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        return pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_learnt", "base_sha256", "spans"])

    return map_frames(
        docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").alias("text")),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_learnt long, base_sha256 string, spans string",
    )


def masked(text: str | None, formats: Scorer | dict[str, Automaton]) -> str | None:
    """The text with every span (overlapping ones together) replaced by MASK."""
    if not text:
        return text
    spans = all_spans(text, formats)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """The same rows and columns with secrets in ``text`` masked; an n_chars column is made to fit changed texts."""
    formats = fit_formats(docs, params)

    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, formats), na_action="ignore")

    new = fresh_name(docs, "masked")
    out = docs.withColumn(new, mask(column("text")))
    changed = ~F.col(new).eqNullSafe(column("text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(new).alias(c))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length(new)).otherwise(column(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(column(c))
    return out.select(*cols)
