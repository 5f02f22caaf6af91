"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words of smallest period q that no neighbouring word extends.  Its last square (two copies of
the period) is a branching tandem: suffixes i and i+q agree on exactly q words.  So both lie in one LCP interval of
depth q, in different children.  For each interval (as splits of the LCP array, no tree nodes) the suffixes of the smaller
child are looked up: is ISA[i+q] or ISA[i-q] in the other child?  Each square found is rotated to the left as long as it
stays a square; squares of one end merge into the run of smallest period.

The documents of a batch share one suffix array: words are ranked by (document, word) and each document ends in a
terminator of its own, so no suffix reaches into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import column, small_batches

CHUNK_WORDS = 200_000
CELLS = 1 << 22
WORD = r"[^\x20\x09-\x0D]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_array(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order and, for each k, the ranks by the first 2**k words (equal rank: equal words).

    Prefix doubling; each step sorts only the suffixes that still share their rank.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    levels, step = [rank], 1
    while True:
        shared = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not shared.size:
            return order, levels
        suffixes = order[shared]
        both = rank[suffixes] * n + rank[suffixes + step]
        by = np.argsort(both, kind="stable")
        suffixes, both = suffixes[by], both[by]
        order[shared] = suffixes
        fresh = np.ones(len(shared), bool)
        fresh[1:] = both[1:] != both[:-1]
        head[shared] = fresh
        rank = rank.copy()
        rank[suffixes] = np.maximum.accumulate(np.where(fresh, shared, 0))
        levels.append(rank)
        step *= 2


def lcp_array(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common words of each suffix and the one before it in order (0 for the first)."""
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        common[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return common


def child_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each split r: suffixes left[r]..r-1 and r..right[r]-1 are the children that meet in an interval of depth lcp[r]."""
    depths = lcp.tolist()
    left, right = [0] * len(depths), [len(depths)] * len(depths)
    open_: list[int] = []
    for r, depth in enumerate(depths):
        while open_ and depths[open_[-1]] > depth:
            right[open_.pop()] = r
        if open_:
            left[r] = open_[-1]
        open_.append(r)
    return np.array(left), np.array(right)


def branching_squares(order, lcp, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching squares whose period is at most ``longest`` of the suffix's document."""
    left, right = child_bounds(lcp)
    isa = np.empty_like(order)
    isa[order] = np.arange(len(order))
    splits = np.flatnonzero((lcp >= 1) & (lcp <= longest[order]))
    low, high = left[splits], right[splits]
    by_left = splits - low <= high - splits
    first, last = np.where(by_left, low, splits), np.where(by_left, splits, high)
    other_low, other_high = np.where(by_left, splits, low), np.where(by_left, high, splits)
    sizes = last - first
    starts, periods = [], []
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(CELLS, int(sizes.sum()) + CELLS, CELLS))
    for x, y in zip(np.concatenate(([0], cuts[:-1] + 1)), np.minimum(cuts + 1, len(splits))):
        part = slice(int(x), int(y))
        size = sizes[part]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        suffix = order[np.repeat(first[part], size) + within]
        period = np.repeat(lcp[splits[part]], size)
        a, b = np.repeat(other_low[part], size), np.repeat(other_high[part], size)
        after = isa[suffix + period]
        hit = (after >= a) & (after < b)
        starts.append(suffix[hit])
        periods.append(period[hit])
        before = suffix - period
        place = isa[np.maximum(before, 0)]
        hit = (before >= 0) & (place >= a) & (place < b)
        starts.append(before[hit])
        periods.append(period[hit])
    return np.concatenate([np.empty(0, np.int64), *starts]), np.concatenate([np.empty(0, np.int64), *periods])


def rotations(words: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words each square can be rotated to the left."""
    place, todo, width = start.copy(), np.arange(len(start)), 8
    while todo.size:
        width = max(1, min(width, CELLS // len(todo)))
        at = place[todo, None] - np.arange(1, width + 1)
        same = (at >= 0) & (words[at] == words[at + period[todo, None]])
        whole = same.all(axis=1)
        place[todo] -= np.where(whole, width, np.argmin(same, axis=1))
        todo = todo[whole]
        width *= 2
    return start - place


def merged(words: np.ndarray, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the runs that the squares belong to.

    A square inside the run of a smaller period with the same end repeats that run, so it is left out; a position ends
    few other runs.
    """
    by = np.lexsort((period, start + 2 * period))
    start, period = start[by], period[by]
    end = start + 2 * period
    out = []
    while start.size:
        first = np.ones(len(end), bool)
        first[1:] = end[1:] != end[:-1]
        low = start[first] - rotations(words, start[first], period[first])
        out.append((low, end[first], period[first]))
        rest = ~first & (start < low[np.cumsum(first) - 1])
        start, period, end = start[rest], period[rest], end[rest]
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def runs_of(texts: list[list[bytes]], least_length: int, least_exponent: int):
    """For word lists: row number, start, length and period of each run (by row, start, period), and the repeated words.

    The last item is a flag for each word of all lists: a run contains it after its first period.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = pd.factorize(np.array([w for words in texts for w in words], dtype=object))[0]
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    rows = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.empty(bounds[-1], np.int64)
    ends = bounds[1:] - 1
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = codes
    words[ends] = -1 - np.arange(len(texts))
    order, levels = suffix_array(rows * (len(codes) + 2) + np.where(inside, words + 1, 0))
    longest = (sizes // max(2, least_exponent))[rows]
    low, high, period = merged(words, *branching_squares(order, lcp_array(order, levels), longest))
    long = high - low >= np.maximum(least_length, least_exponent * period)
    low, high, period = low[long], high[long], period[long]
    by = np.lexsort((period, low))
    low, high, period = low[by], high[by], period[by]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, low + period, 1)
    np.add.at(change, high, -1)
    repeated = np.cumsum(change[:-1])[inside] > 0
    row = rows[low]
    return row, low - bounds[row], high - low, period, repeated


def _rows(ids: pa.Array, texts: pa.Array, least_length: int, least_exponent: int) -> pa.RecordBatch:
    counts, runs, strongest, collapsed = [], [], [], []

    def close(chunk: list[list[bytes]]) -> None:
        row, start, length, period, repeated = runs_of(chunk, least_length, least_exponent)
        found: list[list[dict]] = [[] for _ in chunk]
        for r, s, n, q in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
            found[r].append({"start": s, "length": n, "period": q})
        at = 0
        for words, mine in zip(chunk, found):
            gone = repeated[at : at + len(words)]
            at += len(words)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if mine else words
            counts.append(len(words))
            runs.append(mine)
            strongest.append(max(mine, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
            collapsed.append(b" ".join(kept).decode("utf-8", "replace"))

    chunk, size = [], 0
    for text in texts:
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if chunk and size + len(words) > CHUNK_WORDS:
            close(chunk)
            chunk, size = [], 0
        chunk.append(words)
        size += len(words) + 1
    close(chunk)
    arrays = [ids, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(strongest, RUN), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "strongest", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period), strongest, collapsed.

    Words are runs without space, tab, LF, VT, FF and CR, compared as they are.  A run has ``least_length`` words and
    ``least_exponent`` periods (2 or more) at least; strongest is the one with the greatest length / period (ties: smallest start, then
    period), null without runs.  collapsed is the text without the words that a run repeats, joined by one space.  Null
    and empty texts have no words, no runs and an empty collapsed text; null ids and repeated rows are rows like others;
    other columns don't matter; no rows give no rows.  The cost of a text of n words is O(n log n) memory and O(n log² n) time at most.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _rows(batch.column(0), batch.column(1), least_length, least_exponent)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN_SQL}>, strongest {RUN_SQL}, collapsed string")


def periodic_tail(text: Column, doc_id: Column) -> Column:
    """The text, or for one id in ten (by CRC-32) its words with the tail from a hashed word on made periodic.

    With g = crc32 // 10 the tail begins at word a = g % n and repeats its first 1 + (n-a) // (3 + g % 8) words; such a
    text's words are joined by one space.  A null id leaves the text as it is.
    """
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return F.when((crc % 10 == 0) & text.rlike(WORD), planted).otherwise(text)
