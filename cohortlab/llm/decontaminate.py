"""Benchmark decontamination by the q-gram lemma in diagonal bands.

Benchmark items are cut into overlapping segments of two lengths: ``fragment`` characters, one every
``stride``, for partial passages, and ``segment`` characters, one every quarter of that, for copies with
more edits (the last of each ends with the item; a shorter item is one segment).  If a
segment of m characters occurs in a text with at most k edits, the two share at least
m - q + 1 - k*q of their character q-grams, and these lie on diagonals (text position
minus segment position) no more than k apart; k is at most (m - q) / q, so that at least
one is shared.  Shared q-grams are counted in overlapping bands of diagonals, first per item, then
in the bands that are left per segment; regions of bands that reach the bound must also hold the
m - 2 - 3*k 3-grams that the lemma asks for (few chance hits do), and what is left is aligned within the band.  No pair
of a text and a segment is looked at unless its q-grams meet.

So any verbatim part of an item of ``fragment`` characters is found wherever it starts (the next segment of
that length is at most half a ``stride`` off, which its edits cover), and any segment with edits up to
its share - a replaced word is some 5 to 8.

The benchmark is the query set: it is taken in blocks of bounded size, each
block's q-gram index is broadcast, and every text is streamed past it whole.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import column, map_frames, materialize, maybe_broadcast, small_batches

SCHEMA = "doc_id long, item_id long, segments long, matched long, edits long, start long, end long"
FOUND = "id long, absent boolean, text_key long, item_id long, segments long, matched long, edits long, start long, end long"


#: Cells that 3-grams are folded into when regions are checked.
CELLS = 4096
#: Characters of texts that a task scans at once (a longer text is one scan): the scan's arrays take some 40 bytes for each.
SCAN_CHARS = 1_000_000


@dataclass(frozen=True)
class LeakParams:
    q: int = 8
    segment: int = 100
    fragment: int = 50
    #: Characters from one fragment to the next: at most twice the edits allowed in one.
    stride: int = 8
    #: Edits allowed in a segment, and in one of up to ``fragment`` characters, as a share of its length.
    edit_share: float = 0.1
    fragment_share: float = 0.08
    #: Shorter items aren't searched for.
    least_chars: int = 12
    #: Characters of benchmark text in one broadcast block.
    block_chars: int = 1_000_000


def normalized(text: str | None) -> str:
    """Lower case, any white space as one space, trimmed."""
    return " ".join(text.lower().split()) if text else ""


def _units(text: str) -> np.ndarray:
    """One byte for each code point; folding can only add shared q-grams, not lose one."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (u ^ (u >> 8) ^ (u >> 16)).astype(np.uint8)


def _grams(units: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams (8 <= q <= 16) of a byte array that has spare bytes behind it."""
    n = len(units) - 16
    first = np.ndarray(n, dtype="<u8", buffer=units, strides=(1,))
    second = np.ndarray(n, dtype="<u8", buffer=units, offset=q - 8, strides=(1,))
    h = first * np.uint64(0x9E3779B97F4A7C15)
    h ^= second * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _cells(units: np.ndarray) -> np.ndarray:
    """A cell of 0..CELLS-1 for the 3-gram at each place of a byte array; sharing a cell can only add 3-grams, not lose one."""
    u = np.concatenate([units, np.zeros(2, np.uint8)]).astype(np.uint32)
    return ((u[:-2] * np.uint32(961) + u[1:-1] * np.uint32(31) + u[2:]) % np.uint32(CELLS)).astype(np.int16)


def segments_of(length: int, size: int, stride: int) -> list[tuple[int, int]]:
    if length <= size:
        return [(0, length)]
    starts = list(range(0, length - size, max(1, stride))) + [length - size]
    return [(s, s + size) for s in starts]


def cuts_of(length: int, params: LeakParams) -> list[tuple[int, int]]:
    return sorted({*segments_of(length, params.segment, params.segment // 4), *segments_of(length, params.fragment, params.stride)})


def _edits(m: int, params: LeakParams) -> int:
    """Edits that a segment of m characters may have by its share."""
    return int((params.fragment_share if m <= params.fragment else params.edit_share) * m)


class GramIndex:
    """Sorted q-grams of a block's items with their postings, and the items' segments."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        self.params = params
        self.items, self.texts, self.budget, self.bound, self.total, self.start = [], [], [], [], [], []
        self.longest, self.item_bound = 0, []
        self.cell_at, cells, behind = [], [], 0
        grams, owner, place, cover, many = [], [], [], [], []
        q = params.q
        for item_id, text in items:
            text = normalized(text)
            if len(text) < max(q, params.least_chars):
                continue
            cuts = cuts_of(len(text), params)
            first, n = len(self.items), len(text) - q + 1
            over = [[] for _ in range(n)]  # the segments that hold the gram at each place
            for a, b in cuts:
                k = max(0, min(_edits(b - a, params), (b - a - q) // q))
                for x in range(a, b - q + 1):
                    over[x].append(len(self.items))
                self.items.append(item_id)
                self.texts.append(text[a:b])
                self.budget.append(k)
                self.bound.append(b - a - q + 1 - k * q)
                self.total.append(len(cuts))
                self.start.append(a)
                self.cell_at.append(behind + a)
            units = _units(text)
            cells.append(_cells(units))
            behind += len(units)
            grams.append(_grams(np.concatenate([units, np.zeros(16, np.uint8)]), q)[:n])
            owner.append(np.full(n, len(self.item_bound)))
            place.append(np.arange(n))
            many += map(len, over)
            cover += [x for segs in over for x in segs]
            self.item_bound.append(min(self.bound[first:]))
            self.longest = max(self.longest, len(text))
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        many = np.array(many, dtype=np.int64)
        self.cover, self.cover_many, self.cover_first = np.array(cover, dtype=np.int64), many[order], (np.cumsum(many) - many)[order]
        self.grams, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = int(min(26, max(16, np.ceil(np.log2(len(self.grams) + 1)) + 6)))
        self.width = max([1, *self.budget]) + 1
        self.bound, self.start = np.array(self.bound, dtype=np.int64), np.array(self.start, dtype=np.int64)
        self.item_bound = np.array(self.item_bound, dtype=np.int64)
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget, self.cell_at = np.array(self.budget, dtype=np.int64), np.array(self.cell_at, dtype=np.int64)
        self.cells = np.concatenate(cells) if cells else np.zeros(0, np.int16)

    def lookup_table(self) -> np.ndarray:
        seen = np.zeros(1 << self.bits, dtype=bool)
        seen[self.grams >> np.uint64(64 - self.bits)] = True
        return seen


def _alignments(segs: list[str], regions: list[str], budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each segment against any part of its region, and where that part ends.

    All candidates advance together, one segment character a step; a region is
    no wider than the segment plus the band, so only cells in the band exist.
    """
    n, rows, cols = len(segs), max(map(len, segs)), max(map(len, regions))
    big = np.int32(1 << 20)
    s = np.zeros((n, rows), dtype=np.uint32)
    r = np.full((n, cols), 0xFFFFFFFF, dtype=np.uint32)
    for i, (x, y) in enumerate(zip(segs, regions, strict=True)):
        s[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        r[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths, widths = np.array([len(x) for x in segs]), np.array([len(y) for y in regions])
    step = np.arange(cols + 1, dtype=np.int32)
    row = np.zeros((n, cols + 1), dtype=np.int32)
    least, at = np.full(n, big), np.zeros(n, dtype=np.int64)
    for j in range(rows):
        new = np.empty_like(row)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (r != s[:, j : j + 1]))
        row = np.minimum.accumulate(new - step, axis=1) + step
        done = lengths == j + 1
        if done.any():
            last = np.where(step[None, :] <= widths[done][:, None], row[done], big)
            least[done], at[done] = last.min(axis=1), last.argmin(axis=1)
    return least, at


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as given."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _hold(index: GramIndex, segment: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which regions hold as many of their segment's 3-grams as a copy within its budget must."""
    out = np.zeros(len(segment), dtype=bool)
    rows = np.arange(512)[:, None]
    for i in range(0, len(segment), 512):
        o, a, z = segment[i : i + 512], low[i : i + 512, None], high[i : i + 512, None]
        n, wide = len(o), int((z - a).max())
        # one column behind the cells takes what lies outside a region, another is never set
        here = np.zeros((n, CELLS + 2), dtype=bool)
        at = a + np.arange(wide)
        here[rows[:n], np.where(at < z, cells[np.minimum(at, len(cells) - 1)], CELLS)] = True
        step = np.arange(int(index.size[o].max()) - 2)
        inside = step < index.size[o][:, None] - 2
        mine = index.cells[np.minimum(index.cell_at[o][:, None] + step, len(index.cells) - 1)]
        shared = here[rows[:n], np.where(inside, mine, CELLS + 1)].sum(axis=1)
        out[i : i + 512] = shared >= index.size[o] - 2 - 3 * index.budget[o]
    return out


def _find(index: GramIndex, seen: np.ndarray, ids: list, texts: list[str]) -> list[tuple]:
    q, gap = index.params.q, 4 * index.width + 16
    parts, starts, at = [], [], 0
    for t in texts:
        u = _units(t)
        starts.append(at)
        parts += [u, np.zeros(gap, np.uint8)]
        at += len(u) + gap
    starts = np.array(starts, dtype=np.int64)
    units = np.concatenate([*parts, np.zeros(16, np.uint8)])
    grams = _grams(units, q)
    where = np.flatnonzero(seen[grams >> np.uint64(64 - index.bits)])
    which = np.searchsorted(index.grams, grams[where])
    which[which == len(index.grams)] = 0
    hit = index.grams[which] == grams[where]
    where, which = where[hit], which[hit]
    if not len(where):
        return []
    many = index.many[which]
    posting = _runs(index.first[which], many)
    width, base = index.width, index.longest + 2 * index.width
    owner, diagonal = index.owner[posting], np.repeat(where, many) - index.place[posting] + base
    span = (at + base) // width + 4
    # a band holds two strips of diagonals, so bands overlap by one strip
    strip = owner * span + diagonal // width
    strips, place, counts = np.unique(strip, return_inverse=True, return_counts=True)
    joined = counts.copy()  # of a strip and the next one
    joined[:-1] += np.where(strips[1:] == strips[:-1] + 1, counts[1:], 0)
    good = joined >= index.item_bound[strips // span]
    second = np.zeros_like(good)
    second[1:] = good[:-1] & (strips[1:] == strips[:-1] + 1)
    keys, hits = [], []
    for keep, back in ((good, 0), (second, 1)):
        mine = np.flatnonzero(keep[place])
        keys.append(strip[mine] - back)
        hits.append(posting[mine])
    band, posting = np.concatenate(keys) % span, np.concatenate(hits)
    many = index.cover_many[posting]
    segment = index.cover[_runs(index.cover_first[posting], many)]
    key = segment * span + np.repeat(band, many)
    keys, counts = np.unique(key, return_counts=True)
    owner, band = keys // span, keys % span
    good = counts >= index.bound[owner]
    owner, low = owner[good], band[good] * width - base + index.start[owner[good]]
    docs = np.maximum(np.searchsorted(starts, np.maximum(low + 3 * width, 0), side="right") - 1, 0)
    low, k = low - starts[docs], index.budget[owner]
    first, last = np.maximum(low - k, 0), np.maximum(low, 0) + 2 * width + index.size[owner] + k
    held = _hold(index, owner, _cells(units), starts[docs] + first, starts[docs] + last)
    found = [
        (d, o, a, texts[d][a:z])
        for d, o, a, z in zip(docs[held].tolist(), owner[held].tolist(), first[held].tolist(), last[held].tolist(), strict=True)
    ]
    if not found:
        return []
    exact = [(d, o, a + r.find(index.texts[o]), 0, len(index.texts[o])) for d, o, a, r in found if index.texts[o] in r]
    known = {(d, o) for d, o, *_ in exact}
    rest = sorted((x for x in found if (x[0], x[1]) not in known), key=lambda x: len(index.texts[x[1]]))
    for i in range(0, len(rest), 256):
        chunk = rest[i : i + 256]
        k = np.array([index.budget[o] for _, o, _, _ in chunk])
        least, end = _alignments([index.texts[o] for _, o, _, _ in chunk], [r for *_, r in chunk], k)
        for (d, o, a, _), e, z, limit in zip(chunk, least.tolist(), end.tolist(), k.tolist(), strict=True):
            if e <= limit:
                size = len(index.texts[o])
                exact.append((d, o, max(0, a + z - size), e, size))
    best: dict[tuple, tuple] = {}
    for d, o, a, e, size in exact:
        if (d, o) not in best or (e, a) < best[d, o][:2]:
            best[d, o] = (e, a, size)
    rows: dict[tuple, list] = {}
    for (d, o), (e, a, size) in best.items():
        r = rows.setdefault((d, index.items[o]), [index.total[o], 0, 0, a, a + size])
        r[1] += 1
        r[2] += e
        r[3], r[4] = min(r[3], a), max(r[4], a + size)
    return [(ids[d], item, *r) for (d, item), r in sorted(rows.items(), key=lambda x: (x[0][0], x[0][1]))]


def _scanner(parts):
    """``parts``: the broadcast attributes of a GramIndex."""
    state: list = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame | None:
        if not state:
            index = GramIndex.__new__(GramIndex)
            index.__dict__.update(parts.value, params=LeakParams(**parts.value["params"]))
            state.extend((index, index.lookup_table()))
        keys = list(zip(pdf["id"].tolist(), pdf["absent"].tolist(), pdf["text_key"].tolist()))
        rows, first, texts, held = [], 0, [], 0
        for at, t in enumerate(pdf["text"], 1):
            texts.append(normalized(t))
            held += len(texts[-1])
            if held >= SCAN_CHARS or at == len(keys):
                rows += [(*keys[d], *rest) for d, *rest in _find(*state, range(first, at), texts)]
                first, texts, held = at, [], 0
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]) if rows else None

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """Per document row and benchmark item found in it: doc_id, item_id, segments of the item, those
    matched, their edits in sum (segments overlap), start and end (in the normalized text).

    Null and empty texts match nothing; items under least_chars or q characters (after normalizing), null
    items and rows with a null item_id aren't searched for; repeated items or rows give
    repeated results.  Rows with a null doc_id are searched like others and reported with a null.
    Empty tables give an empty result.  Other columns are ignored.
    """
    found = _found(docs, benchmark, params)
    return found.select(F.when(~F.col("absent"), F.col("id")).alias("doc_id"), *(c.split()[0] for c in SCHEMA.split(", ")[1:]))


def _found(docs: DataFrame, benchmark: DataFrame, params: LeakParams) -> DataFrame:
    """The leaks with the keys of their rows: id (0 where absent), absent and a hash of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    key = column("doc_id").cast("long")
    texts = docs.where(column("text").isNotNull()).select(
        F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("absent"), F.xxhash64(column("text")).alias("text_key"), column("text").alias("text")
    )
    items = benchmark.select(column("item_id").cast("long").alias("item_id"), column("text").alias("text")).where(
        "item_id is not null and text is not null"
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // params.block_chars)
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        block = mine.dropDuplicates().toPandas().sort_values(["item_id", "text"])
        index = GramIndex(list(zip(block["item_id"].tolist(), block["text"], strict=True)), params)
        if len(index.grams):
            parts = spark.sparkContext.broadcast({**index.__dict__, "params": asdict(params)})
            out = out.unionByName(map_frames(texts, _scanner(parts), FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns unchanged.

    A row goes by its id (or its lack of one) and its text, so null ids are cleaned like others.
    """
    found = materialize(_found(docs, benchmark, params).select("id", "absent", "text_key").distinct(), "leaks")
    key = column("doc_id").cast("long")
    on = (F.coalesce(key, F.lit(0)) == F.col("id")) & (key.isNull() == F.col("absent")) & (F.xxhash64(column("text")) == F.col("text_key"))
    return docs.join(maybe_broadcast(found, found.count()), on, "left_anti")  # few rows hold a leak: the texts stay where they are
