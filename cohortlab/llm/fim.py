"""Fill-in-middle transformation by displacement scatter.

A text is cut into tokens (white space before a word belongs to it; white space at the end is a token of
its own).  Two hashed cuts give prefix, middle and suffix, which are written behind sentinels in the order
suffix-prefix-middle or prefix-suffix-middle.

The texts of an Arrow batch are one array of UTF-8 bytes.  Every part of a text moves by one distance, so a
difference array holds the change of distance where a part begins; its cumulative sum is the shift of
every byte, and one scatter writes all outputs.  ``restore`` reads the cuts back from the sentinels and gathers
the bytes by the inverse shifts.  Sums are taken slice by slice, so memory beyond the texts is bounded by
``SLICE_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlab.llm.common import column, small_batches

SLICE_BYTES = 1 << 20
SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
WIDTH = 3


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the place where each one begins (and the last one ends)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_array(flat: np.ndarray, bounds: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    texts = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers).cast(pa.string())
    return texts if null is None or not null.any() else pa.compute.if_else(pa.array(null), None, texts)


def sentinel_places(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a sentinel begins that lies within one text, and that text's number."""
    middle = flat[1:-1]
    hit = (flat[:-2] == 60) & (flat[2:] == 62) & ((middle == 80) | (middle == 83) | (middle == 77))
    places = np.flatnonzero(hit)
    rows = np.searchsorted(bounds, places, "right") - 1
    inside = places + WIDTH <= bounds[rows + 1]
    return places[inside], rows[inside]


class Tokens:
    """Token ends of all texts; ``cut`` gives the place behind the first k tokens of each."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        last = bounds[1:][np.diff(bounds) > 0] - 1
        ends = ~space
        ends[:-1] &= space[1:]
        ends[last] = ~space[last]
        self.word_ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.word_ends, bounds[:-1], "right")
        self.words = np.searchsorted(self.word_ends, bounds[1:], "right") - self.first
        blank_end = np.zeros(len(bounds) - 1, bool)
        blank_end[np.diff(bounds) > 0] = space[last]
        self.n = self.words + blank_end
        self.bounds = bounds

    def cut(self, k: np.ndarray) -> np.ndarray:
        place = np.where(k > self.words, self.bounds[1:], self.bounds[:-1])
        within = (k > 0) & (k <= self.words)
        place[within] = self.word_ends[self.first[within] + k[within] - 1]
        return place


def shifted(places: np.ndarray, shifts: np.ndarray, total: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, target of each byte low..high): from ``places`` on (ascending), bytes move by ``shifts``.

    The difference array of a slice holds the changes of shift that begin in it; what came before is carried over.
    """
    changes = np.diff(shifts, prepend=0)
    carried = 0
    for low in range(0, total, SLICE_BYTES):
        high = min(low + SLICE_BYTES, total)
        a, b = np.searchsorted(places, (low, high))
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, places[a:b] - low, changes[a:b])
        moved = np.cumsum(difference) + carried
        carried = int(moved[-1])
        yield low, high, moved + np.arange(low, high)


def scatter(flat, bounds, a, b, plain, spm) -> tuple[np.ndarray, np.ndarray]:
    """All outputs end to end and their bounds; a and b are the places of the two cuts."""
    start, end = bounds[:-1], bounds[1:]
    out_bounds = np.concatenate(([0], np.cumsum(end - start + np.where(plain, 0, 3 * WIDTH))))
    base = out_bounds[:-1] - start
    head, tail = a - start, end - b
    prefix = np.where(spm, base + 2 * WIDTH + tail, base + WIDTH)
    middle = base + 3 * WIDTH + tail
    suffix = np.where(spm, base + WIDTH - (b - start), base + 2 * WIDTH - (b - a))
    places = np.stack((start, a, b), 1).ravel()
    shifts = np.where(plain, base, np.stack((prefix, middle, suffix))).T.ravel()
    out = np.empty(out_bounds[-1], np.uint8)
    for low, high, target in shifted(places, shifts, len(flat)):
        out[target] = flat[low:high]
    at = out_bounds[:-1]
    second = at + WIDTH + np.where(spm, tail, head)
    third = at + 2 * WIDTH + tail + head
    for rows, places in ((~plain & spm, {"S": at, "P": second, "M": third}), (~plain & ~spm, {"P": at, "S": second, "M": third})):
        for name, place in places.items():
            out[place[rows][:, None] + np.arange(WIDTH)] = np.frombuffer(SENTINELS[name], np.uint8)
    return out, out_bounds


def gather(out, bounds, plain, spm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind the outputs, their bounds, and which outputs don't hold the sentinels of their form."""
    start, end = bounds[:-1], bounds[1:]
    places, rows = sentinel_places(out, bounds)
    count = np.bincount(rows, minlength=len(start))
    first = np.searchsorted(rows, np.arange(len(start)))
    found = np.tile(start, (3, 1))
    broken = ~plain & (count != 3)
    cut = np.flatnonzero(~plain & ~broken)
    for k in range(3):
        found[k, cut] = places[first[cut] + k]
    letters = out[found[:, cut] + 1]
    wanted = np.where(spm[cut], np.array([[83], [80], [77]]), np.array([[80], [83], [77]]))
    broken[cut[((letters != wanted) | (found[:1, cut] != start[cut])).any(axis=0)]] = True
    kept = plain & ~broken
    one, two, three = found
    part = {0: (one + WIDTH, two - one - WIDTH), 1: (two + WIDTH, three - two - WIDTH)}
    size = np.where(broken, 0, np.where(kept, end - start, end - start - 3 * WIDTH))
    text_bounds = np.concatenate(([0], np.cumsum(size)))
    prefix, head = np.where(spm, part[1][0], part[0][0]), np.where(spm, part[1][1], part[0][1])
    suffix, tail = np.where(spm, part[0][0], part[1][0]), np.where(spm, part[0][1], part[1][1])
    whole = kept | broken
    at = text_bounds[:-1]
    a = np.where(whole, at, at + head)
    b = np.where(whole, at, text_bounds[1:] - tail)
    places = np.stack((at, a, b), 1).ravel()
    shifts = np.where(whole, start - at, np.stack((prefix - at, three + WIDTH - a, suffix - b))).T.ravel()
    text = np.empty(text_bounds[-1], np.uint8)
    for low, high, source in shifted(places, shifts, len(text)):
        text[low:high] = out[source]
    return text, text_bounds, broken


def transform(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of those become suffix-prefix-middle.  The draws hash
    ``seed:doc_id``, so they don't depend on order or partitioning; rows with one id get the same draws, a null id
    counts as an empty string.  Null, empty and drawn texts, and texts that hold a sentinel, stay as they are (form
    plain, null lengths; a null text gives an empty output).  Other columns don't matter; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        column(doc_id).alias("doc_id"),
        F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("key"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, bounds = flat_bytes(batch.column(2))
            tokens = Tokens(flat, bounds)
            draws = b"".join(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16] for key in batch.column(1).to_pylist())
            h1, h2, h3, h4 = np.frombuffer(draws, ">u4").astype(np.int64).reshape(-1, 4).T
            plain = (np.diff(bounds) == 0) | (h3 % 100 >= rate)
            plain[sentinel_places(flat, bounds)[1]] = True
            spm = ~plain & (h4 % 100 < spm_rate)
            k1, k2 = h1 % (tokens.n + 1), h2 % (tokens.n + 1)
            a, b = tokens.cut(np.minimum(k1, k2)), tokens.cut(np.maximum(k1, k2))
            out, out_bounds = scatter(flat, bounds, a, b, plain, spm)
            begins = (flat & 0xC0) != 0x80
            chars = [
                pa.array([None if p else int(np.count_nonzero(begins[x:y])) for p, x, y in zip(plain, low, high)], pa.int64())
                for low, high in ((bounds[:-1], a), (a, b))
            ]
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
            arrays = [batch.column(0), pa.array(tokens.n, pa.int64()), form, *chars, text_array(out, out_bounds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(cut: DataFrame) -> DataFrame:
    """The rows of ``cut`` (columns form and output, any others) with the column ``restored``: the text behind each output.

    Only output and form are read.  An output that doesn't hold the three sentinels of its form in their order gives
    null, and so does a null output or form.  An old column of that name is replaced.
    """
    small_batches(cut.sparkSession)
    others = [c for c in cut.columns if c.lower() != "restored"]
    form_at, output_at = others.index("form"), others.index("output")
    rows = cut.select(*map(column, others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            form = np.array(batch.column(form_at).to_pylist(), dtype=object)
            out, bounds = flat_bytes(batch.column(output_at).fill_null(""))
            known = np.isin(form, ["plain", "spm", "psm"]) & ~batch.column(output_at).is_null().to_numpy(zero_copy_only=False)
            text, text_bounds, broken = gather(out, bounds, (form == "plain") | ~known, known & (form == "spm"))
            yield pa.RecordBatch.from_arrays([*batch.columns, text_array(text, text_bounds, broken | ~known)], [*others, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))
