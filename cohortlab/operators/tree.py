"""Exact decision tree on a 0/1 label as a relation: its growth, depth curve, paths and scoring.

Splits are exact: every midpoint between neighbouring distinct values of every feature is a candidate, on any table size.
A node's best split maximises sl²/nl + sr²/nr (s: rows of class 1, n: rows), which is the greatest decrease of the Gini
impurity; ties go to the first feature, then to the smallest threshold.  A node is split until it is pure or all its features are
constant (or ``max_depth`` is reached).

Growth has two phases with one result.  Nodes of more than ``local_rows`` training rows are split level by level in Spark: counts
for each (node, feature, bin of values), then for each value in the bins that may hold the best split (see :func:`_best_cuts`), so a
level shuffles counts and few values, not the table.  Smaller nodes are grown to their leaves in one task each, so a group is bounded by ``local_rows``.
The driver holds the nodes of the first phase (some for each ``local_rows`` rows); rows walk through them from the node that they are stored
with, and are stored anew only when half of them have left the large nodes.

Nodes are named by their path from the root: one character a level, 0 (left, value <= threshold) or 1.  So a node's
depth is its length and its ancestors are its prefixes; the node table is a DataFrame.  Rows are scored by the nodes of the first phase and
then by the subtree they reach, whose nodes they meet in one shuffle; a tree of few nodes is sent to all tasks instead.

Null and NaN features count as +infinity: they go right of every threshold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortlab.session import scratch_path

LOCAL_ROWS = 400_000
BINS = 4096
EDGE_ROWS = 200_000
COARSE_ROWS = 500_000  # nodes of fewer rows, of which there are many, have BINS >> COARSE_BITS bins
COARSE_BITS = 2
SLOTS = 16  # nodes whose bins a task holds at once
TABLE = 1 << 26  # entries of the table of bins that are counted by value
CHUNK = 50_000  # rows that numpy takes at once
PIECE = 1_000  # rows stored as one; few enough for several row groups in a file
ROW_GROUP = 1 << 24  # bytes; files are read in parts of this size
BLOCK = 8
SHARED_NODES = 300_000  # a tree of so many nodes goes to all tasks that score rows
NODES = "node string, n long, s long, feature int, threshold double, decrease double, sub int, at int, child int, other int"


@dataclass
class TreeFit:
    """``nodes``: (node, n, s, feature, threshold, decrease, depth, is_leaf, p); ``steps``: (sub, at, child, other, feature, threshold, p, node),
    the nodes of the subtrees below ``top``, with their and their children's places there; ``size``: the number of nodes."""

    nodes: DataFrame
    steps: DataFrame
    top: "_Top"
    features: list[str]
    depth: int
    size: int

    @cached_property
    def blocks(self) -> DataFrame:
        return _cut(_blocks(self.nodes), "tree-blocks")


def _cut(df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(df.sparkSession, kind)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(x)


def _vector(features: Sequence[str]) -> Column:
    return F.array(*map(_value, features))


def _columns(features: Sequence[str]) -> list[Column]:
    return [_value(c).alias(f"_x{k}") for k, c in enumerate(features)]


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind: type = np.float64) -> np.ndarray:
    """All values of a column of bytes, ``width`` in a row."""
    _, ends, data = batch.column(name).buffers()
    at = batch.column(name).offset
    first, last = np.frombuffer(ends, np.int32)[[at, at + batch.num_rows]]
    return np.frombuffer(data, kind, (last - first) // np.dtype(kind).itemsize, first).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, *more: str) -> Iterator[tuple[np.ndarray, ...]]:
    """``node``, ``x``, ``y`` (and ``b``) of up to CHUNK rows at once, of batches of stored pieces."""
    for batch in batches:
        if batch.num_rows:
            node = np.repeat(batch.column("node").to_numpy(), batch.column("n").to_numpy())
            parts = (node, _matrix(batch, "x", width), _matrix(batch, "y", 1, np.int64)[:, 0], *(_matrix(batch, c, width, np.uint16) for c in more))
            for j in range(0, len(node), CHUNK):
                yield tuple(v[j : j + CHUNK] for v in parts)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same of rows with arrays, with the nodes' names."""
    for batch in batches:
        if batch.num_rows:
            x, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "b"))
            yield batch.column("node").dictionary_encode(), x, batch.column("y").to_numpy(), b


def _gathered(parts: Iterable[tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Pieces of up to PIECE rows of one key each, of parts (keys, arrays)."""
    held: dict[int, list] = {}
    n = 0

    def found():
        for key in sorted(held):
            arrays = [np.concatenate(c) for c in zip(*held[key])]
            for j in range(0, len(arrays[0]), PIECE):
                yield key, [v[j : j + PIECE] for v in arrays]
        held.clear()

    for keys, arrays in parts:
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.diff(keys[order], prepend=-1))
        for a, e in zip(at, [*at[1:], len(keys)]):
            held.setdefault(int(keys[order[a]]), []).append([v[order[a:e]] for v in arrays])
        n += len(keys)
        if n >= 4 * CHUNK:
            yield from found()
            n = 0
    yield from found()


def _blob(v: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())


def _beside(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The columns _x0, _x1, ... as a matrix."""
    return np.column_stack([batch.column(f"_x{k}").to_numpy(zero_copy_only=False) for k in range(width)])


def _bytes(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


@contextmanager
def _even_tasks(spark):
    """Reads are split into four tasks a core, so the last ones don't wait for a single file."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass
class _Top:
    """The nodes that are split in Spark, and their children; ``left`` of a node that isn't split there is -1, the right child follows the left."""

    name: list[str] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    s: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    sub: list[int] = field(default_factory=list)  # the node as a subtree's root, or -1

    def add(self, name: str, n: int, s: int) -> int:
        for column, value in zip((self.name, self.n, self.s, self.left, self.feature, self.threshold, self.gain, self.sub), (name, n, s, -1, -1, np.nan, np.nan, -1)):
            column.append(value)
        return len(self.name) - 1


class _Route:
    """The way from a stored node to the one of ``wanted`` that a row reaches by now; rows that reach ``ends`` go no further."""

    def __init__(self, top: _Top, wanted: Sequence[int], ends: Iterable[int] = ()):
        self.left, self.feature, self.threshold = (np.array(c) for c in (top.left, top.feature, top.threshold))
        self.left[list(ends)] = -1
        self.slot = np.full(len(self.left), -1)
        self.slot[list(wanted)] = np.arange(len(wanted))
        self.names = [top.name[i] for i in wanted]
        self.shift = np.array([COARSE_BITS if top.n[i] < COARSE_ROWS else 0 for i in wanted], np.int64)

    def nodes(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        node = node.copy()
        at = np.flatnonzero(self.left[node] >= 0)
        while len(at):
            here = node[at]
            node[at] = self.left[here] + ~(x[at, self.feature[here]] <= self.threshold[here])
            at = at[self.left[node[at]] >= 0]
        return node

    def reached(self, pieces: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """The slots and (y, x, ...) of the rows that reach a wanted node."""
        for node, x, y, *more in pieces:
            slot = self.slot[self.nodes(x, node)]
            mine = np.flatnonzero(slot >= 0)
            if len(mine):
                yield slot[mine], tuple(v[mine] for v in (y, x, *more))


def _packed(rows: DataFrame, width: int, edges: list[np.ndarray] | None = None) -> DataFrame:
    """``rows`` (_x0.., y) as pieces (node, n, y, x): the bytes of some rows' values, all at node 0, and of their bins ``b``, if there are edges."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _beside(batch, width), batch.column("y").to_numpy()
                b = None if edges is None else np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]).astype(np.uint16)
                for j in range(0, len(x), PIECE):
                    more = {} if b is None else {"b": _blob(b[j : j + PIECE])}
                    yield _batch(node=np.zeros(1, np.int32), n=[len(x[j : j + PIECE])], y=_blob(y[j : j + PIECE]), x=_blob(x[j : j + PIECE]), **more)

    return rows.mapInArrow(pack, "node int, n long, y binary, x binary" + ("" if edges is None else ", b binary"))


def _binned(rows: DataFrame, width: int, n: int) -> DataFrame:
    """The packed rows with the bin of each feature's value, written.

    The bins' bounds are quantiles of some rows, as in Spark's own range partitioning: they steer the search and don't change what it finds,
    which holds for any bins that keep the order of the values.
    """
    some = rows.sample(min(1.0, EDGE_ROWS / n), seed=1) if n > EDGE_ROWS else rows
    found = [np.frombuffer(r["x"], float).reshape(-1, width) for r in _packed(some, width).select("x").collect()]
    found = np.sort(np.concatenate(found) if found else np.zeros((0, width)), axis=0)
    at = np.arange(1, BINS) * len(found) // BINS if len(found) else []
    return _cut(_packed(rows, width, [np.unique(found[at, f]) for f in range(width)]), "tree-rows")


def _bin_counts(rows: DataFrame, route: _Route | None = None, width: int = 0) -> DataFrame:
    """``(node, f, b, n, s, low, high)`` of ``rows`` (node, y, x, b): a task adds its rows to the bins of up to SLOTS nodes.

    With a ``route``, pieces (node, n, y, x, b) count for the wanted nodes that their rows reach.
    """
    bins, slots = BINS, SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        n = s = low = high = None
        across = width

        def found() -> Iterator[pa.RecordBatch]:
            for name, slot in held.items():
                for f in range(across):
                    here = (slot * across + f) * bins + np.arange(bins)
                    here = here[n[here] > 0]
                    if len(here):
                        parts = {"b": here % bins, "n": n[here], "s": s[here], "low": low[here], "high": high[here]}
                        yield _batch(node=[name], f=np.array([f], np.int32), **{c: pa.array([v.astype(float if c in ("low", "high") else np.int64).tobytes()], pa.binary()) for c, v in parts.items()})

        for node, x, y, b in _flat(batches) if route is None else _pieces(batches, width, "b"):
            across = x.shape[1]
            if route is None:
                names, code = node.dictionary.to_pylist(), node.indices.to_numpy()
            else:
                code = route.slot[route.nodes(x, node)]
                mine = code >= 0
                x, b, y, code = x[mine], b[mine], y[mine], code[mine]
                b = b >> route.shift[code][:, None]
                some, code = np.unique(code, return_inverse=True)
                names = [route.names[k] for k in some]
            for k in range(0, len(names), slots):
                some = names[k : k + slots]
                if held and len(held.keys() | set(some)) > slots:
                    yield from found()
                    held.clear()
                if not held:
                    n, s = np.zeros((2, slots * across * bins), np.int64)
                    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
                place = np.full(len(names), -1)
                place[k : k + slots] = [held.setdefault(name, len(held)) for name in some]
                slot = place[code]
                mine = slot >= 0
                at = ((slot[mine, None] * across + np.arange(across)) * bins + b[mine]).ravel()
                v = x[mine].ravel()
                np.add.at(n, at, 1)
                np.add.at(s, at, np.repeat(y[mine], across))
                np.minimum.at(low, at, v)
                np.maximum.at(high, at, v)
        yield from found()

    def add(table: pa.Table) -> pa.Table:
        n, s = np.zeros((2, bins), np.int64)
        low, high = np.full(bins, np.inf), np.full(bins, -np.inf)
        for r in table.select(["b", "n", "s", "low", "high"]).to_pylist():
            b = np.frombuffer(r["b"], np.int64)
            n[b] += np.frombuffer(r["n"], np.int64)
            s[b] += np.frombuffer(r["s"], np.int64)
            low[b] = np.minimum(low[b], np.frombuffer(r["low"]))
            high[b] = np.maximum(high[b], np.frombuffer(r["high"]))
        b = np.flatnonzero(n)
        key = [pa.array([table.column(c)[0].as_py()] * len(b), t) for c, t in (("node", pa.string()), ("f", pa.int32()))]
        return pa.table([*key, pa.array(b.astype(np.int32)), *(pa.array(v[b]) for v in (n, s, low, high))], names=["node", "f", "b", "n", "s", "low", "high"])

    parts = rows.mapInArrow(count, "node string, f int, b binary, n binary, s binary, low binary, high binary")
    return parts.groupBy("node", "f").applyInArrow(add, "node string, f int, b int, n long, s long, low double, high double")


def _gain(nl, sl, n, s):
    """sl²/nl + sr²/nr; an empty side adds nothing."""
    nl, sl, sr = nl.astype(float), sl.astype(float), (s - sl).astype(float)
    nr = n - nl
    return np.divide(sl * sl, nl, out=np.zeros(len(nl)), where=nl > 0) + np.divide(sr * sr, nr, out=np.zeros(len(nl)), where=nr > 0)


def _search(table: pa.Table) -> pa.Table:
    """One node's bins (node, f, b, n, s, low, high) -> its best cut between bins, if any, and the bins that may hold a better one."""
    table = table.sort_by([("f", "ascending"), ("b", "ascending")])
    f, b, n, s, low, high = (table.column(c).to_numpy() for c in ("f", "b", "n", "s", "low", "high"))
    starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    each = np.diff(np.r_[starts, len(f)])
    tn, ts = int(n[: each[0]].sum()), int(s[: each[0]].sum())
    upto, ones = np.cumsum(n) - np.repeat(np.arange(len(starts)) * tn, each), np.cumsum(s) - np.repeat(np.arange(len(starts)) * ts, each)
    bn, bs = upto - n, ones - s
    end = np.flatnonzero(np.r_[f[1:] == f[:-1], False])
    gain = _gain(upto[end], ones[end], tn, ts)
    best = [None] * 6
    least = -np.inf
    if len(end):
        k = int(gain.argmax())  # the first of the greatest: the first feature, then the smallest value
        e, least = end[k], float(gain[k])
        best = [least, int(f[e]), float(high[e]), float(low[e + 1]), int(upto[e]), int(ones[e])]
    bound = np.maximum.reduce([_gain(a, c, tn, ts) for a, c in ((bn, bs), (bn + s, bs + s), (bn + n - s, bs), (bn + n, bs + s))])
    wide = np.flatnonzero((low < high) & (bound * (1 + 1e-9) >= least))
    blobs = [pa.array([v[wide].astype(np.int64).tobytes()], pa.binary()) for v in (f, b, bn, bs)]
    kinds = (pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table([pa.array([table.column("node")[0].as_py()], pa.string()), pa.array([tn]), pa.array([ts]), *(pa.array([v], t) for v, t in zip(best, kinds)), *blobs],
                    names=["node", "n", "s", "gain", "feature", "v", "next", "nl", "sl", "wf", "wb", "wn", "ws"])


def _wide_values(rows: DataFrame, route: _Route, width: int, wide: np.ndarray, before: np.ndarray) -> DataFrame:
    """``(slot, f, b, v, n, s, bn, bs)``: the values in the bins ``wide`` (their numbers, ascending), counted in parts; ``before``: rows and ones before each bin."""
    bins, table = BINS, None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal table
        for node, x, y, b in _pieces(batches, width, "b"):
            slot = route.slot[route.nodes(x, node)]
            mine = np.flatnonzero(slot >= 0)
            slot = slot[mine]
            key = (slot[:, None] * width + np.arange(width)) * bins + (b[mine] >> route.shift[slot][:, None])
            size = len(route.names) * width * bins
            if size <= TABLE:
                if table is None:
                    table = np.zeros(size, bool)
                    table[wide] = True
                i, f = np.nonzero(table[key])
            else:
                i, f = np.nonzero(wide[np.minimum(np.searchsorted(wide, key), len(wide) - 1)] == key)
            if not len(i):
                continue
            key, v, y = key[i, f], x[mine[i], f], y[mine[i]]
            order = np.lexsort((v, key))
            key, v, y = key[order], v[order], y[order]
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])])
            n, s = np.diff(np.r_[at, len(key)]), np.add.reduceat(y, at)
            bn, bs = before[np.searchsorted(wide, key[at])].T
            rest, b = np.divmod(key[at], bins)
            slot, f = np.divmod(rest, width)
            yield _batch(slot=slot.astype(np.int32), f=f.astype(np.int32), b=b.astype(np.int32), v=v[at], n=n, s=s, bn=bn, bs=bs)

    return rows.mapInArrow(count, "slot int, f int, b int, v double, n long, s long, bn long, bs long")


def _best_cuts(rows: DataFrame, route: _Route, width: int) -> dict[str, tuple]:
    """Node -> ``(gain, feature, v, next, nl, sl)`` of the best cut of each wanted node that has one, between the values v and next.

    Cuts between bins are scored from counts for each (node, feature, bin).  The gain is convex in (nl, sl), and the cuts inside a bin lie
    in the parallelogram between its ends, so none gains more than the best corner (all ones of the bin first, or all zeros).
    Only bins whose bound reaches the best cut found so far are counted by value, so the result is that of all cuts.
    """
    schema = ("node string, n long, s long, gain double, feature int, v double, next double, nl long, sl long, "
              "wf binary, wb binary, wn binary, ws binary")
    found = _bin_counts(rows, route, width).groupBy("node").applyInArrow(_search, schema).collect()
    best = {r["node"]: (r["gain"], r["feature"], r["v"], r["next"], r["nl"], r["sl"]) for r in found if r["gain"] is not None}
    slot = {name: k for k, name in enumerate(route.names)}
    keys, before = [], []
    for r in found:
        f, b, bn, bs = (np.frombuffer(r[c], np.int64) for c in ("wf", "wb", "wn", "ws"))
        keys.append((slot[r["node"]] * width + f) * BINS + b)
        before.append(np.column_stack([bn, bs]))
    wide = np.concatenate(keys)
    if not len(wide):
        return best
    order = np.argsort(wide)
    values = _wide_values(rows, route, width, wide[order], np.concatenate(before)[order])
    within = Window.partitionBy("slot", "f", "b").orderBy("v")
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    totals = F.broadcast(rows.sparkSession.createDataFrame([(slot[r["node"]], r["n"], r["s"]) for r in found], "slot int, tn long, ts long"))
    counts = values.groupBy("slot", "f", "b", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.first("bn").alias("bn"), F.first("bs").alias("bs"))
    nl, sl = F.col("nl").cast("double"), F.col("sl").cast("double")
    sr = (F.col("ts") - F.col("sl")).cast("double")
    inner = counts.select("slot", "f", "v", F.lead("v").over(within).alias("next"), (F.col("bn") + F.sum("n").over(up_to)).alias("nl"),
                          (F.col("bs") + F.sum("s").over(up_to)).alias("sl")).where("next IS NOT NULL").join(totals, "slot")
    scored = inner.withColumn("gain", sl * sl / nl + sr * sr / (F.col("tn") - F.col("nl")))
    cut = F.struct("gain", F.col("f").alias("feature"), "v", "next", "nl", "sl")
    for r in scored.groupBy("slot").agg(F.max_by(cut, F.struct("gain", -F.col("f"), -F.col("v"))).alias("c")).collect():
        name, c = route.names[r["slot"]], tuple(r["c"])
        best[name] = max([c, *([best[name]] if name in best else [])], key=lambda c: (c[0], -c[1], -c[2]))
    return best


def _threshold(v, following):
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (v + following) / 2
    return np.where(middle < following, middle, v)


def _grow(X: np.ndarray, y: np.ndarray, root: str, max_depth: int | None) -> Iterator[pa.RecordBatch]:
    """The nodes from ``root``, level by level: (node, n, s, feature, threshold, decrease, at, child, other).

    Each feature keeps the rows in the order of its values within the level's nodes; a level cuts all its nodes at once.
    """
    n, width = X.shape
    code, values, order = np.empty((width, n), np.int32), [], []
    for f in range(width):
        o = np.argsort(X[:, f], kind="stable").astype(np.int32)
        v = X[o, f]
        new = np.r_[True, v[1:] != v[:-1]]
        code[f, o] = np.cumsum(new, dtype=np.int32) - 1
        values.append(v[new])
        order.append(o)
    del X
    y = y.astype(np.int32)
    names, sizes, sums = [root], np.array([n]), np.array([int(y.sum())])
    depth, at = len(root), 0
    while names:
        k = len(names)
        feature, cut, threshold, decrease = np.full(k, -1), np.zeros(k, np.int32), np.full(k, np.nan), np.full(k, np.nan)
        child = np.full(k, -1)
        live = np.flatnonzero((sums > 0) & (sums < sizes)) if max_depth is None or depth < max_depth else np.zeros(0, int)
        # the rows of live nodes only, node after node
        starts = np.cumsum(sizes[live]) - sizes[live]
        best = np.full(len(live), -np.inf)
        seg = np.repeat(np.arange(len(live)), sizes[live])
        ends = starts + sizes[live] - 1
        last = np.zeros(len(seg), bool)
        last[ends] = True
        tn, ts = sizes[live].astype(float), sums[live].astype(float)
        sl0 = np.cumsum(sums[live]) - sums[live]
        for f in range(width if len(live) else 0):
            o = order[f]
            c = code[f, o]
            pos = np.flatnonzero((c[1:] != c[:-1]) & ~last[:-1])
            if not len(pos):
                continue
            g = seg[pos]
            sl = (np.cumsum(y[o])[pos] - sl0[g]).astype(float)
            nl = (pos - starts[g] + 1).astype(float)
            sr = ts[g] - sl
            gain = sl * sl / nl + sr * sr / (tn[g] - nl)
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(g)])))
            hit = hit[np.r_[True, g[hit][1:] != g[hit][:-1]]]  # the smallest threshold of the best
            better = top > best[g[first]]
            w, p = g[first][better], pos[hit[better]]
            best[w] = top[better]
            feature[live[w]], cut[live[w]] = f, c[p]
            threshold[live[w]] = _threshold(values[f][c[p]], values[f][c[p + 1]])
        split = live[feature[live] >= 0]
        decrease[split] = best[feature[live] >= 0] - sums[split].astype(float) * sums[split] / sizes[split]
        child[split] = at + k + np.arange(len(split))  # the left ones of a level come before the right ones
        other = np.where(child < 0, -1, child + len(split))
        leaf = pa.array(feature < 0)
        none = lambda v, t: pc.if_else(leaf, pa.scalar(None, t), pa.array(v, t))
        for j in range(0, k, CHUNK):
            e = min(k, j + CHUNK)
            yield _batch(node=names[j:e], n=sizes[j:e].astype(np.int64), s=sums[j:e].astype(np.int64), feature=none(feature.astype(np.int32), pa.int32())[j:e],
                         threshold=none(threshold, pa.float64())[j:e], decrease=none(decrease, pa.float64())[j:e], at=np.arange(at + j, at + e, dtype=np.int32), child=child[j:e].astype(np.int32), other=other[j:e].astype(np.int32))
        at += k
        if not len(split):
            return
        # rows move to the children; those in pure ones and in nodes without a cut are done
        g = live[seg]
        o = order[0]
        f = feature[g]
        side = np.zeros(n, np.int8)
        side[o] = np.where(f < 0, 2, code[f, o] > cut[g])
        right_n = np.bincount(g[side[o] == 1], minlength=k)[split]
        right_s = np.bincount(g[side[o] == 1], weights=y[o][side[o] == 1], minlength=k)[split].astype(int)
        sizes, sums = np.r_[sizes[split] - right_n, right_n], np.r_[sums[split] - right_s, right_s]
        names = [names[i] + "0" for i in split] + [names[i] + "1" for i in split]
        depth += 1
        pure = (sums == 0) | (sums == sizes)
        place = np.full(k, 0)
        place[split] = np.arange(len(split))
        mine = place[g]
        stop = np.where(side[o] == 1, pure[mine + len(split)], pure[mine]) | (side[o] == 2)
        side[o[stop]] = 2
        for f in range(width):
            s_ = side[order[f]]
            order[f] = np.concatenate([order[f][s_ == 0], order[f][s_ == 1]])


def _dealt(sizes: list[int], cores: int) -> np.ndarray:
    """A task for each group, such that tasks have about as many rows; the greatest groups come first."""
    tasks = max(1, min(len(sizes), max(4 * cores, 2 * sum(sizes) // LOCAL_ROWS)))
    load, task = [(0, k) for k in range(tasks)], np.zeros(len(sizes), np.int32)
    for j in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        n, k = heapq.heappop(load)
        task[j] = k
        heapq.heappush(load, (n + sizes[j], k))
    return task


def _grow_locally(parts: list[tuple[DataFrame, _Route]], width: int, top: _Top, subs: list[int], max_depth: int | None) -> DataFrame:
    """All nodes below (and with) the nodes ``subs``, each grown in one task, the greatest first."""
    spark = parts[0][0].sparkSession
    name = [top.name[i] for i in subs]
    task = _dealt([top.n[i] for i in subs], spark.sparkContext.defaultParallelism)
    moved = None
    for rows, route in parts:

        def deal(batches: Iterator[pa.RecordBatch], route=route) -> Iterator[pa.RecordBatch]:
            for sub, (y, x) in _gathered(route.reached(_pieces(batches, width))):
                yield _batch(task=task[[sub]], sub=np.array([sub], np.int32), y=_blob(y), x=_blob(x))

        part = rows.select("node", "n", "y", "x").mapInArrow(deal, "task int, sub int, y binary, x binary")
        moved = part if moved is None else moved.unionByName(part)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            X, y = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            for batch in _grow(X, y, name[sub], max_depth):
                yield batch.add_column(6, "sub", pa.array(np.full(batch.num_rows, sub, np.int32)))

        for batch in batches:
            ids = batch.column("sub").to_numpy()
            at = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, e in zip(at, at[1:]):
                if a == e:
                    continue
                if held and ids[a] != sub:
                    yield from found()
                sub = int(ids[a])
                part = batch.slice(a, e - a)
                held.append((_matrix(part, "x", width).copy(), _matrix(part, "y", 1, np.int64)[:, 0].copy()))
        if held:
            yield from found()

    return moved.repartitionById(int(task.max()) + 1, F.col("task")).sortWithinPartitions("sub").select("sub", "y", "x").mapInArrow(grow, NODES)


def fit_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int | None = None, local_rows: int = LOCAL_ROWS) -> TreeFit:
    """Fit on ``df`` (already restricted to training rows); rows without a label don't count.  No rows give no nodes."""
    with _even_tasks(df.sparkSession):
        return _fit(df, list(features), label, max_depth, local_rows)


def _fit(df: DataFrame, features: list[str], label: str, max_depth: int | None, local_rows: int) -> TreeFit:
    spark, width = df.sparkSession, len(features)
    rows = df.select(*_columns(features), F.col(label).cast("long").alias("y")).where("y IS NOT NULL")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()[0]
    top, level, depth, subs = _Top(), [], 0, []
    if total["n"]:
        level.append(top.add("", total["n"], total["s"]))
    stored, parts = None, []
    kept = total["n"]
    while True:
        open_ = [i for i in level if 0 < top.s[i] < top.n[i] and (max_depth is None or depth < max_depth)]
        large = [i for i in open_ if top.n[i] > local_rows]
        subs += [i for i in open_ if top.n[i] <= local_rows]
        if not large:
            break
        left = sum(top.n[i] for i in large)
        if stored is None:
            stored = _binned(rows, width, total["n"])
        elif 2 * left < kept:
            parts.append((stored, large))
            stored, kept = _cut(_moved(stored, _Route(top, large), width, large), "tree-rows"), left
        route = _Route(top, large)
        best = _best_cuts(stored, route, width)
        level = []
        for i in large:
            if (c := best.get(top.name[i])) is None:
                continue  # all features are constant
            gain, f, v, following, nl, sl = c
            top.gain[i], top.feature[i], top.threshold[i] = gain, f, float(_threshold(v, following))
            top.left[i] = top.add(top.name[i] + "0", nl, sl)
            level += [top.left[i], top.add(top.name[i] + "1", top.n[i] - nl, top.s[i] - sl)]
        depth += 1
    parts.append((_packed(rows, width) if stored is None else stored, []))
    for k, i in enumerate(subs):
        top.sub[i] = k
    done = [(top.name[i], top.n[i], top.s[i], *((top.feature[i], top.threshold[i], top.gain[i] - float(top.s[i]) * top.s[i] / top.n[i]) if top.left[i] >= 0 else (None, None, None)), -1, -1, -1, -1)
            for i in range(len(top.name)) if top.sub[i] < 0]
    grown = spark.createDataFrame(done, NODES)
    if subs:
        grown = grown.unionByName(_grow_locally([(part, _Route(top, subs, ends)) for part, ends in parts], width, top, subs, max_depth))
    grown = grown.withColumn("depth", F.length("node")).withColumn("is_leaf", F.col("feature").isNull()).withColumn("p", F.col("s") / F.col("n"))
    nodes = _cut(grown, "tree")
    found = nodes.agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("n")).collect()[0]
    steps = nodes.where("sub >= 0").select("sub", "at", "child", "other", "feature", "threshold", "p", "node")
    return TreeFit(nodes.drop("sub", "at", "child", "other"), steps, top, features, found["d"] or 0, found["n"])


def _moved(rows: DataFrame, route: _Route, width: int, wanted: list[int]) -> DataFrame:
    """The rows in the wanted nodes, stored with them; by node, so a task meets few at once."""
    node = np.array(wanted, np.int32)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, (y, x, b) in _gathered(route.reached(_pieces(batches, width, "b"))):
            yield _batch(node=node[[slot]], n=[len(y)], y=_blob(y), x=_blob(x), b=_blob(b))

    return rows.mapInArrow(move, "node int, n long, y binary, x binary, b binary").sortWithinPartitions("node")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``(root, steps)``: for each node at a depth divisible by BLOCK, its subtree of BLOCK levels as a heap-ordered array
    of (feature, threshold, p); at most 2^BLOCK - 1 entries."""
    start = (F.floor(F.col("depth") / BLOCK) * BLOCK).cast("int")
    at = (F.conv(F.concat(F.lit("1"), F.col("node").substr(start + 1, F.lit(BLOCK))), 2, 10).cast("int") - 1).alias("at")
    step = F.struct("feature", "threshold", "p").alias("step")
    parts = nodes.select(F.col("node").substr(F.lit(1), start).alias("root"), at, step)
    found = parts.groupBy("root").agg(F.collect_list(F.struct("at", "step")).alias("list"), F.max("at").alias("top")).withColumn("map", F.map_from_entries("list"))
    return found.select("root", F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.try_element_at(F.col("map"), i)).alias("steps"))


@dataclass
class _Steps:
    """The nodes of subtrees, one subtree after the other."""

    child: np.ndarray
    other: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    p: np.ndarray
    node: pa.Array
    first: np.ndarray  # where each subtree begins

    @classmethod
    def of(cls, table: pa.Table) -> "_Steps":
        """Of rows (sub, at, child, other, feature, threshold, p, node)."""
        table = table.sort_by([("sub", "ascending"), ("at", "ascending")])
        sub = table.column("sub").to_numpy()
        first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]]) if len(sub) else np.zeros(0, int)
        start = np.repeat(first, np.diff(np.r_[first, len(sub)]))
        child, other = (table.column(c).to_numpy() for c in ("child", "other"))
        return cls(np.where(child < 0, -1, child + start), np.where(other < 0, -1, other + start), table.column("feature").fill_null(-1).to_numpy(),
                   table.column("threshold").fill_null(np.nan).to_numpy(), table.column("p").to_numpy(), table.column("node").combine_chunks(), first)

    def leaves(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where the rows ``x`` that start at ``node`` end."""
        at = np.flatnonzero(self.child[node] >= 0)
        while len(at):
            here = node[at]
            node[at] = np.where(x[at, self.feature[here]] <= self.threshold[here], self.child[here], self.other[here])
            at = at[self.child[node[at]] >= 0]
        return node


def _scored(fit: TreeFit, df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    """The columns ``keep`` with ``leaf`` and ``p``, by the nodes of ``top`` and then by those of the subtree that a row reaches."""
    top, width = fit.top, len(fit.features)
    route, sub = _Route(top, ()), np.array(top.sub)
    top_node, top_p = pa.array(top.name), np.array(top.s) / np.array(top.n)
    kept = [f for f in df.select(*keep).schema if f.name not in ("leaf", "p")]
    names = [f.name for f in kept]
    out = StructType([StructField(f.name, f.dataType, True) for f in kept] + [StructField("leaf", StringType()), StructField("p", DoubleType())])
    rows = df.select(*keep).drop("leaf", "p") if not width else df.select(*keep, *_columns(fit.features)).drop("leaf", "p")

    if fit.size <= SHARED_NODES:
        steps = _Steps.of(fit.steps.toArrow())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _beside(batch, width)
                    node = route.nodes(x, np.zeros(len(x), np.int64))
                    inside = np.flatnonzero(sub[node] >= 0)
                    place, p = node + len(steps.p), top_p[node]
                    place[inside] = steps.leaves(x[inside], steps.first[sub[node[inside]]])
                    p[inside] = steps.p[place[inside]]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), leaves.take(pa.array(place)), pa.array(p)], schema=None, names=[*names, "leaf", "p"])

        leaves = pa.concat_arrays([steps.node, top_node.cast(steps.node.type)])
        return rows.mapInArrow(score, out)

    task = _dealt([top.n[i] for i in range(len(top.name)) if top.sub[i] >= 0], df.sparkSession.sparkContext.defaultParallelism)
    tasks = int(task.max()) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _beside(batch, width)
                node = route.nodes(x, np.zeros(len(x), np.int64))
                mine = sub[node].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), _bytes(x), pa.array(mine), pa.array(np.where(mine < 0, np.arange(len(mine)) % tasks, task[mine]).astype(np.int32)),
                     pc.if_else(pa.array(mine < 0), top_node.take(pa.array(node)), pa.scalar(None, pa.string())), pa.array(top_p[node])],
                    names=[*names, "_x", "_sub", "_task", "_leaf", "_p"])

    dealt = rows.mapInArrow(deal, StructType([*out.fields[:-2], *StructType.fromDDL("_x binary, _sub int, _task int, _leaf string, _p double").fields]))
    tree_columns = ["at", "child", "other", "feature", "threshold", "node"]
    of_task = F.get(F.array(*(F.lit(int(t)) for t in task)), F.col("sub")) if len(task) <= 64 else None
    given = fit.steps.select(F.col("sub").alias("_sub"), F.col("p").alias("_p"), *(F.col(c).alias(f"_{c}") for c in tree_columns))
    if of_task is not None:
        given = fit.steps.select(F.col("sub").alias("_sub"), of_task.alias("_task"), F.col("p").alias("_p"), *(F.col(c).alias(f"_{c}") for c in tree_columns))
    else:
        place = df.sparkSession.createDataFrame([(k, int(t)) for k, t in enumerate(task)], "_sub int, _task int")
        given = given.join(F.broadcast(place), "_sub")
    met = given.withColumn("_kind", F.lit(0)).unionByName(dealt.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    met = met.repartitionById(tasks, F.col("_task")).sortWithinPartitions("_sub", "_kind").drop("_task")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, steps = [], None, None
        for batch in batches:
            ids = batch.column("_sub").to_numpy()
            kind = batch.column("_kind").to_numpy()
            at = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1])) + 1), len(ids)]
            for a, e in zip(at, at[1:]):
                if a == e:
                    continue
                part = batch.slice(a, e - a)
                if kind[a] == 0:
                    if current != ids[a]:
                        held, current, steps = [], ids[a], None
                    held.append(part.select(["_sub", "_p", *(f"_{c}" for c in tree_columns)]))
                    continue
                if ids[a] < 0:
                    leaf, p = part.column("_leaf"), part.column("_p")
                else:
                    if steps is None:
                        steps = _Steps.of(pa.Table.from_batches(held).rename_columns(["sub", "p", *tree_columns]))
                        held = []
                    x = _matrix(part, "_x", width)
                    place = steps.leaves(x, np.zeros(len(x), np.int64))
                    leaf, p = steps.node.take(pa.array(place)), pa.array(steps.p[place])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), leaf, p], names=[*names, "leaf", "p"])

    return met.mapInArrow(walk, out)


def with_leaf(fit: TreeFit, df: DataFrame, keep: Sequence[str | Column] = ("*",), max_depth: int | None = None) -> DataFrame:
    """Adds ``leaf`` (the leaf's path) and ``p`` (P(class 1)) to the columns ``keep`` of ``df``.

    Rows meet their subtree in at most one shuffle, so ``keep`` should name few columns.  Streams, and walks that end early, take joins with
    blocks of BLOCK levels instead: a block table that Spark finds small is broadcast; others are joined by shuffling, with skewed blocks split.
    With ``max_depth`` the walk may end below that depth: then ``leaf`` is a prefix of the leaf's path that is at least as long as the path's first max_depth steps.
    """
    if max_depth is None and not df.isStreaming and fit.size:
        return _scored(fit, df, keep)
    rows = df.select(*keep, _vector(fit.features).alias("_x")).withColumns({"leaf": F.lit(""), "p": F.lit(None).cast("double")})
    depth = fit.depth if max_depth is None else min(fit.depth, max(max_depth - 1, 0))
    for k in range(depth // BLOCK + 1):
        block = (_blocks(fit.nodes.where(F.col("depth") < BLOCK)) if depth < BLOCK else fit.blocks).where(F.length("root") == k * BLOCK).select(F.col("root").alias("_root"), F.col("steps").alias("_steps"))

        def walk(h: Column, _: Column) -> Column:
            step = F.get("_steps", h)
            side = F.when(F.get("_x", step["feature"]) <= step["threshold"], 0).otherwise(1)
            return F.when(step["feature"].isNull(), h).otherwise(2 * h + 1 + side)

        rows = rows.join(block, F.col("leaf") == F.col("_root"), "left")
        # rows that have their leaf don't walk on
        rows = rows.withColumn("_h", F.when(F.col("_root").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), F.lit(0), walk)))
        rows = rows.withColumns({
            "leaf": F.when(F.col("_root").isNull(), F.col("leaf")).otherwise(F.concat("leaf", F.bin(F.col("_h") + 1).substr(F.lit(2), F.lit(BLOCK)))),
            "p": F.coalesce("p", F.when(F.get("_steps", "_h")["feature"].isNull(), F.get("_steps", "_h")["p"])),
        }).drop("_root", "_steps", "_h")
    return rows.drop("_x")


def heap_number(node: Column) -> Column:
    """Position of a node near the root in heap order (root 0, children of i: 2i+1 and 2i+2)."""
    return (F.conv(F.concat(F.lit("1"), node), 2, 10).cast("int") - 1).cast("int")


def feature_name(fit: TreeFit, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, fit.features)), index)


def structure(fit: TreeFit) -> DataFrame:
    """``(depth, leaves, root_feature, n_features, n_train)`` in one aggregation of the node table."""
    root = F.col("node") == ""
    return fit.nodes.agg(
        F.max("depth").alias("depth"), F.count_if("is_leaf").cast("int").alias("leaves"),
        F.max(F.when(root, feature_name(fit, F.col("feature")))).alias("root_feature"),
        F.lit(len(fit.features)).alias("n_features"), F.max(F.when(root, F.col("n"))).alias("n_train"))


def leaf_counts(fit: TreeFit, df: DataFrame, label: str, split_flag: str) -> DataFrame:
    """``(is_test, leaf, label, n)`` — the only pass over the rows."""
    return with_leaf(fit, df).groupBy(F.col(split_flag).alias("is_test"), "leaf", F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def depth_curve(fit: TreeFit, counts: DataFrame) -> DataFrame:
    """``(depth, train_accuracy, test_accuracy, leaves)`` of the depth-d tree for d = 1..D.

    Greedy trees are nested: the depth-d tree is the deep one cut at depth d.  Leaf counts go to all ancestors (the prefixes),
    each node counts its rows of its own class, and a depth sums its nodes and the leaves above it; only these sums, a few for each
    depth, are collected.  Class rule: P(class 1) > 0.5 → 1 (an exact 0.5 tie goes to class 0).
    """
    spark = fit.nodes.sparkSession
    above = counts.select("is_test", "label", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("leaf")), lambda d: F.col("leaf").substr(F.lit(1), d))).alias("node"))
    at_node = above.groupBy("node", "is_test").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("ones"))
    right = F.when(F.col("p") > 0.5, F.col("ones")).otherwise(F.col("rows") - F.col("ones"))
    sums = at_node.join(fit.nodes.select("node", "depth", "is_leaf", "p"), "node").groupBy("is_test", "depth", "is_leaf").agg(F.sum(right).alias("ok")).collect()
    sizes = fit.nodes.groupBy("depth", "is_leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["is_test"]: r["n"] for r in counts.groupBy("is_test").agg(F.sum("n").alias("n")).collect()}

    def part(rows, value, depth, flag):
        return sum(r[value] for r in rows if flag(r) and (r["depth"] == depth or (r["is_leaf"] and r["depth"] < depth)))

    def accuracy(depth, test):
        return part(sums, "ok", depth, lambda r: r["is_test"] == test) / total[test] if total.get(test) else None

    rows = [(d, accuracy(d, False), accuracy(d, True), int(part(sizes, "n", d, lambda r: True))) for d in range(1, fit.depth + 1)]
    return spark.createDataFrame(rows, "depth int, train_accuracy double, test_accuracy double, leaves int")


def trace_paths(fit: TreeFit, df: DataFrame, id_col: str, max_depth: int | None = None) -> DataFrame:
    """Decision path of every row through the (depth-truncated) tree: one row per (id, step).

    The steps are the prefixes of the row's leaf, joined with the node table.
    """
    scored = with_leaf(fit, df, [F.col(id_col).alias("id"), _vector(fit.features).alias("_v")], max_depth).select("id", "leaf", F.col("_v").alias("_x"))
    end = F.length("leaf") if max_depth is None else F.least(F.length("leaf"), F.lit(max_depth))
    steps = scored.withColumn("_end", end).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_end")))).withColumn("node", F.col("leaf").substr(F.lit(1), F.col("step")))
    nodes = fit.nodes if max_depth is None else fit.nodes.where(F.col("depth") <= max_depth)
    if max_depth is not None and max_depth <= BLOCK:
        nodes = F.broadcast(nodes)  # fewer than 2^(BLOCK + 1)
    last = F.col("step") == F.col("_end")
    inner = steps.join(nodes.select("node", "feature", F.col("threshold").alias("_t"), "p"), "node")

    def split(value: Column) -> Column:
        return F.when(~last, value)

    side = F.when(F.col("leaf").substr(F.col("step") + 1, F.lit(1)) == "0", "left").otherwise("right")
    return inner.select(
        "id", "step", "node", F.when(last, "leaf").otherwise("split").alias("type"), split(feature_name(fit, F.col("feature"))).alias("feature"),
        split(F.col("_t")).alias("threshold"), split(F.get("_x", "feature")).alias("value"), split(side).alias("direction"),
        F.when(last, (F.col("p") > 0.5).cast("int")).alias("prediction"))


def importances(fit: TreeFit) -> DataFrame:
    """``(feature, importance)``: share of the decrease of impurity by feature; 0 for features without splits."""
    found = fit.nodes.where(~F.col("is_leaf")).groupBy("feature").agg(F.sum("decrease").alias("d"))
    names = fit.nodes.sparkSession.createDataFrame(list(enumerate(fit.features)), "feature int, name string")
    total = F.sum("d").over(Window.partitionBy())  # one row per feature
    joined = F.broadcast(names).join(found, "feature", "left")
    return joined.select(F.col("name").alias("feature"), F.coalesce(F.try_divide("d", total), F.lit(0.0)).alias("importance"))
