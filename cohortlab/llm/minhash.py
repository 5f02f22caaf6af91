"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

Sketch.  A set's ``t`` coordinates are filled in rounds: in round i every
element is hashed to a bin and a value, and a bin keeps the smallest
(round, value).  Rounds 0..t-1 place elements in random bins; rounds t..2t-1
place all elements in bin i-t, so that every coordinate is filled after 2t
rounds at most, and after about log(t) rounds of a large set.  The share of
equal coordinates estimates Jaccard similarity with Chernoff-type bounds, as for
t independent min-hashes, at a cost of O(n + t log t) instead of O(n t).

Search.  Documents with equal shingle sets form one class.  Bands of
``rows`` coordinates put classes in buckets.  In a bucket, every class is
compared with one pivot (linear in the bucket) - the class whose buckets are the fullest, as
the original of a family of edited copies has - and verified links give components.  A class meets the fullest of its
pivots first; the others only where they are of another component by then.
A pivot h whose members fall into several components leaves work.  Two members with the same other pivot as their
home are looked at there, so if few members (``few``) lack the most frequent home, that work is the pairs of these with
all members.  Otherwise let x and y be linked, x not linked to h.  If the overlap that this
link needs exceeds |x & h| or |y & h|, x and y share a shingle outside h, and as
many of them as the excess, which bounds the prefix of x - h that has to be looked at:
the members are dealt anew by (pivot, shingle outside it).  The excess can be missing only if one of the
two is smaller than h and both are nearly linked to it; the smaller ones and those that aren't
linked stay together and get a smaller pivot.  The step repeats until no group holds two components.  Nothing is dropped, yet a
passage that many documents share lies in the pivot and brings nobody together, and a group of
thousands of copies costs about as many comparisons as it has members.  All links are confirmed
on the full sets.

With similarity 0.75, 40 bands of 4 rows share no bucket with probability
(1 - 0.75**4)**40 = 3e-7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import (
    WordHashes,
    ascii_words,
    column,
    map_frames,
    materialize,
    maybe_broadcast,
    mix64,
    shingle_hashes,
    small_batches,
    word_hashes,
)
from cohortlab.llm.components import connected_components


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    #: Members that are compared directly with all members of their pivot, up to this number; it grows fourfold with every step.
    few: int = 64

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(ascii_words(text), cache), k))


def _round(x: np.ndarray, i: int) -> np.ndarray:
    return mix64(x + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))


#: Elements whose rounds are held at once (one set at least).
PIECE = 1 << 17


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets of 64-bit hashes: (len(sets), t) uint64."""
    out, first, held = np.empty((len(sets), t), dtype=np.uint64), 0, 0
    for at, s in enumerate(sets, 1):
        held += len(s)
        if held >= PIECE or at == len(sets):
            out[first:at] = _sketches(sets[first:at], t)
            first, held = at, 0
    return out


def _sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    n = len(sets)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    for i in range(2 * t):
        if not len(x):
            break
        h = _round(x, i)
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        if i < t:
            place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            place = np.full(len(x), i - t, dtype=np.int64)
        np.minimum.at(out, owner * t + place, value)
        open_sets = (out.reshape(n, t) == empty).any(axis=1)
        keep = open_sets[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band (the band's number is part of it)."""
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key ^ parts[:, :, j]) + np.uint64(j)
    return mix64(key).view(np.int64)


def _features(params: MinHashParams):
    cache = WordHashes()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, params.shingle, cache) for t in pdf["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        sk = sketch([sets[i] for i in full], params.size)
        keys = band_keys(sk, params.bands, params.rows)
        bands, same = [None] * len(sets), [None] * len(sets)
        for row, i in enumerate(full):
            bands[i] = keys[row]
            same[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
        return pd.DataFrame(
            {"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n": [len(s) for s in sets], "cls": same, "bands": bands}
        )

    return run


def features(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """Per row: doc_id, text_key, n (set size), cls (128-bit digest of the set), bands."""
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return map_frames(
        narrow, _features(params), "doc_id long, text_key long, n long, cls binary, bands array<long>"
    )


SET_CACHE = 1_000_000


class _Sets(dict):
    """Shingle sets by class, the oldest dropped beyond SET_CACHE elements."""

    def __init__(self, k: int):
        super().__init__()
        self.k, self.words, self.held = k, WordHashes(), 0

    def of(self, key: int, text: str) -> np.ndarray:
        found = self.get(key)
        if found is None:
            while self and self.held > SET_CACHE:
                self.held -= len(self.pop(next(iter(self))))
            found = self[key] = shingle_set(text, self.k, self.words)
            self.held += len(found)
        return found


def _verifier(params: MinHashParams):
    sets = _Sets(params.shingle)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = []
        for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
            x, y = sets.of(a, ta), sets.of(b, tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= params.percent * (len(x) + len(y) - both))
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "linked": linked})

    return run


def outside(x: np.ndarray, pivot: np.ndarray, smallest: int, percent: int) -> tuple[np.ndarray, bool]:
    """The shingles of ``x`` outside its pivot of which any set that ``x`` links with holds one, and whether
    ``x`` may also be linked inside the pivot.

    ``smallest`` is the least size of a set in the group.  An overlap of percent / (100 + percent) of both sizes makes a link.
    """
    extra = np.setdiff1d(x, pivot, assume_unique=True)
    inside = len(x) - len(extra)
    least = max(smallest, -(-percent * len(x) // 100))
    excess = -(-percent * (len(x) + least) // (100 + percent)) - inside
    return extra[: max(0, len(extra) - max(1, excess) + 1)], excess <= 0


def _dealer(params: MinHashParams):
    sets = _Sets(params.shingle)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, again = [], []
        loose = pdf["apart"] | (pdf["n"] < pdf["n_a"])
        groups = mix64(pdf["a"].to_numpy(np.int64).view(np.uint64))
        for a, b, ta, tb, low, free, group in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], pdf["smallest"], loose, groups, strict=True):
            extra, inside = outside(sets.of(b, tb), sets.of(a, ta), low, params.percent)
            found.append(mix64(extra ^ group).view(np.int64))
            again.append(int(group.view(np.int64)) if inside and free else None)
        keep = pdf[["b", "n", "n_a", "score", "label"]]
        return keep.assign(buckets=found, again=pd.array(again, dtype="Int64"))

    return run


def _with_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with the texts of one document of class a and of class b.  The pivot's side ``a`` is joined last."""
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    reps = classes.join(involved, "class", "left_semi")
    reps = materialize(reps.select("class", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_text")), "reps")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    side = maybe_broadcast(reps, reps.count())
    texts = (
        d.join(side, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_text")))
        .select("class", "text")
        .dropDuplicates(["class"])
    )
    return pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a"
    )


def _sizes_fit(x: str, y: str, percent: int):
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def _star(members: DataFrame) -> DataFrame:
    """(a, n_a, b, n, score, home): every member of a bucket with the bucket's pivot.

    ``members`` are (bucket, b, n, score, fit); the pivot is the fit one with the highest score.  ``home`` is a
    member's pivot with the highest score: two members with one home are looked at there only.
    """
    pivots = members.where("fit").groupBy("bucket").agg(F.max(F.struct("score", -F.col("n"), "b", "n")).alias("pivot"))
    pivots = pivots.select("bucket", F.col("pivot.b").alias("a"), F.col("pivot.n").alias("n_a"), F.col("pivot.score").alias("score_a"))
    star = members.join(pivots, "bucket").where("b != a").groupBy("a", "b").agg(
        *(F.first(c).alias(c) for c in ("n_a", "score_a", "n", "score"))
    )
    star = materialize(star, "star")
    home = star.groupBy("b").agg(F.max(F.struct("score_a", "a")).alias("home")).select("b", F.col("home.a").alias("home"))
    return star.join(home, "b").drop("score_a")


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The groups that hold several labels: key, size, smallest."""
    groups = placed.groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("n").alias("smallest"))
    return groups.where("lo != hi").select(key, "size", "smallest")


def _placed(star: DataFrame, labels: DataFrame) -> DataFrame:
    """``star`` with the label of each member and whether the pivot has another one (a class without a label is its own)."""
    owner = labels.select(F.col("node").alias("b"), "label")
    out = star.join(owner, "b", "left").withColumn("label", F.coalesce("label", "b"))
    out = out.join(owner.select(F.col("b").alias("a"), F.col("label").alias("label_a")), "a", "left")
    return out.withColumn("apart", F.coalesce("label_a", "a") != F.col("label")).drop("label_a")


def _usual(left: DataFrame) -> DataFrame:
    """``left`` with ``usual``, whether a member has its group's most frequent home other than the pivot, and ``rare``, how many members of the group haven't."""
    homes = left.groupBy("a", "home").agg(F.count(F.lit(1)).alias("together"))
    top = homes.where("home != a").groupBy("a").agg(F.max(F.struct("together", "home")).alias("top"))
    out = left.join(top, "a", "left").withColumn("usual", F.coalesce(F.col("home") == F.col("top.home"), F.lit(False)))
    return out.withColumn("rare", F.col("size") - F.coalesce("top.together", F.lit(0))).drop("top")


def _direct(left: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n): the pairs of groups with few rare members, at most ``rare`` for each member, as two usual ones are looked at in their home."""
    rare = left.where("not usual").select(F.col("a").alias("group"), F.col("b").alias("b_2"), F.col("n").alias("n_2"), F.col("label").alias("label_2"), F.col("home").alias("home_2"))
    once = F.col("usual") | (F.col("b") < F.col("b_2"))
    here = (F.col("home") != F.col("home_2")) | (F.col("home") == F.col("a"))
    on = (F.col("a") == F.col("group")) & once & (F.col("label") != F.col("label_2")) & here & _sizes_fit("n", "n_2", percent)
    # the smaller number first, so that a pair found in two groups is one pair
    one, two = (F.struct(F.col("b" + k).alias("b"), F.col("n" + k).alias("n")) for k in ("", "_2"))
    found = left.join(maybe_broadcast(rare, rare.count()), on).select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    return found.select(F.col("x.b").alias("a"), F.col("y.b").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n"))


def _link(docs: DataFrame, classes: DataFrame, pairs: DataFrame, labels: DataFrame, seen: DataFrame, params: MinHashParams) -> tuple[DataFrame, DataFrame]:
    """Verifies those of ``pairs`` (a, b, n_a, n) that haven't been seen: new labels, and the pairs seen so far."""
    todo = pairs.where(_sizes_fit("n_a", "n", params.percent)).select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")
    todo = materialize(todo, "todo")
    texts = _with_texts(docs, classes, todo).select("a", "b", "text_a", "text_b")
    checked = materialize(map_frames(texts, _verifier(params), "a long, b long, linked boolean"), "checked")
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected_components(known.union(checked.where("linked").select("a", "b"))), seen.union(todo)


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept, text_key (a hash of the text).

    ``docs`` needs doc_id and text; other columns are ignored.  Words are lower-cased in A-Z only;
    null, empty and blank texts have an empty set and link with nothing.  component_id is the
    smallest non-null doc_id of the linked rows (null if all are null); kept is
    true where doc_id equals it (null-safe), so repeated rows of one id agree.
    An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").alias("text"))
    feats = materialize(features(docs, params), "sets")
    classes = materialize(
        feats.where("n > 0")
        .groupBy("cls")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("rep"),
            F.min("doc_id").alias("least"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
        # from here on a class is a number: numbers are grouped by hashing, digests need a sort for every minimum
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    members = classes.select(F.col("class").alias("b"), "n", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(members.join(full, "bucket"), "members")
    score = members.groupBy("b").agg(F.sum("size").alias("score"))
    star = materialize(_star(members.join(score, "b").withColumn("fit", F.lit(True))), "star")
    spark = docs.sparkSession
    labels = spark.createDataFrame([], "node long, label long")
    seen = spark.createDataFrame([], "a long, b long")
    few = params.few
    ends = ["a", "b", "n_a", "n"]
    # every member meets its home pivot first: what that links needs no further look
    pairs = star.where("a = home").select(*ends)
    while True:
        labels, seen = _link(docs, classes, pairs, labels, seen, params)
        if star is None:
            break
        placed = _placed(star, labels)
        live = materialize(placed.join(placed.where("apart").select("a").distinct(), "a", "left_semi"), "live")
        labels, seen = _link(docs, classes, live.where("apart").select(*ends), labels, seen, params)

        placed = _placed(live.drop("label", "apart"), labels)
        homes = placed.groupBy("a").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo != hi or lo = a").select("a")
        left = materialize(_usual(placed.join(_mixed(placed, "a"), "a").join(homes, "a", "left_semi")), "left")
        pairs = _direct(left.where(F.col("rare") <= few), params.percent)
        large = left.where(F.col("rare") > few)
        if large.isEmpty():
            star = None
            if left.isEmpty():
                break
            continue
        dealt = map_frames(
            _with_texts(docs, classes, large).select("a", "n_a", "b", "n", "score", "label", "apart", "smallest", "text_a", "text_b"),
            _dealer(params),
            "b long, n long, n_a long, score long, label long, buckets array<long>, again long",
        )
        dealt = materialize(dealt, "dealt")
        cols = ["b", "n", "score", "label"]
        dealt = dealt.select(*cols, F.explode("buckets").alias("bucket"), F.lit(True).alias("fit")).union(
            dealt.where("again is not null").select(*cols, F.col("again").alias("bucket"), (F.col("n") < F.col("n_a")).alias("fit"))
        )
        dealt = dealt.join(_mixed(dealt, "bucket").select("bucket"), "bucket").drop("label")
        star = materialize(_star(dealt), "star")
        pairs = pairs.union(_placed(star.where("a = home"), labels).where("apart").select(*ends))
        few *= 4

    # one row a class, so copies add nothing to a component's rows
    owned = classes.select("cls", "class", "least").join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    first = materialize(owned.groupBy("label").agg(F.min("least").alias("component_id")), "first")
    found = materialize(owned.join(first, "label").select("cls", "component_id"), "found")
    rows = feats.select("doc_id", "text_key", "n", "cls").join(found, "cls", "left")
    rows = rows.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept, "text_key")


def one_per_group(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each group of near duplicates.

    Of rows that repeat a kept doc_id one stays.  Rows with a null doc_id stay if their whole
    group has no id; texts without words are in no group and stay.
    """
    found = materialize(near_duplicates(docs, params).select("doc_id", "text_key", "kept"), "kept")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text")).distinct()
    gone = materialize(gone, "gone")
    on = column("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & F.xxhash64(column("text")).eqNullSafe(F.col("gone_text"))
    out = docs.join(maybe_broadcast(gone, gone.count()), on, "left_anti")
    many = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("many_id")).count().where("count > 1").select("many_id")
    many = materialize(many, "many")
    if many.isEmpty():
        return out
    same = column("doc_id").cast("long") == F.col("many_id")
    return out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(["doc_id"]))
