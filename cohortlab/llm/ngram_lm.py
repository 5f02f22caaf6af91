"""Language-model scores by stupid backoff over n-gram count tables.

Counts come from the whole corpus; a document is scored with its own occurrences
taken out (leave-one-out), so that it doesn't vouch for itself.  For each word w with context u v:

    S = c(u v w) / c(u v) if c(u v w) > 0, else 0.4 * c(v w) / c(v) if c(v w) > 0,
        else 0.16 * c(w) / N, with 1/2 for an unseen word.

N-grams of all orders are hashes of 24 bits more than the number of n-grams needs (at most 64), so that at any size
one in some 17 million shares its hash with another.  Documents are dealt into blocks of about
``block_chars`` characters; a block's distinct n-grams with their counts are rows of the count table,
packed by hash range (sorted hashes as differences, byte plane by byte plane, compressed).  Every
range is summed over all blocks in one group whose size is set by ``range_grams``; the totals go
back to the blocks, joined to the n-grams in order, and are summed per document.  An n-gram
reaches a range at most once per block, and rows are dealt by their place in the table, so a frequent n-gram,
source, text or row makes no group large.  The place is the file and row number that the Parquet scan gives, so both
passes and any retry see the same blocks without a copy of the texts; rows from elsewhere are written once first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import WordHashes, ascii_words, column, materialize, mix64, word_hashes
from cohortlab.llm.mixing import token_count

SCHEMA = "doc_id long, n_tokens long, log_score double, mean_log_score double, n_trigram long, n_bigram long, n_unigram long, n_unseen long"


@dataclass(frozen=True)
class LmParams:
    backoff: float = 0.4
    block_chars: int = 8_000_000
    range_grams: int = 2_000_000


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as compressed byte planes (high planes of small values are zeros)."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(len(values), width)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def _differences(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def hash_bits(words: int) -> int:
    """24 bits more than the number of all n-grams takes, 64 at most."""
    return min(64, max(1, 3 * words).bit_length() + 24)


def block_grams(texts: list[str | None], cache: WordHashes, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (the top ``bits``) of the words, bigrams and trigrams that end at each word: (3, words); 0 where a document begins.  And words per text."""
    words = [word_hashes(ascii_words(t), cache) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    one = mix64(np.concatenate(words)) | np.uint64(1) if len(words) else np.zeros(0, np.uint64)
    place = np.arange(len(one)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) | np.uint64(1)
    three[2:] = mix64(two[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[2:]) | np.uint64(1)
    two[place < 1] = 0
    three[place < 2] = 0
    grams = np.stack([one, two, three])
    kept = np.maximum(grams >> np.uint64(64 - bits), np.uint64(1))
    kept[grams == 0] = 0
    return kept, sizes


def _counter(ranges: int, bits: int):
    cache = WordHashes()
    shift = np.uint64(bits - int(np.log2(ranges))) if ranges > 1 else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, _ = block_grams(pdf["text"].tolist(), cache, bits)
        found, counts = np.unique(grams[grams != 0], return_counts=True)
        home = (found >> shift).astype(np.int64) if shift is not None else np.zeros(len(found), np.int64)
        homes, first = np.unique(home, return_index=True)
        parts = list(zip(np.split(found, first[1:]), np.split(counts, first[1:]), strict=True)) if len(found) else []
        return pd.DataFrame({
            "part": homes, "block": int(pdf["block"].iloc[0]),
            "grams": [packed(_differences(g), 8) for g, _ in parts], "counts": [packed(c, 4) for _, c in parts],
        })

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash range: how often every n-gram occurs in other blocks, for each block in its own order."""
    grams = [np.cumsum(unpacked(g, 8), dtype=np.uint64) for g in pdf["grams"]]
    counts = np.concatenate([unpacked(c, 4) for c in pdf["counts"]]).astype(np.float64)
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = (np.bincount(place, weights=counts)[place] - counts).astype(np.uint64)
    ends = np.cumsum([len(g) for g in grams])[:-1]
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "totals": [packed(t, 8) for t in np.split(totals, ends)]})


def _scorer(params: LmParams, corpus_words: int, bits: int):
    cache = WordHashes()

    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        grams, sizes = block_grams(pdf["text"].tolist(), cache, bits)
        owner = np.repeat(np.arange(len(pdf)), sizes)
        known, mine = np.unique(grams[grams != 0], return_counts=True)
        replies = replies.sort_values("part")
        totals = mine
        if len(replies):
            totals = mine + np.concatenate([unpacked(t, 8) for t in replies["totals"]]).astype(np.int64)
        others = []
        for g in grams:  # the corpus' count less the document's own
            at = np.searchsorted(known, g)
            at[g == 0] = 0
            key = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ g
            _, place, own = np.unique(key, return_inverse=True, return_counts=True)
            c = totals[at] - own[place] if len(totals) else at
            c[g == 0] = 0
            others.append(c)
        one, two, three = others
        before = np.concatenate([[0], one[:-1]]) if len(one) else one
        context = np.concatenate([[0], two[:-1]]) if len(two) else two
        rest = np.maximum(corpus_words - sizes, 1)[owner]
        b = params.backoff
        by3, by2, by1 = three > 0, (three <= 0) & (two > 0), (three <= 0) & (two <= 0) & (one > 0)
        score = np.full(len(one), b * b * 0.5) / rest
        score[by1] = b * b * one[by1] / rest[by1]
        score[by2] = b * two[by2] / np.maximum(before[by2], 1)
        score[by3] = three[by3] / np.maximum(context[by3], 1)
        add = lambda x: np.bincount(owner, weights=x, minlength=len(pdf))
        total = add(np.log(score))
        n3, n2, n1 = (add(x.astype(float)).astype(np.int64) for x in (by3, by2, by1))
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "n_tokens": sizes, "log_score": total,
            "mean_log_score": [t / n if n else None for t, n in zip(total, sizes, strict=True)],
            "n_trigram": n3, "n_bigram": n2, "n_unigram": n1, "n_unseen": sizes - n3 - n2 - n1,
        })

    return run


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's place: a hash of the file and row number in a Parquet table.

    Rows that don't come straight from one are written to the shared folder and read back.
    """
    narrow = [column("doc_id").cast("long").alias("doc_id"), column("text").alias("text")]

    def located(df: DataFrame, cols: list) -> DataFrame:
        where = df.metadataColumn("_metadata")
        return df.select(*cols, F.xxhash64(where["file_path"], where["row_index"]).alias("place"))

    try:
        return located(docs, narrow)
    except AnalysisException:
        return located(materialize(docs.select(*narrow), "placed"), ["doc_id", "text"])


def deal(docs: DataFrame, blocks: int) -> DataFrame:
    """A block for each row; repeated rows go to different ones."""
    return placed(docs).withColumn("block", F.pmod("place", F.lit(blocks)).cast("int")).drop("place")


def score(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """Per row: doc_id, n_tokens, log_score (natural log, summed), mean_log_score, words scored at each order.

    Words are runs without ASCII white space, lower-cased in A-Z; n-grams don't cross documents.  Null
    and empty texts have 0 words, the score 0 and a null mean.  Every row is a document of its own: repeated
    rows count twice and vouch for each other.  An empty table gives an empty result; other columns are ignored.
    """
    text = column("text")
    sums = docs.agg(F.sum(F.length(text)).alias("chars"), F.sum(token_count(text)).alias("words")).first()
    words = sums["words"] or 0
    blocks = max(1, -(-(sums["chars"] or 0) // params.block_chars))
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, 2.5 * words / params.range_grams)))))
    bits = hash_bits(words)
    dealt = deal(docs, blocks)
    table = dealt.groupBy("block").applyInPandas(_counter(ranges, bits), "part long, block int, grams binary, counts binary")
    replies = table.groupBy("part").applyInPandas(_summed, "block int, part long, totals binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_scorer(params, words, bits), SCHEMA)
