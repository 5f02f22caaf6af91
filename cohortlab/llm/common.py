"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import scratch_path

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000
BROADCAST_ROWS = 200_000
WORD_CACHE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS texts at once; a smaller setting stays."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    """A column by its exact name (dots and backticks are part of the name)."""
    return F.col(quoted(name))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= bound else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered for frequent words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z only; words are runs without space, tab, LF, VT, FF and CR (UTF-8 bytes)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; of the whole sequence if it has 1 to k-1 words; none if empty."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ words[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def map_frames(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInPandas`` for a function from one pandas frame to one (or None)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf)
            if out is not None and len(out):
                yield out

    return df.mapInPandas(run, schema)


