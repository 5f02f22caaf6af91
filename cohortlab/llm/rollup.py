"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches.  A batch of changes - inserts, deletes, revised counts of
(document, tokenizer version) - is turned into signed rows against the ledger of present counts: minus
the old count, plus the new one.  Their sums by source, language and tokenizer version are the
batch's deltas; totals are the sum of all committed deltas and never need a recount.  A batch's parts are written
under its id and count only once its commit record exists: a repeated or
interrupted batch can be sent again and has its effect once.  One writer at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import ascii_words, column, small_batches

KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean, turn long"
CHANGES = ("doc_id", "tokenizer", "source", "lang", "tokens", "op", "seq")

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class Tokenizers:
    #: Rank file of a byte-level vocabulary; read on the driver and sent to the executors.
    ranks_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    byte_version: str = "byte_bpe_50k"
    word_version: str = "words_v1"


def token_counts(docs: DataFrame, tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """Per row: doc_id, source, lang, n_chars, tokens_byte, tokens_words.  Null and empty texts have 0 of each."""
    small_batches(docs.sparkSession)
    with open(tokenizers.ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=table, special_tokens={})
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(
                n_chars=[len(t) for t in texts],
                tokens_byte=[len(encoding.encode_ordinary(t)) for t in texts],
                tokens_words=[len(ascii_words(t)) for t in texts],
            )

    narrow = docs.select(
        column("doc_id").cast("long").alias("doc_id"), column("source").cast("string").alias("source"), column("lang").cast("string").alias("lang"),
        column("text").alias("text"),
    )
    return narrow.mapInPandas(run, "doc_id long, source string, lang string, n_chars long, tokens_byte long, tokens_words long")


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, kept in ``folder`` (shared)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _part(self, kind: str, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-'")
        return f"{self.folder}/{kind}/{batch}"

    def committed(self) -> list[str]:
        """Ids of the committed batches, in order."""
        if not self._exists(f"{self.folder}/commits"):
            return []
        rows = self.spark.read.schema("batch string, turn long").parquet(f"{self.folder}/commits/*").collect()
        return [r["batch"] for r in sorted(rows, key=lambda r: r["turn"])]

    def _ledger(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*(self._part("ledger", b) for b in batches))

    def current(self) -> DataFrame:
        """The present count of each document and tokenizer version."""
        last = self._ledger(self.committed()).groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "turn").alias("x"))
        return last.select("doc_id", "tokenizer", "x.*").where("alive").drop("alive")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it was committed before.

        ``changes``: doc_id, tokenizer, source, lang, tokens, op (insert, revise, delete), seq.
        Of several changes of one document and tokenizer in a batch the one with the highest seq
        counts (ties: the larger row).  An insert of a present document revises it, a revision of an absent one
        inserts it, a delete of an absent one does nothing.  Null ids are one document; null sources and languages are levels of
        their own; null tokens count as 0; unknown ops are refused.
        """
        done = self.committed()
        if batch in done:
            return False
        odd = changes.where("op is null or op not in ('insert', 'revise', 'delete')").limit(1).count()
        if odd:
            raise ValueError("op must be insert, revise or delete")
        turn = len(done) + 1
        change = F.struct("seq", F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang", "op")
        new = changes.groupBy("doc_id", "tokenizer").agg(F.max(change).alias("x")).select(
            "doc_id", "tokenizer", "x.source", "x.lang", "x.tokens", (F.col("x.op") != "delete").alias("alive"), F.lit(turn).cast("long").alias("turn")
        )
        new.write.mode("overwrite").parquet(self._part("ledger", batch))
        new = self.spark.read.schema(LEDGER).parquet(self._part("ledger", batch))
        before = self._ledger(done)
        touched = new.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
        before = before.join(touched, before["doc_id"].eqNullSafe(F.col("d")) & before["tokenizer"].eqNullSafe(F.col("t")), "left_semi")
        old = before.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "turn").alias("x"))
        minus = old.select("tokenizer", "x.*").where("alive").select(*KEYS, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))
        plus = new.where("alive").select(*KEYS, F.lit(1).alias("docs"), "tokens")
        deltas = minus.unionByName(plus).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(self._part("deltas", batch))
        record = self.spark.createDataFrame([(batch, turn)], "batch string, turn long")
        record.coalesce(1).write.mode("overwrite").parquet(self._part("commits", batch))
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens: the sum of the committed deltas; levels that fell to 0 documents go."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        done = self.committed()
        deltas = self.spark.read.schema(schema).parquet(*(self._part("deltas", b) for b in done)) if done else self.spark.createDataFrame([], schema)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0")


def changes_of(counts: DataFrame, tokenizer: str, tokens, op, seq: int = 0) -> DataFrame:
    """Change rows for one tokenizer version from a table with doc_id, source and lang."""
    return counts.select(
        "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", tokens.cast("long").alias("tokens"), op.alias("op"), F.lit(seq).alias("seq")
    )
