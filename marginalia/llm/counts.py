"""Token counts as delta-maintained rollups.

Every batch of changes becomes signed rows: an insert adds a document and its tokens, a delete takes away what was last
counted, a revision does both. The rows of a batch are summed by source, language and tokenizer version and written to
the batch's own folder; totals are sums of these deltas, so they never read a text again. A batch counts once its folder
has the writer's success marker. Committing the same batch again does nothing; one that was interrupted is written anew.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from marginalia.llm.shared import word_count

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, sign bigint, tokens bigint"
DELTAS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
TOKENIZERS = "/opt/tokenizers"

Tokenizer = Callable[[str], Column]


def white_space_words(text: str) -> Column:
    return word_count(text)


def byte_pairs(vocabulary: str, pattern: str) -> Tokenizer:
    """Token counts of a byte-level BPE given as ranks. A text is cut by ``pattern``; the pieces' counts are remembered."""
    def of(text: str) -> Column:
        @pandas_udf(LongType())
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tiktoken
            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for texts in batches:
                yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")
        return count(F.col(text))
    return of


def counted(docs: DataFrame, tokenizers: dict[str, Tokenizer]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: one row per document and tokenizer version. A null text has 0 tokens."""
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), of("text").alias("tokens")) for name, of in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.explode(pairs).alias("count")).select("doc_id", "source", "lang", "count.tokenizer", "count.tokens")


class Rollup:
    """The ledger of signed rows and the deltas of each batch, below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, batch: str, part: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/{batch}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def batches(self, part: str = "deltas") -> list[str]:
        """Committed batches in the order of their names."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        return [b for b in sorted(s.getPath().getName() for s in fs.listStatus(top)) if self._done(b, part)]

    def _read(self, part: str, schema: str, before: str | None = None) -> DataFrame:
        # Only what is fully committed: the deltas are written last.
        names = [b for b in self.batches() if before is None or b < before]
        frames = self.spark.read.schema(schema)
        return frames.parquet(*[f"{self.path}/{part}/{b}" for b in names]) if names else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply a batch; False if it had been applied. Batch names must sort in the order of application.

        ``inserts`` and ``revisions``: doc_id, source, lang, tokenizer, tokens. ``deletes``: doc_id. Revisions and deletes take back
        all the ledger holds of the document (for revisions: under that tokenizer); documents it does not hold are
        not deleted, and their revisions are inserts. An insert is added as it is, repeated rows included, so that a load
        needs no look-up. Rows repeated within a batch's revisions or deletes act once, and a document both
        deleted and revised is deleted; a null doc_id never meets the ledger.
        """
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", batch):
            raise ValueError(f"not a batch name: {batch}")
        if self._done(batch, "deltas"):
            return False
        if any(b > batch for b in self.batches()):
            raise ValueError(f"{batch} sorts before a committed batch")
        cols = ["doc_id", *KEYS]
        rows = []
        if inserts is not None:
            rows.append(inserts.select(*cols, F.lit(1).cast("bigint").alias("sign"), "tokens"))
        if deletes is not None or revisions is not None:
            held = self.current(batch)
            if deletes is not None:
                gone = held.join(deletes.select("doc_id").distinct(), "doc_id", "left_semi")
                rows.append(gone.select(*cols, (-F.col("n")).alias("sign"), "tokens"))
            if revisions is not None:
                new = revisions.dropDuplicates(["doc_id", "tokenizer"])
                if deletes is not None:
                    new = new.join(deletes.select("doc_id").distinct(), "doc_id", "left_anti")
                old = held.join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
                rows.append(old.select(*cols, (-F.col("n")).alias("sign"), "tokens"))
                rows.append(new.select(*cols, F.lit(1).cast("bigint").alias("sign"), "tokens"))
        ledger = None
        for part in rows:
            ledger = part if ledger is None else ledger.unionByName(part)
        if ledger is None:
            ledger = self.spark.createDataFrame([], LEDGER)
        place = f"{self.path}/ledger/{batch}"
        # Overwriting makes a retry after a crash start clean; a finished ledger is used again.
        if not self._done(batch, "ledger"):
            ledger.select([c.split()[0] for c in LEDGER.split(", ")]).write.mode("overwrite").parquet(place)
        signed = self.spark.read.schema(LEDGER).parquet(place)
        deltas = signed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")  # one row per group
        return True

    def current(self, before: str | None = None) -> DataFrame:
        """doc_id, source, lang, tokenizer, tokens, n: the rows the ledger holds now (or before a batch), n times each."""
        rows = self._read("ledger", LEDGER, before)
        return rows.groupBy("doc_id", *KEYS, "tokens").agg(F.sum("sign").alias("n")).filter("n > 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; groups that have emptied are left out."""
        summed = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")
